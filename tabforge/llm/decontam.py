"""Benchmark decontamination by winnowing.

Every window of ``window`` words is represented by the least hash among its ``gram``-word runs, on both
sides; equal windows have equal representatives, so joining documents' and items' representatives finds
every shared window. Each hit is then extended: the window's words themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import all_equal, ascii_lower, gram_hashes, settle, sliding_least, small, words


def _fingerprints(df: DataFrame, length: int, gram: int) -> DataFrame:
    """Adds ``fps``: the representative of every window of ``length`` words of the array ``w``."""
    k = min(gram, length)
    # lower() may fold more than A-Z, never less: equal words stay equal, and hits are compared exactly later.
    hashed = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(F.lower(x))))
    return sliding_least(gram_hashes(hashed, "h", "g", k), "g", "fps", length - k + 1).drop("h", "g")


def _window(start, length):
    return F.array_join(F.slice(F.col("w"), start, length), " ")


def contaminated(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash``.

    Words are lower-cased runs of letters, digits and non-ASCII characters. An item's windows are all its
    runs of ``window`` words; a shorter item with any word is one window; an item without words has none.
    A document word inside any occurrence of a window is hit. ``text_hash`` (xxhash64 of the text) tells rows that
    share an id apart. Null texts have no words. Rows with equal id
    and equal text get equal results; a null document id is kept. An item without id can hit words but is
    not counted among the items; items that share an id are one. Empty tables give empty or clean results.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    item = items.select("item_id", words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    item = settle(item.select("item_id", "w", F.least(F.size("w"), F.lit(window)).alias("len")))
    lengths = [r[0] for r in item.select("len").distinct().collect()]  # `window` values at most
    wins = settle(item.select("item_id", "len", F.explode_outer(F.transform(
        F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: _window(i, F.col("len")))).alias("win")).distinct())

    per_doc = []
    base = docs.select("doc_id", "th", words(F.col("text")).alias("w"))
    for n in sorted(lengths, reverse=True) or [window]:
        keys = settle(_fingerprints(item.where(F.col("len") == n), n, gram)
                      .select(F.explode_outer("fps").alias("fp")).distinct().withColumn("hit", F.lit(True)))
        rows = _fingerprints(base, n, gram).select("doc_id", "th", F.size("w").cast("long").alias("n_words"),
                                                   F.posexplode_outer("fps").alias("pos", "fp"))
        found = rows.join(small(keys, 32), "fp", "left").where("hit or pos is null or pos = 0")
        per_doc.append(found.select("doc_id", "th", "n_words", F.lit(n).alias("len"), "pos", "hit"))
    union = per_doc[0]
    for x in per_doc[1:]:
        union = union.unionByName(x)
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    state = settle(union.groupBy("doc_id", "th").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(first & (F.col("len") == (max(lengths) if lengths else window)), 1)).alias("copies"),
        F.collect_set(F.when(F.col("hit"), F.struct((F.col("pos") + 1).alias("pos"), "len"))).alias("starts")))

    hits = settle(state.where(F.size("starts") > 0).select("doc_id", "th", "starts"))
    near = docs.join(small(hits, 64), all_equal(docs, hits, "doc_id", "th"), "left_semi").distinct()
    spots = near.join(hits, all_equal(near, hits, "doc_id", "th")).select(
        near["doc_id"], near["th"], words(ascii_lower(F.col("text"))).alias("w"), "starts")
    spots = spots.select("doc_id", "th", F.explode_outer(F.transform("starts", lambda s: F.struct(
        s["pos"].alias("pos"), s["len"].alias("len"), _window(s["pos"], s["len"]).alias("win")))).alias("s")
                         ).select("doc_id", "th", "s.*")
    distinct_wins = settle(wins.select("len", "win").distinct())
    exact = settle(spots.join(small(distinct_wins, 64, text="win"), ["len", "win"], "left_semi"))
    cover = exact.groupBy("doc_id", "th").agg(F.size(F.array_distinct(F.flatten(F.collect_list(
        F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1))))).cast("long").alias("n_hit"))
    found_items = (exact.select("doc_id", "th", "len", "win").distinct().join(small(wins, 64, text="win"), ["len", "win"])
                   .groupBy("doc_id", "th").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")))
    none = F.array().cast("array<string>")
    s, c, i = state.alias("s"), cover.alias("c"), found_items.alias("i")
    out = (s.join(c, F.col("s.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("s.th") == F.col("c.th")), "left")
           .join(i, F.col("s.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("s.th") == F.col("i.th")), "left"))
    items_found = F.coalesce(F.col("i.items"), none)
    n_hit = F.coalesce(F.col("c.n_hit"), F.lit(0)).cast("long")
    return (out.select(F.col("s.doc_id").alias("doc_id"), F.col("s.n_words").alias("n_words"), n_hit.alias("n_hit"),
                       F.size(items_found).cast("long").alias("n_items"),
                       F.sha2(F.array_join(F.array_sort(items_found), ",").cast("binary"), 256).alias("items_sha256"),
                       (n_hit > 0).alias("contaminated"), F.col("s.th").alias("text_hash"),
                       F.explode_outer(F.sequence(F.lit(1), F.col("s.copies").cast("int"))).alias("_copy")).drop("_copy"))
