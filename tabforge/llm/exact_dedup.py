"""Exact dedup by deterministic block naming.

The normalised text is cut into blocks of fixed size. Distinct blocks are sorted and numbered;
every document becomes its list of block names. Then adjacent names are paired, distinct pairs are
sorted and numbered, and so on until one name per document is left. Names are given to sorted
distinct contents, so two documents share a name exactly if their contents are equal.

Rows look their block's name up by a 128-bit hash, and every naming checks that no two contents share
that hash; should it happen, the naming runs again with another seed. The text is shuffled once, and
equal blocks are combined before that shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import settle


def _hash(c, seed: int):
    return F.struct(F.xxhash64(F.lit(2 * seed + 1), c).alias("h1"), F.xxhash64(F.lit(2 * seed + 2), c).alias("h2"))


def _blocks(norm, size: int):
    data = norm.cast("binary")
    n = F.greatest(F.ceil(F.octet_length(norm) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _numbered(contents: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct contents, sorted, with an integer name each."""
    return (contents.distinct().sortWithinPartitions(*cols)
            .withColumn("name", F.monotonically_increasing_id()))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2048,
                blanks: str = r"[\x20\x09-\x0D]+") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after ``blanks`` are deleted. The row with the most code points in its
    original text stays, then the smallest id; a null id counts as largest, and of rows alike in all this
    (repeated rows) one stays. A null text is empty; all empty texts are equal. An empty table gives an
    empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("n_cp"),
                       F.regexp_replace(text, blanks, "").alias("norm"))
    seed = 0
    while True:
        rows = settle(norm.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", "n_cp", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
            F.transform(_blocks(F.col("norm"), block_bytes), lambda b: _hash(b, seed)).alias("hs")))
        block = norm.select(F.explode_outer(_blocks(F.col("norm"), block_bytes)).alias("block"))
        named = (_numbered(block.select(_hash(F.col("block"), seed).alias("h"), "block"), ["block"])
                 .groupBy("h.h1", "h.h2").agg(F.count("*").alias("texts"), F.min("name").alias("name")))
        named = settle(named)
        if not named.where("texts > 1").limit(1).count():
            break
        seed += 1
    state = _regroup(rows.select("rid", F.posexplode_outer("hs").alias("idx", "h"))
                     .select("rid", "idx", "h.*").join(named, ["h1", "h2"]))
    done, level = [], 0
    while True:
        done.append(state.where(F.size("names") == 1)
                    .select("rid", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        state = state.where(F.size("names") > 1)
        if not state.limit(1).count():
            break
        level += 1
        pairs = state.select("rid", F.posexplode_outer(F.transform(
            F.sequence(F.lit(0), F.ceil(F.size("names") / 2).cast("int") - 1),
            lambda i: F.struct(F.get("names", 2 * i).alias("a"),
                               F.coalesce(F.get("names", 2 * i + 1), F.lit(-1)).alias("b")))).alias("idx", "pair")
                             ).select("rid", "idx", "pair.*")
        state = _regroup(pairs.join(settle(_numbered(pairs.select("a", "b"), ["a", "b"])), ["a", "b"]))
    ids = settle(rows.drop("hs").join(reduce(DataFrame.unionByName, done), "rid"))
    keep = settle(ids.groupBy("level", "name").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("k")))
    return (ids.join(keep, ["level", "name"])
            .select("doc_id", F.col("k.doc_id").alias("keep_id"), "group_size",
                    (F.col("rid") == F.col("k.rid")).alias("kept"), F.col("sha").alias("text_sha256")))


def _regroup(named: DataFrame) -> DataFrame:
    """Names of each row in order; a list is as long as the row's own text."""
    lists = named.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("idx", "name"))).alias("l"))
    return settle(lists.select("rid", F.col("l.name").alias("names")))
