"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of falling ids. A batch's line keys, counted by document, are anti-joined
with the keys that the runs have already settled (held by enough documents), so a key found everywhere
is carried only until then; the rest becomes a run sorted by hash. Whenever a level holds ``fan_in`` runs
they are merged into one of the next level. As ids fall, the first holder of a key is the one that
keeps its lines.

Keys are compared by 128 bits (two seeds of XXH64): for 10^12 different lines the chance of any
collision is below 10^-14.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import BLANKS, ascii_lower, settle

NO_ID = -(1 << 63)


def _lines(text):
    return F.split(text, "\n", -1)


def _merged(runs: list[DataFrame]) -> DataFrame:
    return (reduce(DataFrame.unionByName, runs).groupBy("h1", "h2")
            .agg(F.sum("n").alias("n"), F.max("keep").alias("keep")))


def line_digests(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line whose key has ``min_chars`` code points: id, text hash, position, key hash."""
    key = F.transform(_lines(F.col("text")), lambda x: ascii_lower(F.btrim(x, F.lit(BLANKS))))
    keyed = F.transform(key, lambda k, i: F.when(F.length(k) >= min_chars, F.struct(
        i.alias("pos"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))))
    return (docs.select("id", F.xxhash64("text").alias("th"), F.explode_outer(keyed).alias("l"))
            .where(F.col("l").isNotNull()).select("id", "th", "l.*"))


def build_runs(digests: DataFrame, min_docs: int, n_batches: int, fan_in: int) -> DataFrame:
    """Keys held by ``min_docs`` documents and the largest id among them, through levelled runs."""
    ids = digests.agg(F.percentile_approx("id", [i / n_batches for i in range(1, n_batches)], 10000).alias("c")).first()["c"]
    cuts = sorted(set(ids or []), reverse=True)
    bounds = list(zip([None, *cuts], [*cuts, None]))
    levels: list[list[DataFrame]] = [[]]
    for above, below in bounds:
        batch = digests
        if above is not None:
            batch = batch.where(F.col("id") <= above)
        if below is not None:
            batch = batch.where(F.col("id") > below)
        new = (batch.select("h1", "h2", "id").distinct().groupBy("h1", "h2")
               .agg(F.count("*").alias("n"), F.max("id").alias("keep")))
        runs = [r for level in levels for r in level]
        if runs:
            new = new.join(_merged(runs).where(F.col("n") >= min_docs), ["h1", "h2"], "left_anti")
        levels[0].append(settle(new.sortWithinPartitions("h1", "h2")))
        for k in range(len(levels)):
            if len(levels[k]) >= fan_in:
                if k + 1 == len(levels):
                    levels.append([])
                levels[k + 1].append(settle(_merged(levels[k]).sortWithinPartitions("h1", "h2")))
                levels[k] = []
    return settle(_merged([r for level in levels for r in level]).where(F.col("n") >= min_docs))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, n_batches: int = 4,
               fan_in: int = 2) -> DataFrame:
    """All columns of ``docs`` plus ``n_lines, n_dropped, kept_text``.

    A line's key is the line stripped of blanks at both ends with A-Z lower-cased. A key of at least
    ``min_chars`` code points that stands in at least ``min_docs`` documents loses all its lines except in
    the largest ``doc_id`` holding it. Documents are told apart by ``doc_id``: rows that repeat one count as
    one holder, and each loses or keeps its own lines. A null id counts as one document below all others.
    Columns of ``docs`` with the names of the new ones are replaced. A null or empty text is one empty line; its kept text is empty. An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    own = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("id"),
                      F.coalesce(F.col("text"), F.lit("")).alias("text"))
    digests = settle(line_digests(own, min_chars))
    repeated = build_runs(digests, min_docs, n_batches, fan_in)
    drops = settle(digests.join(repeated, ["h1", "h2"]).where(F.col("id") != F.col("keep"))
                   .groupBy(F.col("id").alias("__id"), F.col("th").alias("__th"))
                   .agg(F.collect_set("pos").alias("__drops")))
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = docs.join(drops, (F.coalesce(docs["doc_id"], F.lit(NO_ID)) == F.col("__id"))
                       & (F.xxhash64(text) == F.col("__th")), "left")
    lines = joined.withColumn("__lines", F.when(F.col("__drops").isNotNull(), _lines(text)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drops"))
    kept = F.when(F.col("__drops").isNull(), text).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n"))
    return lines.select(
        *[docs[c] for c in docs.columns],
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
