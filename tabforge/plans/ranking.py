"""Exact, distributed row numbering and quantiles.

``row_number() over (order by ...)`` without a partition, or partitioned by a
key with few values (a 0/1 label), puts every row of a group into one task.
Here the data is range-partitioned on (group, order) instead, rows are numbered
inside each range partition, and each partition learns its offset from a tiny
table of per-partition counts. The numbered data is checkpointed to the shared
checkpoint folder first, so the counts and the rows always describe the same
partitioning, even if an executor is lost and work is retried.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.plans.bounded import checked_broadcast
from tabforge.session import ensure_checkpoint_dir


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on equally named columns in which NULL meets NULL; the left side's columns stay."""
    tmp = {c: f"_{i}_on_{c}" for i, c in enumerate(on)}
    right = right.withColumnsRenamed(tmp)
    cond = [left[c].eqNullSafe(right[t]) for c, t in tmp.items()]
    return left.join(right, cond, how).drop(*tmp.values())


def exact_row_number(df: DataFrame, order_by, partition_by=(), name: str = "rn",
                     num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = row_number() over (partition by P order by O), 1-based.

    ``order_by`` must make the order total (end it with a key) for a result
    that does not depend on the input layout.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    part = list(partition_by)
    keys = _cols(part) + _cols(order_by)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n, *keys)
                .sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    stats = tagged.groupBy("_pid", *part).agg(F.count(F.lit(1)).alias("_n"),
                                              F.min("_mid").alias("_first"))
    before = Window.partitionBy(*part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # Without group columns the stats table has one row per range partition; with few groups it is small as well, and the
    # rows are not shuffled again.
    stats = stats.drop("_n")
    stats = F.broadcast(stats) if not part else checked_broadcast(stats, 1 << 17)
    out = null_safe_join(tagged, stats, ["_pid", *part])
    out = out.withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("long"))
    return out.drop("_pid", "_mid", "_first", "_off")


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], accuracy: int = 5000,
                    max_collect: int = 100000, max_levels: int = 4) -> DataFrame:
    """Linear-interpolated quantiles (pandas ``quantile`` / SQL ``quantile_cont``), exact.

    Returns one row per (column, p): ``column``, ``p``, ``value``.
    A scan counts rows and proposes two values around every needed rank. A second one counts the rows below and up to
    each proposed value: a rank between those two counts is that value, however many rows share it, and any other rank
    lies strictly between two counted values. Such gaps are read back as (value, count) pairs once they hold
    ``max_collect`` rows together; wider ones get new proposals from a sketch of the gap alone. What lies strictly
    between two proposals is bounded by the sketch's error (about 8 rows in ``accuracy``), so a level divides a gap by
    hundreds whatever the ties. Targets still open after ``max_levels`` fall back to the distributed rank
    (``rank_quantiles``).
    """
    xs = {c: F.col(c).cast("double") + F.lit(0.0) for c in cols}  # -0.0 is 0.0
    valid = {c: xs[c].isNotNull() & ~F.isnan(xs[c]) for c in cols}
    delta = 3.0 / accuracy

    def inside(c, lo, hi):
        cond = valid[c]
        if lo is not None:
            cond = cond & (xs[c] > F.lit(lo))
        if hi is not None:
            cond = cond & (xs[c] < F.lit(hi))
        return cond

    # One sketch per column, asked for a bracket (p − δ, p + δ) around every quantile.
    first = df.agg(*[F.count_if(valid[c]).alias(f"n{i}") for i, c in enumerate(cols)],
                   *[F.percentile_approx(F.when(valid[c], xs[c]),
                                         [q for p in probs for q in (max(0.0, p - delta), min(1.0, p + delta))],
                                         accuracy).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    n = {c: first[f"n{i}"] for i, c in enumerate(cols)}
    gap, proposal, found = {}, {}, {}  # gap: (lo, hi, first rank, end) of what lies strictly between lo and hi
    for i, c in enumerate(cols):
        for j, p in enumerate(probs if n[c] else []):
            for r in (math.floor(p * (n[c] - 1)), math.ceil(p * (n[c] - 1))):
                gap[(c, r)] = (None, None, 0, n[c])
                proposal[(c, r)] = (first[f"b{i}"][2 * j], first[f"b{i}"][2 * j + 1])
    targets = sorted(gap)
    for level in range(max_levels + 1):
        open_t = [t for t in targets if t not in found]
        if not open_t:
            break
        points = sorted({(t[0], v) for t in open_t for v in proposal[t]})
        counts = df.agg(*[e for i, (c, v) in enumerate(points) for e in (
            F.count_if(xs[c] < F.lit(v)).alias(f"u{i}"), F.count_if(xs[c] <= F.lit(v)).alias(f"e{i}"))]).first()
        counts = {point: (counts[f"u{i}"], counts[f"e{i}"]) for i, point in enumerate(points)}
        for c, r in open_t:
            lo, hi, start, end = gap[(c, r)]
            for v in sorted(set(proposal[(c, r)])):
                under, upto = counts[(c, v)]
                if r < under:
                    hi, end = v, under
                    break
                if r < upto:
                    found[(c, r)] = v
                    break
                lo, start = v, upto
            gap[(c, r)] = (lo, hi, start, end)
        spans: dict = {}
        for t in open_t:
            if t not in found:
                spans.setdefault((t[0], *gap[t]), []).append(t)
        ready, budget = [], 0
        for span in sorted(spans, key=lambda s: s[4] - s[3]):
            budget += span[4] - span[3]
            if budget <= max_collect:
                ready.append(span)
        if ready:
            held = [inside(c, lo, hi) for c, lo, hi, _, _ in ready]
            items = [F.when(cond, F.struct(F.lit(i).alias("t"), xs[span[0]].alias("v"))) for i, (cond, span) in enumerate(zip(held, ready))]
            pairs = (df.where(reduce(lambda a, b: a | b, held)).select(F.explode(F.array(*items)).alias("s")).where(F.col("s").isNotNull())
                       .groupBy("s.t", "s.v").agg(F.count(F.lit(1)).alias("k")).collect())
            vals: dict = {}
            for row in pairs:
                vals.setdefault(row["t"], []).append((row["v"], row["k"]))
            for i, span in enumerate(ready):
                acc, wanted = span[3], sorted(spans.pop(span))
                for v, k in sorted(vals.get(i, [])):
                    acc += k
                    while wanted and acc > wanted[0][1]:
                        found[wanted.pop(0)] = v
        if not spans or level == max_levels:
            break
        # New proposals for the other gaps, each from a sketch of its own rows.
        asked = list(spans.items())
        aggs = []
        for i, ((c, lo, hi, start, end), ts) in enumerate(asked):
            size, d = end - start, 2.0 * (end - start) / accuracy + 1
            qs = [q for _, r in ts for q in (max(0.0, (r - start - d) / size), min(1.0, (r - start + d + 1) / size))]
            aggs.append(F.percentile_approx(F.when(inside(c, lo, hi), xs[c]), qs, accuracy).alias(f"b{i}"))
        sketch = df.agg(*aggs).first()
        for i, (_, ts) in enumerate(asked):
            for j, t in enumerate(ts):
                proposal[t] = (sketch[f"b{i}"][2 * j], sketch[f"b{i}"][2 * j + 1])
    rest = sorted({c for (c, r) in targets if (c, r) not in found})
    rows = []
    for c in cols:
        if not n[c] or c in rest:
            continue
        for p in probs:
            pos = p * (n[c] - 1)
            lo_v, hi_v = found[(c, math.floor(pos))], found[(c, math.ceil(pos))]
            rows.append((c, float(p), lo_v + (pos - math.floor(pos)) * (hi_v - lo_v)))
    out = df.sparkSession.createDataFrame(rows, "column string, p double, value double")
    if rest:
        out = out.unionByName(rank_quantiles(df, rest, probs))
    return out


def rank_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Exact quantiles by a distributed rank of every value (one range-partitioned sort, checkpointed)."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("s")).select("s.*").where(F.col("value").isNotNull() & ~F.isnan("value"))
    ranked = exact_row_number(stacked, ["value"], partition_by=["column"], name="rn")
    counts = ranked.groupBy("column").agg(F.max("rn").alias("n"))
    targets = counts.select("column", "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    targets = targets.withColumn("pos", F.col("p") * (F.col("n") - 1))
    targets = (targets.withColumn("lo", F.floor("pos").cast("long") + 1)
                      .withColumn("hi", F.ceil("pos").cast("long") + 1))
    picks = targets.select("column", "p", "pos", F.explode(F.array("lo", "hi")).alias("rn")).distinct()
    vals = ranked.join(F.broadcast(picks), on=["column", "rn"], how="inner")
    agg = vals.groupBy("column", "p", "pos").agg(
        F.min_by("value", "rn").alias("v_lo"), F.max_by("value", "rn").alias("v_hi"))
    frac = F.col("pos") - F.floor("pos")
    return agg.select("column", "p", (F.col("v_lo") + frac * (F.col("v_hi") - F.col("v_lo"))).alias("value"))
