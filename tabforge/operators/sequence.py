"""Ordering, top-k and per-series analysis (H1–H7).

Series are numbered with the distributed ``exact_row_number`` (range
partitioned, so a series holding a third of all rows is spread over many
tasks) on their key columns alone; whole rows are shuffled once, to meet their
results. Running aggregates are computed in fixed-size blocks of the series:
a window inside each (series, block) — bounded group size — plus a prefix over
block totals, applied recursively to the (much smaller) block table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.plans.ranking import exact_row_number, null_safe_join
from tabforge.plans.bounded import settled

_AGG = {"min": F.min, "max": F.max, "sum": F.sum}
_COMBINE = {"min": lambda a, b: F.least(a, b), "max": lambda a, b: F.greatest(a, b),
            "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}


def ranked(df: DataFrame, by: str, desc: bool = True) -> DataFrame:
    """H1: sort by a (usually aggregate) column; ties broken by the remaining columns."""
    rest = [c for c in df.columns if c != by]
    return df.orderBy(F.desc(by) if desc else F.asc(by), *rest)


def top_k(df: DataFrame, part, by: str, k: int, tie: list[str] = (), desc: bool = True,
          name: str = "rank") -> DataFrame:
    """H2: the k best rows per group.

    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so at most k rows per group and task cross the network.
    """
    parts = [part] if isinstance(part, str) else list(part)
    order = [F.desc(by) if desc else F.asc(by)] + [F.asc(t) for t in tie]
    w = Window.partitionBy(*parts).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def ordered_prefix(df: DataFrame, order_by: list, value: str, op: str, out: str, exclusive: bool = False,
                   small: int = 100_000) -> DataFrame:
    """Running min/max/sum of ``value`` over ONE global order (a table of distinct values, say).

    A table proven to hold at most ``small`` rows (bounded count) is scanned by
    one plain window; a larger one goes through the distributed numbering and
    the blocked prefix, so no task ever holds an unbounded table.
    """
    f = _AGG[op]
    if df.limit(small + 1).count() <= small:
        frame = (Window.unboundedPreceding, -1) if exclusive else (Window.unboundedPreceding, 0)
        w = Window.orderBy(*order_by).rowsBetween(*frame)
        return df.withColumn(out, f(value).over(w))
    r = exact_row_number(df.withColumn("_all", F.lit(0)), order_by, name="_i")
    r = running_agg(r, "_all", "_i", value, op, "_incl")
    if exclusive:
        prev = r.select((F.col("_i") + 1).alias("_i"), F.col("_incl").alias(out))
        r = r.join(prev, on="_i", how="left")
    else:
        r = r.withColumnRenamed("_incl", out)
    return r.drop("_all", "_i", "_incl")


def _numbered(df: DataFrame, series: str, order_by: list[str], value: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows with their key ``_k`` (series, order and value), and those key columns alone, numbered as ``_t``.

    Only the narrow side is sorted and checkpointed. A NULL inside the key equals a NULL.
    """
    keyed = df.withColumn("_k", F.struct(*dict.fromkeys([series, *order_by, *([value] if value else [])])))
    narrow = keyed.select(*dict.fromkeys([series, *([value] if value else [])]), "_k")
    return keyed, exact_row_number(narrow, ["_k"], partition_by=[series], name="_t")


def _back(keyed: DataFrame, numbered: DataFrame, *results: str) -> DataFrame:
    """The rows with ``_t`` and ``results`` of the first row of their key, and ``_i``, their place among rows of one key.

    One shuffle of the whole rows: the join on the key and the window inside it share it. Keys without a numbered
    row leave.
    """
    first = numbered.groupBy("_k").agg(F.min("_t").alias("_t"), *[F.min_by(r, "_t").alias(r) for r in results])
    same = Window.partitionBy("_k").orderBy("_k")
    return keyed.join(first, "_k").withColumn("_i", F.row_number().over(same) - 1)


def series_position(df: DataFrame, series: str, order_by: list[str], name: str = "t") -> DataFrame:
    """1-based position of each row inside its series (distributed, skew-safe); ``order_by`` names columns, ascending."""
    d = _back(*_numbered(df, series, order_by))
    return d.withColumn(name, F.col("_t") + F.col("_i")).drop("_k", "_t", "_i")


def running_agg(df: DataFrame, series: str, pos: str, value: str, op: str, out: str,
                block: int = 4096, _lvl: int = 0) -> DataFrame:
    """Inclusive running min/max/sum of ``value`` over a dense 1-based ``pos`` per series."""
    f = _AGG[op]
    max_pos = df.agg(F.max(pos)).first()[0] or 0
    if max_pos <= block:
        w = Window.partitionBy(series).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, f(value).over(w))
    blk, loc, bv, bp = (f"_blk{_lvl}", f"_loc{_lvl}", f"_bv{_lvl}", f"_bp{_lvl}")
    d = df.withColumn(blk, F.floor((F.col(pos) - 1) / block).cast("long") + 1)
    w = Window.partitionBy(series, blk).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn(loc, f(value).over(w))
    blocks = d.groupBy(series, blk).agg(f(value).alias(bv))
    prefix = running_agg(blocks, series, blk, bv, op, bp, block, _lvl + 1)
    prev = prefix.select(series, (F.col(blk) + 1).alias(blk), bp)
    d = null_safe_join(d, prev, [series, blk], "left")
    res = F.when(F.col(bp).isNull(), F.col(loc)).otherwise(_COMBINE[op](F.col(loc), F.col(bp)))
    return d.withColumn(out, res).drop(blk, loc, bp)


def ewm(df: DataFrame, series: str, order_by: list, value: str, f: float = 0.05,
        out: str = "smooth") -> DataFrame:
    """H3: s_1 = x_1, s_t = f·x_t + (1−f)·s_{t−1}, per series.

    Blocks of B rows with (1−f)^B < e^-40: inside a block the recurrence is a
    weighted running sum (weights (1−f)^-o ≤ e^40, no overflow); the carry into
    a block is the previous block's local total plus (1−f)^B times the one
    before — older terms are below 1e-34 of the carried value, under double
    precision. Groups are (series, block), so no task holds a whole series.
    """
    if not 0 < f < 1:
        raise ValueError("f must be in (0, 1)")
    a = 1.0 - f
    la = math.log(a)
    B = max(1, int(math.ceil(40.0 / -la)))
    keyed, d = _numbered(df, series, order_by, value)
    t0 = F.col("_t") - 1
    d = d.withColumn("_b", F.floor(t0 / B).cast("long")).withColumn("_o", t0 - F.col("_b") * B)
    c = F.when(F.col("_t") == 1, F.lit(1.0)).otherwise(F.lit(f))
    x = F.col(value).cast("double")
    w = Window.partitionBy(series, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_L", F.sum(c * x * F.exp(F.lit(-la) * F.col("_o"))).over(w) * F.exp(F.lit(la) * F.col("_o")))
    tot = d.groupBy(series, "_b").agg(F.sum(c * x * F.exp(F.lit(la) * (F.lit(B - 1) - F.col("_o")))).alias("_T"))
    p1 = tot.select(series, (F.col("_b") + 1).alias("_b"), F.col("_T").alias("_T1"))
    p2 = tot.select(series, (F.col("_b") + 2).alias("_b"), F.col("_T").alias("_T2"))
    d = null_safe_join(null_safe_join(d, p1, [series, "_b"], "left"), p2, [series, "_b"], "left")
    carry = F.coalesce(F.col("_T1"), F.lit(0.0)) + F.lit(a ** B) * F.coalesce(F.col("_T2"), F.lit(0.0))
    d = d.withColumn("_s", F.col("_L") + F.exp(F.lit(la) * (F.col("_o") + 1)) * carry)
    d = _back(keyed, d, "_s")
    # Rows of one key follow each other with the same value x, so s nears x by the factor 1 − f from row to row.
    x = F.coalesce(x, F.lit(0.0))
    smooth = F.when(F.col("_i") == 0, F.col("_s")).otherwise(x + (F.col("_s") - x) * F.pow(F.lit(a), F.col("_i")))
    return d.withColumns({"t": F.col("_t") + F.col("_i"), out: smooth}).drop("_k", "_t", "_i", "_s")


def diverge_cut(df: DataFrame, series: str, order_by: list, value: str, factor: float = 5.0) -> DataFrame:
    """H4: keep each series up to and including the first row with value > factor × running min."""
    keyed, d = _numbered(df, series, order_by, value)
    d = running_agg(d, series, "_t", value, "min", "_best")
    stop = d.where(F.col(value) > F.lit(factor) * F.col("_best")).groupBy(series).agg(F.min("_t").alias("_stop"))
    d = null_safe_join(d, settled(stop), [series], "left").where(F.col("_stop").isNull() | (F.col("_t") <= F.col("_stop")))
    d = _back(keyed, d, "_best", "_stop").withColumns({"t": F.col("_t") + F.col("_i"), "best": F.col("_best")})
    return d.where(F.col("_stop").isNull() | (F.col("t") <= F.col("_stop"))).drop("_k", "_t", "_i", "_best", "_stop")


def trim(df: DataFrame, series: str, order_by: list, head: int = 10, tail: int = 5) -> DataFrame:
    """H5: drop the first ``head`` and last ``tail`` rows of each series."""
    keyed, d = _numbered(df, series, order_by)
    n = d.groupBy(series).agg(F.max("_t").alias("_n"))
    d = null_safe_join(d, settled(n), [series]).where(F.col("_t") <= F.col("_n") - tail)
    d = _back(keyed, d, "_n").withColumn("t", F.col("_t") + F.col("_i"))
    return d.where((F.col("t") > head) & (F.col("t") <= F.col("_n") - tail)).drop("_k", "_t", "_i", "_n")


def best_run(df: DataFrame, run: str, step: str, loss: str, extra: list[str] = (), tie: list[str] = ()) -> DataFrame:
    """H7: the run with the lowest final loss (ties: lowest run id), with its final extras; ``tie`` orders equal steps."""
    last = df.groupBy(run).agg(F.max_by(F.struct(loss, *extra), F.struct(step, *tie)).alias("_last"))
    last = last.select(run, "_last.*")
    # Top-1 is planned as TakeOrderedAndProject: each task keeps its best row, the driver merges.
    return last.orderBy(F.asc(loss), F.asc(run)).limit(1)
