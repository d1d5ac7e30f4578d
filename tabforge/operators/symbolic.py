"""Population scoring and Pareto selection.

A whole population is scored with ONE wide aggregate per batch of formulas
(2 aggregates per formula, one scan), then reshaped to one row per formula.
The Pareto front uses a prefix minimum over distinct objective values instead
of a pairwise dominance join.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.symbolic import to_column, to_text
from tabforge.operators.sequence import ordered_prefix
from tabforge.plans.bounded import settled, ship
from tabforge.plans.ranking import exact_row_number

ship(__name__)


def score_population(df: DataFrame, formulas: list, y: str, batch: int = 50,
                     loss: str = "softplus") -> DataFrame:
    """(id, formula, correct, cross_entropy) for every formula.

    correct: count of rows where (1e-15 + sigmoid(s) > 0.5) equals the label.
    cross_entropy: mean binary cross-entropy of sigmoid(s) ("softplus" form,
    overflow-free; "literal" follows the stable-sigmoid formula as written).
    """
    yy = F.col(y).cast("double")
    parts = []
    for start in range(0, len(formulas), batch):
        chunk = formulas[start:start + batch]
        aggs = []
        # A projection of its own keeps each formula from being inlined into every expression that uses it.
        scored = df.select(yy.alias("_y"), *[to_column(t).cast("double").alias(f"_f{j}") for j, t in enumerate(chunk)])
        for j, t in enumerate(chunk):
            s, yy_ = F.col(f"_f{j}"), F.col("_y")
            pred = ((F.lit(1e-15) + 1.0 / (1.0 + F.exp(-s))) > 0.5).cast("double")
            aggs.append(F.sum((pred == yy_).cast("long")).alias(f"c{j}"))
            if loss == "softplus":
                ce = F.avg(F.greatest(s, F.lit(0.0)) + F.log1p(F.exp(-F.abs(s))) - yy_ * s)
            else:
                p = F.when(s >= 0, 1.0 / (1.0 + F.exp(-s))).otherwise(F.exp(s) / (1.0 + F.exp(s)))
                ce = -F.avg(yy_ * F.ln(p) + (1 - yy_) * F.ln(1 - p))
            aggs.append(ce.alias(f"e{j}"))
        row = scored.agg(*aggs)
        structs = [F.struct(F.lit(start + j).alias("id"), F.lit(to_text(t)).alias("formula"),
                            F.col(f"c{j}").alias("correct"), F.col(f"e{j}").alias("cross_entropy"))
                   for j, t in enumerate(chunk)]
        parts.append(row.select(F.inline(F.array(*structs))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pareto_front(df: DataFrame, maximize: str, minimize: str) -> DataFrame:
    """Rows not dominated on (maximize ↑, minimize ↓); equal points do not dominate each other.

    A row is on the front iff its ``minimize`` value is the lowest among rows
    with the same ``maximize`` value and strictly below the lowest among rows
    with a larger ``maximize`` value (prefix minimum over the distinct
    ``maximize`` values in descending order; distributed when that table is large).
    """
    per = df.groupBy(maximize).agg(F.min(minimize).alias("_best"))
    r = ordered_prefix(per, [F.desc(maximize)], "_best", "min", "_before", exclusive=True)
    j = df.join(r.select(maximize, "_best", "_before"), on=maximize, how="inner")
    on_front = (F.col(minimize) == F.col("_best")) & (F.col("_before").isNull() | (F.col(minimize) < F.col("_before")))
    return j.where(on_front).drop("_best", "_before")


def _front_numbers(values: np.ndarray, heads: list[float]) -> np.ndarray:
    """Fronts of points in order (best ``maximize`` first); ``heads`` holds each front's least ``minimize`` so far, rising."""
    out = np.empty(len(values), np.int64)
    for k, v in enumerate(values.tolist()):
        f = bisect_right(heads, v)  # every front whose head is not above v has a point that dominates this one
        heads[f:f + 1] = [v]
        out[k] = f + 1
    return out


def pareto_rank(df: DataFrame, key: str, maximize: str, minimize: str, block_rows: int = 200_000) -> DataFrame:
    """Non-dominated sorting: all fronts in one sort; column ``front``, from 1.

    Distinct points are sorted by (maximize falling, minimize rising), so only earlier points dominate later ones, and a
    point's front is the one behind the last whose least ``minimize`` is not above its own: a binary search in the
    heads of the fronts, which stay sorted. Blocks of ``block_rows`` points are passed through in order, a task each; only
    the heads, one number per front, go from one block to the next. Equal points share a front. ``key`` is not
    needed for it, but a NULL key, or a NULL or NaN objective, raises: such a row is on no front.
    """
    x, v = F.col(maximize), F.col(minimize)
    bad = F.col(key).isNull() | x.isNull() | v.isNull() | F.isnan(x.cast("double")) | F.isnan(v.cast("double"))
    if df.where(bad).limit(1).count():
        raise ValueError("NULL key or objective")
    points = df.select(x.alias("_x"), v.alias("_v")).distinct()
    points = settled(exact_row_number(points, [F.desc("_x"), "_v"], name="_at").withColumn("_block", F.expr(f"(_at - 1) div {block_rows}")))
    heads: list[float] = []
    done = None
    for b in range(-(-points.count() // block_rows)):
        now = list(heads)

        def pass_through(batch: pa.Table) -> pa.Table:
            batch = batch.sort_by("_at")
            mine = list(now)
            fronts = _front_numbers(batch.column("_w").to_numpy(), mine)
            return pa.table({"_x": batch.column("_x"), "_v": batch.column("_v"), "front": pa.array(fronts, pa.int64()),
                             "_head": pa.array(np.where(batch.column("_w").to_numpy() == np.array(mine)[fronts - 1], fronts, 0), pa.int64())})
        block = points.where(F.col("_block") == b).select("_x", "_v", "_at", "_block", F.col("_v").cast("double").alias("_w"))
        kinds = dict(points.dtypes)
        ranked = settled(block.groupBy("_block").applyInArrow(pass_through, f"_x {kinds['_x']}, _v {kinds['_v']}, front long, _head long"))
        for r in ranked.where("_head > 0").groupBy("_head").agg(F.min(F.col("_v").cast("double")).alias("v")).orderBy("_head").collect():
            heads[r["_head"] - 1:r["_head"]] = [r["v"]]
        ranked = ranked.select("_x", "_v", F.col("front").cast("int").alias("front"))
        done = ranked if done is None else done.unionByName(ranked)
    if done is None:
        return df.withColumn("front", F.lit(None).cast("int"))
    return df.join(settled(done), (x == F.col("_x")) & (v == F.col("_v"))).drop("_x", "_v")
