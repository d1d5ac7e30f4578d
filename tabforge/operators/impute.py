"""Imputation (I1–I6): column mean and exact k-nearest-neighbour imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators.neighbors import knn
from tabforge.plans.bounded import settled


def impute_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill nulls with the column mean (one aggregate, means enter as literals)."""
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(means[c])) for c in cols})


def knn_impute(df: DataFrame, key: str, target: str, features: list[str], k: int = 5, clip: bool = True,
               categorical: bool = False, vote: bool = False, metric: str = "mean_sq",
               out: str | None = None) -> DataFrame:
    """Fill ``target`` from the k nearest rows that have it.

    Distance: mean squared difference over ``features``; neighbours ordered by
    (distance, key); estimate = Σ w·v / Σ w with w = 1 / max(d, 1e-6); clipped
    to the observed [min, max] of the target. ``categorical``: the weighted mean
    is truncated to an integer (reference behaviour); ``vote``: the value with
    the largest total weight wins (ties: smaller value).
    """
    out = out or target
    df = settled(df)  # its joins and broadcasts run once, not for donors, queries, bounds and result
    donors = df.where(F.col(target).isNotNull())
    recips = df.where(F.col(target).isNull())
    nb = knn(recips, donors.withColumnRenamed(key, "_dkey"), features, k, key, "_dkey", target, metric=metric)
    w = 1.0 / F.greatest(F.col("dist"), F.lit(1e-6))
    if vote:
        tally = nb.groupBy(key, target).agg(F.sum(w).alias("_w"))
        est = tally.groupBy(key).agg(F.max_by(target, F.struct(F.col("_w"), -F.col(target))).alias("_est"))
    else:
        est = nb.groupBy(key).agg((F.sum(w * F.col(target)) / F.sum(w)).alias("_est"))
    if clip and not vote:
        lo, hi = donors.agg(F.min(target), F.max(target)).first()
        est = est.withColumn("_est", F.least(F.greatest(F.col("_est"), F.lit(lo)), F.lit(hi)))
    if categorical and not vote:
        est = est.withColumn("_est", F.col("_est").cast("long"))
    j = df.join(est.hint("merge"), on=key, how="left")
    filled = F.coalesce(F.col(target), F.col("_est").cast(df.schema[target].dataType))
    if out == target:
        return j.withColumn(target, filled).drop("_est")
    return j.withColumn(out, filled).drop("_est")


def imputation_report(before: DataFrame, after: DataFrame, key: str, col: str) -> DataFrame:
    """Original vs imputed value for the rows that were missing."""
    b = before.where(F.col(col).isNull()).select(key)
    return b.join(after.select(key, F.col(col).alias("imputed")), on=key, how="inner")


def imputation_range(before: DataFrame, after: DataFrame, col: str) -> DataFrame:
    """min/mean/max before → after (one aggregate per side)."""
    a = before.agg(F.min(col).alias("min_before"), F.avg(col).alias("mean_before"), F.max(col).alias("max_before"))
    b = after.agg(F.min(col).alias("min_after"), F.avg(col).alias("mean_after"), F.max(col).alias("max_after"))
    ra, rb = a.first(), b.first()
    return before.sparkSession.createDataFrame([tuple(ra) + tuple(rb)], a.columns + b.columns)


def assert_no_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    """Remaining null count per column (all zeros when imputation succeeded)."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols])))
