"""Set operations and key joins.

Identity is always an explicit key column joined by equality, never row
position. Join strategy is left to Catalyst/AQE: sort-merge by default,
broadcast when a side is small at run time, skewed partitions split by AQE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.plans.bounded import settled


def union_origin(train: DataFrame, test: DataFrame, origin: str = "origin",
                 tags: tuple[str, str] = ("train", "test")) -> DataFrame:
    """stack by column name, absent columns null, tagged with their origin."""
    return (train.withColumn(origin, F.lit(tags[0]))
                 .unionByName(test.withColumn(origin, F.lit(tags[1])), allowMissingColumns=True))


def split_origin(df: DataFrame, label: str, origin: str = "origin",
                 tags: tuple[str, str] = ("train", "test")) -> tuple[DataFrame, DataFrame]:
    """back into (train, test); the test side loses the label and the tag."""
    train = df.where(F.col(origin) == tags[0]).drop(origin)
    test = df.where(F.col(origin) == tags[1]).drop(origin, label)
    return train, test


def join_full(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """F3."""
    return a.join(b, on=on, how="full")


def join_left(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """F4."""
    return a.join(b, on=on, how="left")


def assign_by_key(df: DataFrame, other: DataFrame, key, cols: list[str]) -> DataFrame:
    """add columns of ``other`` (one row per key) to ``df`` by key; replaces same-named columns."""
    keys = [key] if isinstance(key, str) else list(key)
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep).join(other.select(*keys, *cols), on=keys, how="left")


def group_assign(df: DataFrame, key, col: str, agg: str = "avg", name: str | None = None) -> DataFrame:
    """attach a per-group aggregate to every row (partial aggregation + key join; hot keys are split at run time)."""
    keys = [key] if isinstance(key, str) else list(key)
    g = df.groupBy(*keys).agg(getattr(F, agg)(col).alias(name or f"{agg}_{col}"))
    return df.join(settled(g), on=keys, how="left")


def join_predictions(preds: dict[str, DataFrame], key: str, col: str = "pred") -> DataFrame:
    """one column per model, aligned by key (inner join; never positional)."""
    parts = [d.select(key, F.col(col).alias(name)) for name, d in preds.items()]
    return reduce(lambda a, b: a.join(b, on=key, how="inner"), parts)


def remainder(df: DataFrame, sample: DataFrame, key) -> DataFrame:
    """rows of ``df`` whose key is not in ``sample``."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(sample.select(*keys), on=keys, how="left_anti")


def value_sets(a: DataFrame, b: DataFrame, col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a ∩ b, a − b, b − a) of distinct non-null values."""
    da = a.where(F.col(col).isNotNull()).select(col)
    db = b.where(F.col(col).isNotNull()).select(col)
    return da.intersect(db), da.subtract(db), db.subtract(da)
