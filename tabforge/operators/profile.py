"""Profiling (B1–B18): one wide aggregate per question, reshaped to long form.

Every per-column statistic is computed in a single ``agg`` over the table (one
scan, partial aggregation before the shuffle) and then turned into rows with
``inline`` — never one job per column.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.plans.ranking import exact_quantiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def _long_form(row_df: DataFrame, items: list[tuple[str, dict[str, Column]]]) -> DataFrame:
    """Turn a one-row aggregate into one row per column via inline(array(struct))."""
    structs = [F.struct(F.lit(name).alias("column"), F.lit(pos).alias("position"),
                        *[v.alias(k) for k, v in fields.items()])
               for pos, (name, fields) in enumerate(items)]
    return row_df.select(F.inline(F.array(*structs)))


def shape(df: DataFrame) -> DataFrame:
    """B1: (n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def info(df: DataFrame) -> DataFrame:
    """B2: per column its Spark type and non-null count."""
    row = df.agg(*[F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    items = [(f.name, {"dtype": F.lit(f.dataType.simpleString()), "non_null": F.col(f"_c{i}")})
             for i, f in enumerate(df.schema.fields)]
    return _long_form(row, items)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, position, null_count)."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    return _long_form(row, [(c, {"null_count": F.col(f"_c{i}")}) for i, c in enumerate(df.columns)])


def null_profile(df: DataFrame) -> DataFrame:
    """Null percentage per column, only columns that have nulls; an empty table has none."""
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    items = [(c, {"null_pct": F.try_divide(F.col(f"_c{i}") * 100.0, F.col("_n"))}) for i, c in enumerate(df.columns)]
    structs = [F.struct(F.lit(name).alias("column"), *[v.alias(k) for k, v in fields.items()])
               for name, fields in items]
    return row.select(F.inline(F.array(*structs))).where(F.col("null_pct") > 0)


def null_profile_compare(df1: DataFrame, df2: DataFrame, left: str = "null_pct_1",
                         right: str = "null_pct_2") -> DataFrame:
    """Null profiles of two tables side by side, full outer join on column name."""
    a = null_profile(df1).withColumnRenamed("null_pct", left)
    b = null_profile(df2).withColumnRenamed("null_pct", right)
    return a.join(b, on="column", how="full")


def nunique(df: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct non-null values per column (exact, or HyperLogLog++ when ``approx``)."""
    fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    row = df.agg(*[fn(F.col(c)).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    return _long_form(row, [(c, {"n_distinct": F.col(f"_c{i}")}) for i, c in enumerate(df.columns)])


def rows_per_class(df: DataFrame) -> DataFrame:
    """Mean rows per distinct value = count(*) / count(distinct c)."""
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_distinct(F.col(c)).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    return _long_form(row, [(c, {"rows_per_value": F.try_divide(F.col("_n").cast("double"), F.col(f"_c{i}"))})
                            for i, c in enumerate(df.columns)])


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (linear interpolation), max.

    Moments come from one aggregate; quartiles from the distributed exact
    ranking in ``exact_quantiles`` (no single task holds a value set).
    """
    cols = cols or numeric_columns(df)
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(c).alias(f"_n{i}"), F.avg(c).alias(f"_m{i}"), F.stddev_samp(c).alias(f"_s{i}"),
        F.min(F.col(c).cast("double")).alias(f"_lo{i}"), F.max(F.col(c).cast("double")).alias(f"_hi{i}"))])
    moments = _long_form(row, [(c, {"count": F.col(f"_n{i}"), "mean": F.col(f"_m{i}"),
                                    "std": F.col(f"_s{i}"), "min": F.col(f"_lo{i}"),
                                    "max": F.col(f"_hi{i}")}) for i, c in enumerate(cols)])
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    qw = q.groupBy("column").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q25"),
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("q50"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q75"))
    return moments.join(F.broadcast(qw), on="column", how="left")


def unique(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column, null included."""
    return df.select(col).distinct()


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Frequencies of non-null values, most frequent first (ties by value)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
              .orderBy(F.desc(name), F.asc(col)))


def range_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Min / mean / max of non-null values per column."""
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.min(F.col(c).cast("double")).alias(f"_a{i}"), F.avg(c).alias(f"_b{i}"),
        F.max(F.col(c).cast("double")).alias(f"_c{i}"))])
    return _long_form(row, [(c, {"min": F.col(f"_a{i}"), "mean": F.col(f"_b{i}"), "max": F.col(f"_c{i}")})
                            for i, c in enumerate(cols)])


def head(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """First n rows by an explicit order (top-k; Spark plans TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n)


def tail(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """Last n rows by an explicit order."""
    return df.orderBy(*[F.desc(c) for c in order_by]).limit(n)


def value_overlap(df1: DataFrame, df2: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values of ``col`` tagged both / only_left / only_right."""
    a = df1.where(F.col(col).isNotNull()).select(col).distinct().withColumn("_l", F.lit(True))
    b = df2.where(F.col(col).isNotNull()).select(col).distinct().withColumn("_r", F.lit(True))
    j = a.join(b, on=col, how="full")
    side = (F.when(F.col("_l") & F.col("_r"), "both")
             .when(F.col("_l"), "only_left").otherwise("only_right"))
    return j.select(col, side.alias("side"))


def assert_same_nulls(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per shared column, null counts before/after and whether they match."""
    na = null_counts(a).select("column", F.col("null_count").alias("before"))
    nb = null_counts(b).select("column", F.col("null_count").alias("after"))
    return na.join(nb, "column", "full").withColumn("same", F.col("before") == F.col("after"))


def downcast_report(df: DataFrame, cols: list[str], lo: int = 0, hi: int = 255) -> DataFrame:
    """Per column min/max and whether every value fits [lo, hi] (one agg)."""
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.min(c).alias(f"_a{i}"), F.max(c).alias(f"_b{i}"))])
    return _long_form(row, [(c, {"min": F.col(f"_a{i}").cast("double"), "max": F.col(f"_b{i}").cast("double"),
                                 "fits": (F.col(f"_a{i}") >= lo) & (F.col(f"_b{i}") <= hi)})
                            for i, c in enumerate(cols)])


def downcast(df: DataFrame, cols: list[str], lo: int = 0, hi: int = 255,
             to: str = "smallint") -> DataFrame:
    """Cast the columns whose range fits [lo, hi] (Spark has no unsigned byte)."""
    rep = downcast_report(df, cols, lo, hi).where("fits").select("column").collect()  # ≤ len(cols) rows
    fit = {r["column"] for r in rep}
    return df.select(*[F.col(c).cast(to).alias(c) if c in fit else F.col(c) for c in df.columns])


def matrix_check(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column NaN-or-null count, max, min, number of distinct values."""
    cols = cols or numeric_columns(df)
    def bad(c):
        dt = df.schema[c].dataType
        isnan = F.isnan(c) if isinstance(dt, (T.FloatType, T.DoubleType)) else F.lit(False)
        return F.count_if(F.col(c).isNull() | isnan)
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        bad(c).alias(f"_a{i}"), F.max(F.col(c).cast("double")).alias(f"_b{i}"),
        F.min(F.col(c).cast("double")).alias(f"_c{i}"), F.count_distinct(c).alias(f"_d{i}"))])
    return _long_form(row, [(c, {"n_missing": F.col(f"_a{i}"), "max": F.col(f"_b{i}"),
                                 "min": F.col(f"_c{i}"), "n_distinct": F.col(f"_d{i}")})
                            for i, c in enumerate(cols)])
