"""Discretisation and encoding.

Bins are ``when`` ladders over literal edges (edges are bounded statistics
computed once); codes for small domains are literal maps, and for large
domains a distributed code table joined back on the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.columns import map_values
from tabforge.plans.bounded import BoundExceeded, bounded_values, checked_broadcast, settled
from tabforge.plans.ranking import exact_quantiles, exact_row_number


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _fmt(x) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


# E1 ------------------------------------------------------------------------
def floor_bin(col, width: int, offset: int = 0) -> Column:
    """floor(int(x) / width) + offset (x truncated toward zero first)."""
    return (F.floor(_c(col).cast("int") / F.lit(width)) + F.lit(offset)).cast("int")


# E2 ------------------------------------------------------------------------
def width_bin(col, width: float, offset: int = 0) -> Column:
    """int(x / width) + offset, truncation toward zero."""
    return (_c(col) / F.lit(width)).cast("int") + F.lit(offset)


# E3 ------------------------------------------------------------------------
def cut_expr(col, edges: list[float], labels: list | None = None, include_lowest: bool = False) -> Column:
    """Right-closed bins (a, b]; outside → null; labels default 'a-b'."""
    c = _c(col)
    labels = labels or [f"{_fmt(a)}-{_fmt(b)}" for a, b in zip(edges[:-1], edges[1:])]
    expr = None
    for i, (a, b, lab) in enumerate(zip(edges[:-1], edges[1:], labels)):
        lower = (c >= a) if (include_lowest and i == 0) else (c > a)
        cond = lower & (c <= b)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def cut(df: DataFrame, c: str, edges: list[float], labels: list | None = None, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{c}_bin", cut_expr(c, edges, labels))


# E4 ------------------------------------------------------------------------
def range_edges(df: DataFrame, c: str, step: int) -> list[int]:
    """arange(int(min), int(max) + step, step) from one min/max aggregate."""
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    lo, hi = int(lo), int(hi)
    return list(range(lo, hi + step, step))


# E5 ------------------------------------------------------------------------
def qcut_edges(df: DataFrame, c: str, q: int) -> list[float]:
    """q+1 linear-interpolated quantile edges; duplicate edges raise (pandas rule)."""
    probs = [i / q for i in range(q + 1)]
    rows = exact_quantiles(df, [c], probs).collect()  # q+1 rows
    edges = [r["value"] for r in sorted(rows, key=lambda r: r["p"])]
    if len(set(edges)) != len(edges):
        raise ValueError(f"bin edges must be unique: {edges}")
    return edges


def qcut(df: DataFrame, c: str, q: int, labels: list | None = None, name: str | None = None) -> DataFrame:
    """Equal-frequency bins labelled 1..q: right-closed, lowest edge included."""
    edges = qcut_edges(df, c, q)
    labels = labels or list(range(1, q + 1))
    return df.withColumn(name or f"{c}_q", cut_expr(c, edges, labels, include_lowest=True))


# E6 ------------------------------------------------------------------------
def cat_codes(df: DataFrame, c: str, offset: int = 0, name: str | None = None,
              max_inline: int = 10000) -> DataFrame:
    """Dense 0-based codes of the sorted distinct values, null → −1, then + offset.

    Small domains become a literal map in the plan; larger ones a code table
    (distributed exact numbering of the distinct values) joined back on the
    value, broadcast only when its size is checked to be small.
    """
    name = name or f"{c}_code"  # an int however many values there are
    try:
        dom = bounded_values(df, c, max_inline)
        code = map_values(F.col(c), {v: i for i, v in enumerate(dom)})
        return df.withColumn(name, F.coalesce(code, F.lit(-1)) + F.lit(offset))
    except BoundExceeded:
        pass
    d = df.select(c).where(F.col(c).isNotNull()).distinct()
    table = exact_row_number(d, [c], name="_code").select(c, (F.col("_code") - 1).cast("int").alias("_code"))
    j = df.join(checked_broadcast(table, 1_000_000), on=c, how="left")
    return j.withColumn(name, F.coalesce(F.col("_code"), F.lit(-1)) + F.lit(offset)).drop("_code")


def _free(label: str, taken) -> str:
    """``label``, with as many underscores behind it as set it apart from the values ``taken``."""
    taken = set(taken)
    while label in taken:
        label += "_"
    return label


# E7 / E8 -------------------------------------------------------------------
def get_dummies(df: DataFrame, c: str, prefix: str | None = None, values: list | None = None,
                max_values: int = 1000, min_fraction: float | None = None, max_card: int | None = None,
                other: str = "other", drop: bool = True) -> DataFrame:
    """One 0/1 column ``<prefix>_<value>`` per value (sorted); null → all zeros.

    ``min_fraction``: values rarer than this share of rows are pooled into
    ``other`` first (``other_`` if a frequent value has that name). ``max_card``: a column with more distinct values passes
    through unchanged.
    """
    prefix = prefix or c
    src = F.col(c)
    if min_fraction is not None or max_card is not None:
        vc = df.where(src.isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        n_total = df.count()
        stats = vc.limit(max_values + 1).collect()
        if max_card is not None and len(stats) > max_card:
            return df
        if len(stats) > max_values:
            raise BoundExceeded(f"{c}: more than {max_values} values")
        if min_fraction is not None:
            keep = sorted(r[c] for r in stats if r["n"] / n_total >= min_fraction)
            rare = any(r["n"] / n_total < min_fraction for r in stats)
            other = _free(other, map(str, keep))
            src = F.when(src.isNull(), F.lit(None)).when(src.isin(keep), src.cast("string")).otherwise(F.lit(other))
            values = sorted([str(v) for v in keep] + ([other] if rare else []))
    if values is None:
        values = bounded_values(df, c, max_values)
    cols = {f"{prefix}_{v}": F.coalesce((src == F.lit(v)).cast("int"), F.lit(0)) for v in values}
    out = df.withColumns(cols)
    return out.drop(c) if drop else out


def one_hot_sparse(df: DataFrame, c: str, name: str | None = None, min_fraction: float | None = None,
                   other: str = "other", vector: bool = False) -> tuple[DataFrame, DataFrame]:
    """One-hot encoding for any number of values, and the table of its values ``code, value, pooled, n``.

    The column ``name`` is ``struct<size, indices, values>``: as many slots as the table has rows, a 1 at the value's
    code, or no entry for a null. With ``vector`` it is a sparse ML vector instead. Codes follow the sorted values.
    ``min_fraction``: values in a smaller share of all rows (nulls included) have one slot together, behind the
    others, called ``other`` and told apart from a value of that name by ``pooled``.
    """
    name = name or f"{c}_onehot"
    counts = settled(df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    if min_fraction is not None:
        counts = counts.withColumn("_rare", F.col("_n") < F.lit(min_fraction * df.count()))
    else:
        counts = counts.withColumn("_rare", F.lit(False))
    kept = exact_row_number(counts.where("not _rare"), ["_v"], name="_code").withColumn("_code", (F.col("_code") - 1).cast("int"))
    rare = counts.where("_rare")
    n_kept = kept.count()
    pool = rare.agg(F.sum("_n").alias("n")).where("n is not null")
    table = kept.select(F.col("_code").alias("code"), F.col("_v").cast("string").alias("value"), F.lit(False).alias("pooled"), F.col("_n").alias("n")).unionByName(
        pool.select(F.lit(n_kept).alias("code"), F.lit(other).alias("value"), F.lit(True).alias("pooled"), "n"))
    codes = settled(kept.select("_v", "_code").unionByName(rare.select("_v", F.lit(n_kept).alias("_code"))))
    size = n_kept + pool.count()
    out = df.join(checked_broadcast(codes, 1_000_000), F.col(c) == F.col("_v"), "left").drop("_v")
    if vector:
        # Codes of nulls lie behind the last slot, which the encoder drops.
        return _encode(out.withColumn("_code", F.coalesce(F.col("_code"), F.lit(size)).cast("double")), size, name).drop("_code"), table
    hot = F.col("_code").isNotNull()
    value = F.struct(F.lit(size).alias("size"), F.when(hot, F.array("_code")).otherwise(F.array().cast("array<int>")).alias("indices"),
                     F.when(hot, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"))
    return out.withColumn(name, value).drop("_code"), table


def _encode(df: DataFrame, size: int, name: str) -> DataFrame:
    from pyspark.ml.feature import OneHotEncoder
    spark = df.sparkSession
    widest = spark.createDataFrame([(float(size),)], "_code double")  # one code more than slots, so the size doesn't depend on the rows
    return OneHotEncoder(inputCols=["_code"], outputCols=[name], dropLast=True).fit(widest).transform(df)


# E9 ------------------------------------------------------------------------
def ordinal(col, mapping: dict, strict: bool = True) -> Column:
    return map_values(col, mapping, strict=strict)
