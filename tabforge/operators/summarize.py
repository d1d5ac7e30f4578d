"""Grouped label rates and distribution summaries.

All are single ``groupBy().agg()`` plans: Spark aggregates partially on the
map side, so a hot group costs one partial row per task, not a hot task.
Statistics needed by a later expression (min/max, std) come from a one-row
aggregate that is broadcast by construction.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.plans.bounded import settled, ship
from tabforge.plans.ranking import exact_quantiles, null_safe_join

ship(__name__)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def group_count(df: DataFrame, key, y: str, name: str = "n") -> DataFrame:
    """G1: non-null target count per group, largest first."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(y).alias(name)).orderBy(F.desc(name), *keys)


def group_rate(df: DataFrame, key, y: str, name: str = "rate") -> DataFrame:
    """Mean target per group, highest first."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.avg(y).alias(name)).orderBy(F.desc(name), *keys)


def group_report(df: DataFrame, key, y: str, means: list[str] = (), pct: bool = True) -> DataFrame:
    """Rate (×100), label count, row count and means of other columns, one aggregate."""
    keys = [key] if isinstance(key, str) else list(key)
    rate = F.avg(y) * (100.0 if pct else 1.0)
    return df.groupBy(*keys).agg(rate.alias("rate_pct" if pct else "rate"), F.count(y).alias("n_label"),
                                 F.count(F.lit(1)).alias("n_rows"),
                                 *[F.avg(m).alias(f"avg_{m}") for m in means])


def cross_count(df: DataFrame, k1: str, k2: str, pivot_values: list | None = None) -> DataFrame:
    """Counts by (k1, k2); long form, or pivoted on k2 when its values are given."""
    if pivot_values is not None:
        return df.groupBy(k1).pivot(k2, pivot_values).count()
    return df.groupBy(k1, k2).agg(F.count(F.lit(1)).alias("n"))


def rate_ci(df: DataFrame, key, y: str, z: float = 1.96) -> DataFrame:
    """Mean and normal-approximation interval per group."""
    keys = [key] if isinstance(key, str) else list(key)
    g = df.groupBy(*keys).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("_s"), F.count(y).alias("n"))
    half = F.lit(z) * F.col("_s") / F.sqrt(F.col("n"))
    return g.select(*keys, "mean", "n", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


# Shares of a Poisson(1) variable at most 0, 1, ... 7 in steps of 2**-16.
POISSON_STEPS = [24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535]


def rate_ci_bootstrap(df: DataFrame, key: str, y: str, row_key: str, b: int = 200,
                      seed: int = 0) -> DataFrame:
    """G5 (bootstrap form): mean of B Poisson(1) resamples per group, 2.5 and 97.5 % quantiles ``lo, hi``.

    A row's weights are read from md5('seed#row key#i'), eight of 16 bits each for i = 0, 1, ...: the same on any
    cluster. No row is copied: every task adds its rows' weights up into one array of B sums per group, and Spark adds
    the tasks' arrays. A resample without any row of a group is left out of its quantiles. NULL targets are left out.
    """
    digests = F.concat(*[F.unhex(F.md5(F.concat(F.lit(f"{seed}#"), F.col(row_key).cast("string"), F.lit(f"#{i}")))) for i in range(-(-b // 8))])
    rows = df.where(F.col(y).isNotNull()).select(F.col(key).alias("k"), F.col(y).cast("double").alias("y"), digests.alias("d"))
    kind = dict(rows.dtypes)["k"]

    def add_up(batches):
        sums: dict = {}
        for batch in batches:
            bits = np.frombuffer(b"".join(batch.column("d").to_pylist()), ">u2").reshape(batch.num_rows, -1)[:, :b]
            weight = np.searchsorted(POISSON_STEPS, bits, side="right").astype(float)
            codes = batch.column("k").dictionary_encode(null_encoding="encode")
            values, at = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            both = np.stack([np.add.reduceat(x[order], starts) for x in (weight * batch.column("y").to_numpy()[:, None], weight)], 1)
            for i, x in zip(at[order][starts].tolist(), both):
                sums[values[i]] = sums[values[i]] + x if values[i] in sums else x
            if len(sums) > 4096:  # many groups: the arrays leave in portions
                yield _portion(sums, batch.schema.field("k").type)
                sums = {}
        if sums:
            yield _portion(sums, batch.schema.field("k").type)
    parts = rows.mapInArrow(add_up, f"k {kind}, s array<double>, w array<double>")
    per = (parts.select("k", F.posexplode(F.arrays_zip("s", "w")).alias("rep", "x")).groupBy("k", "rep")
           .agg(F.try_divide(F.sum("x.s"), F.sum("x.w")).alias("m")))
    return per.groupBy(F.col("k").alias(key)).agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


def _portion(sums: dict, kind: pa.DataType) -> pa.RecordBatch:
    lists = [pa.array([v[i].tolist() for v in sums.values()], pa.list_(pa.float64())) for i in range(2)]
    return pa.RecordBatch.from_arrays([pa.array(list(sums), kind), *lists], ["k", "s", "w"])


def facet_rate(df: DataFrame, x: str, facet: str, y: str) -> DataFrame:
    """Mean target by (x, facet)."""
    return df.groupBy(x, facet).agg(F.avg(y).alias("rate"), F.count(y).alias("n"))


def domain_rate(df: DataFrame, key: str, y: str, domain: list) -> DataFrame:
    """Mean over a fixed ordered domain; domain values absent from the data show null."""
    spark = df.sparkSession
    dom = spark.createDataFrame([(i, v) for i, v in enumerate(domain)], ["order", key])
    rates = df.groupBy(key).agg(F.avg(y).alias("rate"))
    return F.broadcast(dom).join(rates, on=key, how="left").orderBy("order")


def binned_rate(df: DataFrame, c: str, edges: list[float], y: str) -> DataFrame:
    """Mean target per right-closed bin of ``c``."""
    from tabforge.operators.encode import cut_expr
    return df.withColumn("bin", cut_expr(F.col(c), edges)).groupBy("bin").agg(
        F.avg(y).alias("rate"), F.count(F.lit(1)).alias("n"))


def auto_bins(df: DataFrame, c: str, rule: str = "auto") -> int:
    """Number of equal-width bins from the data: ``fd`` has width 2 IQR / n^(1/3) (exact quartiles), ``sturges``
    range / (log2 n + 1), ``auto`` the smaller of the two widths (the second, if the quartiles are equal). One bin for a
    constant column; an empty one has none."""
    if rule not in ("auto", "fd", "sturges"):
        raise ValueError(rule)
    x = F.col(c).cast("double")
    n, lo, hi = df.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n or hi == lo:
        return min(1, n)
    sturges = (hi - lo) / (math.log2(n) + 1.0)
    q = {r["p"]: r["value"] for r in exact_quantiles(df.select(x.alias("x")), ["x"], [0.25, 0.75]).collect()} if rule != "sturges" else {0.25: 0.0, 0.75: 0.0}
    fd = 2.0 * (q[0.75] - q[0.25]) / n ** (1.0 / 3.0)
    width = sturges if rule == "sturges" or fd == 0 else fd if rule == "fd" else min(fd, sturges)
    return math.ceil((hi - lo) / width)


def histogram(df: DataFrame, c: str, bins: int | str, by: str | None = None) -> DataFrame:
    """Equal-width histogram over [min, max]; last bin right-closed (numpy rule).

    min/max come from one global aggregate (a single bounded row) and enter the
    plan as literals, so binning stays inside the scan's codegen stage. ``bins`` may be a rule of ``auto_bins``.
    """
    if isinstance(bins, str):
        bins = max(1, auto_bins(df, c, bins))
    lo, hi = df.agg(F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double"))).first()
    keys = [by] if by else []
    if lo is None:
        return df.sparkSession.createDataFrame([], f"{by + ' ' + dict(df.dtypes)[by] + ', ' if by else ''}bin int, left double, right double, n long")
    width = (hi - lo) / bins
    x = F.col(c).cast("double")
    idx = F.lit(0) if width == 0 else F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    g = (df.where(F.col(c).isNotNull()).select(*keys, idx.cast("int").alias("bin"))
           .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")))
    return g.select(*keys, "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("left"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("right"), "n")


def kde(df: DataFrame, c: str, grid: list[float] | None = None, points: int = 50,
        by: str | None = None) -> DataFrame:
    """Gaussian KDE with Scott's bandwidth h = std·n^(-1/5), per ``by`` group.

    Values are first collapsed to (value, count); every grid point is one sum of
    one aggregate, so a task sends a row per group and no row per value and grid point.
    The grid is literal (default: ``points`` steps over [min, max]). A group of one value has no bandwidth:
    its density is NULL. No values give no rows.
    """
    keys = [by] if by else []
    x = F.col(c).cast("double")
    base = df.where(F.col(c).isNotNull()).select(*keys, x.alias("x"))
    if grid is None:
        lo, hi = base.agg(F.min("x"), F.max("x")).first()
        if lo is None:
            grid, lo, hi, points = [0.0], 0.0, 0.0, 0
        step = (hi - lo) / max(1, points - 1)
        grid = [lo + i * step for i in range(points)] or [0.0]
    distinct = base.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("k"))
    if keys:
        st = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("x").alias("_sd"))
        j = null_safe_join(settled(distinct), settled(st), keys)
    else:
        n, sd = base.agg(F.count(F.lit(1)), F.stddev_samp("x")).first()
        j = distinct.withColumn("_n", F.lit(n)).withColumn("_sd", F.lit(sd))
    j = j.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    point = [F.col("k") * F.exp(-0.5 * F.pow(F.try_divide(F.lit(float(g)) - F.col("x"), F.col("_h")), 2)) for g in grid]
    agg = j.groupBy(*keys, "_n", "_h").agg(*[F.sum(s).alias(f"_s{i}") for i, s in enumerate(point)])
    dens = [F.try_divide(F.col(f"_s{i}"), F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi)) for i in range(len(grid))]
    return agg.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("grid_index"), F.lit(float(g)).alias("x"), d.alias("density"))
                                                for i, (g, d) in enumerate(zip(grid, dens))])))


def linear_fit(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """Least-squares line y ~ x (optionally per group)."""
    aggs = [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
            F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n")]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def cross_products(df: DataFrame, exprs: list) -> np.ndarray:
    """Sums of products of every two of the given double columns (none NULL), in one pass over ``df``."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils
    rows = MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(F.array(*exprs)).alias("v")), "v")
    return np.array(RowMatrix(rows).computeGramianMatrix().toArray())


def _pair_corr(a: Column, b: Column) -> Column:
    """Pearson r over the rows that have both; NULL if either is constant there (``corr`` raises in ANSI mode)."""
    spread = F.var_pop(F.when(b.isNotNull(), a)) * F.var_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), F.sqrt(spread))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson r for every pair i<j in long form (a, b, r, abs_r).

    Two scans for any number of columns: one for centres, one for all sums of products. NULLs enter as 0; if there are
    any, squares and 0/1 marks of the columns with NULLs enter too, and products with the marks are the sums over
    the rows that a pair shares. Pairs for which that is ill-conditioned are aggregated singly.
    r is NULL for pairs with fewer than two shared rows or a column that is constant in them.
    """
    spark, p = df.sparkSession, len(cols)
    schema = "a string, b string, r double, abs_r double"
    x = [F.col(c).cast("double") for c in cols]
    st = df.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(x) for k, f in (
        ("n", F.count), ("m", F.avg), ("lo", F.min), ("hi", F.max))]).first()
    total = st["n"]
    if total == 0:
        return spark.createDataFrame([(cols[i], cols[j], None, None) for i in range(p) for j in range(i + 1, p)], schema)
    centre = [st[f"lo{i}"] if st[f"lo{i}"] == st[f"hi{i}"] else st[f"m{i}"] for i in range(p)]
    v = [F.coalesce(c - F.lit(m if m is not None else 0.0), F.lit(0.0)) for c, m in zip(x, centre)]
    holes = [i for i in range(p) if st[f"n{i}"] < total]
    marks = [x[i].isNotNull().cast("double") for i in holes]
    squares = [c * c for c in v] if holes else []
    g = cross_products(df, [*v, F.lit(1.0), *marks, *squares])
    mark = np.full(p, p)  # where each column's mark lies; one that is always 1 for columns without NULLs
    mark[holes] = p + 1 + np.arange(len(holes))

    n = g[np.ix_(mark, mark)]  # rows that i and j share
    s = g[:p][:, mark]  # sum of i over them
    # sum of squares of i over them
    q = g[p + 1 + len(holes):][:, mark] if holes else np.repeat(np.diag(g)[:p, None], p, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        var = q - s * s / n
        cov = g[:p, :p] - s * s.T / n
        known = (n >= 2) & (q > 0) & (q.T > 0)
        r = np.where(known, cov / np.sqrt(var * var.T), np.nan)
        # Shared rows that lie far from the centre for their spread lose digits in the sums: these pairs go one by one.
        doubtful = known & ((var <= 1e-6 * q) | (var <= 1e-6 * q).T)
    again = [(i, j) for i, j in np.argwhere(doubtful) if i < j]
    for at in range(0, len(again), 200):
        part = again[at:at + 200]
        row = df.agg(*[_pair_corr(x[i], x[j]).alias(f"r{k}") for k, (i, j) in enumerate(part)]).first()
        for k, (i, j) in enumerate(part):
            r[i, j] = np.nan if row[k] is None else row[k]
    rows = [(cols[i], cols[j], *((None, None) if np.isnan(r[i, j]) else (float(r[i, j]), abs(float(r[i, j])))))
            for i in range(p) for j in range(i + 1, p)]
    return spark.createDataFrame(rows, schema)


def score_summary(scores: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    """Mean and population std of fold scores per model."""
    return scores.groupBy(model).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
                                     F.count(score).alias("n_folds"))


def log_stats(df: DataFrame, gen: str, metrics: list[str]) -> DataFrame:
    """Per generation mean/std ignoring NaN, min/max with NaN as +inf, rounded to 2."""
    aggs = []
    for m in metrics:
        v = F.col(m).cast("double")
        clean = F.when(F.isnan(v), F.lit(None)).otherwise(v)
        inf = F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v)
        aggs += [F.round(F.avg(clean), 2).alias(f"{m}_avg"), F.round(F.stddev_pop(clean), 2).alias(f"{m}_std"),
                 F.round(F.min(inf), 2).alias(f"{m}_min"), F.round(F.max(inf), 2).alias(f"{m}_max")]
    return df.groupBy(gen).agg(*aggs)
