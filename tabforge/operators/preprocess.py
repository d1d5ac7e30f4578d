"""Preprocessing and feature-selection transformers.

Column statistics come from one aggregate (or the distributed exact
quantiles) and enter the plan as literals; per-row work is plain arithmetic
inside codegen. Selection steps that need a model fit use Spark ML.
Driver-side work is limited to matrices of size (features × features) or
(features × components).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.operators.summarize import cross_products
from tabforge.plans.ranking import exact_quantiles


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


# K1–K4 scalers -------------------------------------------------------------
def minmax_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x − min)/(max − min); a constant column becomes 0."""
    st = df.agg(*[e for c in cols for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    out = {}
    for c in cols:
        lo, hi = st[f"lo_{c}"], st[f"hi_{c}"]
        rng = (hi - lo) if lo is not None else 0
        out[c] = (F.col(c) - F.lit(lo)) / F.lit(rng) if rng else F.col(c) * 0.0
    return df.withColumns(out)


def maxabs_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """x / max|x|; an all-zero column stays 0."""
    st = df.agg(*[F.max(F.abs(c)).alias(c) for c in cols]).first()
    return df.withColumns({c: F.col(c) / F.lit(st[c]) if st[c] else F.col(c) * 1.0 for c in cols})


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x − mean)/population std; a zero std leaves x − mean."""
    st = df.agg(*[e for c in cols for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(st[f"m_{c}"])) / F.lit(st[f"s_{c}"] or 1.0) for c in cols})


def robust_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x − median)/(q75 − q25), exact linear-interpolated quantiles; IQR 0 → scale 1; all-NULL columns stay NULL."""
    q = {(r["column"], r["p"]): r["value"] for r in exact_quantiles(df, cols, [0.25, 0.5, 0.75]).collect()}
    out = {}
    for c in cols:
        if q.get((c, 0.5)) is None:  # nothing known
            out[c] = F.lit(None).cast("double")
            continue
        iqr = q[(c, 0.75)] - q[(c, 0.25)]
        out[c] = (F.col(c) - F.lit(q[(c, 0.5)])) / F.lit(iqr if iqr else 1.0)
    return df.withColumns(out)


# K5–K8 row-wise ---------------------------------------------------------------
def normalize_rows(df: DataFrame, cols: list[str], norm: str = "l2") -> DataFrame:
    """Divide each row by its l1 / l2 / max norm; a zero norm leaves the row unchanged."""
    xs = [F.col(c).cast("double") for c in cols]
    if norm == "l1":
        n = _sum([F.abs(x) for x in xs])
    elif norm == "l2":
        n = F.sqrt(_sum([x * x for x in xs]))
    elif norm == "max":
        n = F.greatest(*[F.abs(x) for x in xs]) if len(xs) > 1 else F.abs(xs[0])
    else:
        raise ValueError(norm)
    safe = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return df.withColumn("_norm", safe).withColumns({c: F.col(c) / F.col("_norm") for c in cols}).drop("_norm")


def binarize(df: DataFrame, cols: list[str], threshold: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) > threshold, 1).otherwise(0) for c in cols})


def poly2(df: DataFrame, cols: list[str]) -> DataFrame:
    """Degree-2 expansion without bias: originals kept, then a·b for a ≤ b (sklearn order)."""
    new = {}
    for i, a in enumerate(cols):
        for b in cols[i:]:
            new[f"{a}^2" if a == b else f"{a}*{b}"] = F.col(a) * F.col(b)
    return df.withColumns(new)


def zero_count(df: DataFrame, cols: list[str]) -> DataFrame:
    """Two columns: number of non-zero and of zero values in the row."""
    nz = _sum([F.when(F.col(c) != 0, 1).otherwise(0) for c in cols])
    return df.withColumn("non_zero", nz).withColumn("zero_count", F.lit(len(cols)) - nz)


# K9–K11 univariate selection ------------------------------------------------------
def variances(df: DataFrame, cols: list[str]) -> DataFrame:
    row = df.agg(*[F.var_pop(c).alias(f"_v{i}") for i, c in enumerate(cols)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_v{i}").alias("variance"))
                                         for i, c in enumerate(cols)])))


def variance_threshold(df: DataFrame, cols: list[str], threshold: float = 0.0) -> DataFrame:
    """Drop columns whose population variance is ≤ threshold."""
    keep = {r["column"] for r in variances(df, cols).where(F.col("variance") > threshold).collect()}
    return df.drop(*[c for c in cols if c not in keep])


def anova_f(df: DataFrame, cols: list[str], y: str) -> DataFrame:
    """One-way ANOVA F per feature against class ``y`` (one rolled-up aggregate: a row per class and one of all rows).

    Columns: feature, f, df_between, df_within. Rows count for a feature if they know it and the class. A constant
    feature, a single class, or as many classes as rows have a NULL F; classes that part the values fully have infinity.
    """
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    rows = df.where(F.col(y).isNotNull()).rollup(y).agg(F.grouping_id().alias("_all"), *[e for i, c in enumerate(x) for e in (
        F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), (F.var_pop(c) * F.count(c)).alias(f"w{i}"))])
    one, total = F.col("_all") == 0, F.col("_all") == 1
    aggs = []
    for i in range(len(cols)):
        n, m, w = F.col(f"n{i}"), F.col(f"m{i}"), F.col(f"w{i}")
        aggs += [F.count_if(one & (n > 0)).alias(f"K{i}"), F.max(F.when(total, n)).alias(f"N{i}"),
                 F.coalesce(F.sum(F.when(one, w)), F.lit(0.0)).alias(f"W{i}"), F.max(F.when(total, w)).alias(f"T{i}"),
                 (F.min(F.when(one, m)) == F.max(F.when(one, m))).alias(f"E{i}")]
    parts = []
    for i, c in enumerate(cols):
        within, between = F.col(f"N{i}") - F.col(f"K{i}"), F.col(f"K{i}") - 1
        ssw, ssb = F.col(f"W{i}"), F.when(F.col(f"E{i}"), 0.0).otherwise(F.greatest(F.col(f"T{i}") - F.col(f"W{i}"), F.lit(0.0)))
        f = F.when((ssw == 0) & (ssb > 0) & (within > 0), F.lit(float("inf"))).otherwise(
            F.try_divide(F.try_divide(ssb, between), F.try_divide(ssw, within)))
        parts.append(F.struct(F.lit(c).alias("feature"), F.when((between > 0) & (within > 0), f).alias("f"),
                              F.greatest(between, F.lit(0)).cast("long").alias("df_between"),
                              F.greatest(F.coalesce(within, F.lit(0)), F.lit(0)).cast("long").alias("df_within")))
    return rows.agg(*aggs).select(F.inline(F.array(*parts)))


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 300):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > 1e-300 else 1e-300
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > 1e-300 else 1e-300
        de = d * c
        h *= de
        if abs(de - 1.0) < 3e-16:
            break
    return h


def f_sf(f: float, d1: float, d2: float) -> float:
    """Survival function of the F distribution (regularised incomplete beta)."""
    if f is None or math.isnan(f):
        return float("nan")
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    x = d2 / (d2 + d1 * f)
    a, b = d2 / 2.0, d1 / 2.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1 - x) / b


def select_fwe(df: DataFrame, cols: list[str], y: str, alpha: float = 0.05) -> DataFrame:
    """(feature, f, p_value, keep) — keep when p < alpha / n_features (family-wise error)."""
    rows = anova_f(df, cols, y).collect()  # one row per feature
    out = [(r["feature"], r["f"], f_sf(r["f"], r["df_between"], r["df_within"])) for r in rows]
    return df.sparkSession.createDataFrame([(a, b, p, bool(p < alpha / len(cols))) for a, b, p in out],
                                           "feature string, f double, p_value double, keep boolean")


def select_percentile(df: DataFrame, cols: list[str], y: str, percentile: float = 10) -> DataFrame:
    """Keep the top ``percentile`` % of features by F (Spark's UnivariateFeatureSelector)."""
    from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
    data = VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="keep").transform(
        df.select(*cols, F.col(y).cast("double").alias("_y")))
    sel = UnivariateFeatureSelector(featuresCol="_x", labelCol="_y", outputCol="_sel", selectionMode="percentile")
    sel.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(percentile / 100.0)
    model = sel.fit(data)
    keep = set(model.selectedFeatures)
    return df.sparkSession.createDataFrame([(c, i in keep) for i, c in enumerate(cols)], "feature string, keep boolean")


# K12 / K13 model-driven selection -----------------------------------------------------
def rfe(df: DataFrame, cols: list[str], y: str, step: float = 0.1, keep: int = 1, seed: int = 0,
        num_trees: int = 20) -> DataFrame:
    """Recursive elimination with forest importances; returns (feature, rank) — rank 1 = kept."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    base = df.select(*cols, F.col(y).cast("double").alias("_y")).persist()
    alive, ranking, rank = list(cols), {}, None
    share = max(1, int(step * len(cols)) if step < 1 else int(step))  # of the features at the start
    elim_rounds = []
    while len(alive) > keep:
        data = VectorAssembler(inputCols=alive, outputCol="_x", handleInvalid="keep").transform(base)
        m = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=num_trees, seed=seed).fit(data)
        imp = list(m.featureImportances.toArray())
        n_drop = min(share, len(alive) - keep)
        order = sorted(range(len(alive)), key=lambda i: (imp[i], alive[i]))
        gone = [alive[i] for i in order[:n_drop]]
        elim_rounds.append(gone)
        alive = [c for c in alive if c not in gone]
    base.unpersist()
    for c in alive:
        ranking[c] = 1
    rank = 2
    for gone in reversed(elim_rounds):
        for c in gone:
            ranking[c] = rank
        rank += 1
    return df.sparkSession.createDataFrame([(c, ranking[c]) for c in cols], "feature string, rank int")


# K14–K17 projections ------------------------------------------------------------------
def pca(df: DataFrame, cols: list[str], k: int, out: str = "pc") -> DataFrame:
    """Project onto the top-k principal components (Spark ML PCA; signs arbitrary)."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    va = VectorAssembler(inputCols=cols, outputCol="_x")
    data = va.transform(df)
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(data)
    res = model.transform(data).withColumn("_a", vector_to_array("_pc"))
    return res.withColumns({f"{out}{i}": F.col("_a")[i] for i in range(k)}).drop("_x", "_pc", "_a")


def rbf_features(df: DataFrame, cols: list[str], gamma: float = 1.0, n_components: int = 20,
                 seed: int = 0, prefix: str = "rff") -> DataFrame:
    """Random Fourier features z_j = √(2/D)·cos(x·w_j + b_j), w ~ N(0, 2γ), b ~ U(0, 2π)."""
    rng = np.random.RandomState(seed)
    W = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(len(cols), n_components))
    b = rng.uniform(0.0, 2 * math.pi, size=n_components)
    scale = math.sqrt(2.0 / n_components)
    out = {}
    for j in range(n_components):
        lin = _sum([F.col(c) * float(W[i, j]) for i, c in enumerate(cols)]) + float(b[j])
        out[f"{prefix}{j}"] = F.cos(lin) * scale
    return df.withColumns(out)


def nystroem(df: DataFrame, cols: list[str], key: str, gamma: float = 0.2, n_components: int = 20,
             seed: int = 0, prefix: str = "ny") -> DataFrame:
    """RBF Nyström map from ``n_components`` landmark rows (chosen by hashed key order)."""
    land = (df.select(key, *cols).orderBy(F.md5(F.concat(F.lit(f"{seed}#"), F.col(key).cast("string"))), key)
              .limit(n_components).collect())  # bounded: n_components rows
    L = np.array([[float(r[c]) for c in cols] for r in land])
    d2 = ((L[:, None, :] - L[None, :, :]) ** 2).sum(-1)
    K = np.exp(-gamma * d2)
    U, S, Vt = np.linalg.svd(K)
    S = np.maximum(S, 1e-12)
    M = U / np.sqrt(S)  # K^{-1/2} columns (as the reference library does)
    M = M @ Vt
    kcols = [F.exp(-gamma * _sum([(F.col(c) - float(L[l, i])) ** 2 for i, c in enumerate(cols)]))
             for l in range(len(land))]
    out = {f"{prefix}{j}": _sum([kcols[l] * float(M[l, j]) for l in range(len(land))]) for j in range(len(land))}
    return df.withColumns(out)


def column_distances(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Squared Euclidean distances of all pairs of columns over the rows that both know: two scans for any number of columns."""
    p = len(cols)
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    st = df.agg(F.count("*").alias("n"), *[e for i, c in enumerate(x) for e in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"))]).first()
    if not st["n"]:
        return np.zeros((p, p))
    known = [st[f"m{i}"] for i in range(p) if st[f"m{i}"] is not None]
    shift = F.lit(sum(known) / len(known) if known else 0.0)  # one for all columns: differences stay, squares get small
    v = [F.coalesce(c - shift, F.lit(0.0)) for c in x]
    holes = [i for i in range(p) if st[f"n{i}"] < st["n"]]
    marks = [x[i].isNotNull().cast("double") for i in holes]
    g = cross_products(df, [*v, F.lit(1.0), *marks, *([c * c for c in v] if holes else [])])
    mark = np.full(p, p)
    mark[holes] = p + 1 + np.arange(len(holes))
    squares = g[p + 1 + len(holes):][:, mark] if holes else np.repeat(np.diag(g)[:p, None], p, 1)
    d = np.maximum(squares + squares.T - 2 * g[:p, :p], 0.0)
    np.fill_diagonal(d, 0.0)
    return d


def ward_merges(d: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges (height, column, column) of Ward's clustering by chains of nearest neighbours: p^2 steps, not p^3.

    Ends of a chain that are each other's nearest merge; ties go to the chain's last link, then to the lower number.
    """
    d, p = np.array(d, float), len(d)
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(p), np.ones(p, bool), [], []
    for _ in range(p - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        a, b = min(a, b), max(a, b)
        height = d[a, b]
        merges.append((float(height), a, b))
        joined = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * height) / (size[a] + size[b] + size)
        alive[b] = False
        size[a] += size[b]
        joined[a] = np.inf
        d[a], d[:, a] = joined, joined
    return sorted(merges, key=lambda m: m[0])


def agglomerate(df: DataFrame, cols: list[str], n_clusters: int, prefix: str = "agg") -> DataFrame:
    """Ward clustering of the columns (distances from one pass of cross products), members averaged per row.

    A row's NULL members are left out of its average; a cluster without any known member is NULL.
    """
    group = list(range(len(cols)))
    for _, a, b in ward_merges(column_distances(df, cols))[:max(0, len(cols) - n_clusters)]:
        group = [group[a] if g == group[b] else g for g in group]
    members: dict[int, list[int]] = {}
    for i, g in enumerate(group):
        members.setdefault(g, []).append(i)
    out = {}
    for k, m in enumerate(sorted(members.values())):
        known = _sum([F.col(f"`{cols[i]}`").isNotNull().cast("int") for i in m])
        out[f"{prefix}{k}"] = F.try_divide(_sum([F.coalesce(F.col(f"`{cols[i]}`").cast("double"), F.lit(0.0)) for i in m]), known)
    return df.withColumns(out)


# K18 / K19 composition -------------------------------------------------------------------------
def stack(df: DataFrame, cols: list[str], y: str, estimator, prefix: str = "stack") -> DataFrame:
    """Append an estimator's prediction and class probabilities as new feature columns."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    va = VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="keep")
    data = va.transform(df.withColumn("_y", F.col(y).cast("double")))
    est = estimator.copy().setFeaturesCol("_x").setLabelCol("_y")
    est = est.setPredictionCol("_pred")
    if est.hasParam("probabilityCol"):
        est = est.setProbabilityCol("_prob")
    if est.hasParam("rawPredictionCol"):
        est = est.setRawPredictionCol("_raw")
    res = est.fit(data).transform(data)
    res = res.withColumn(f"{prefix}_pred", F.col("_pred"))
    if "_prob" in res.columns:
        pa = vector_to_array("_prob")
        res = res.withColumn(f"{prefix}_p0", pa[0]).withColumn(f"{prefix}_p1", pa[1])
    return res.drop(*[c for c in ("_x", "_y", "_pred", "_prob", "_raw") if c in res.columns])


def feature_union(df: DataFrame, cols: list[str], branches: list[tuple[str, object]]) -> DataFrame:
    """Original columns plus, per branch, a transformed copy side by side (same rows, no join).

    Each branch is ``(name, fn)`` with ``fn(df, cols) -> df`` transforming the
    given columns in place or adding new ones; it receives copies named
    ``<name>_<col>``.
    """
    out = df
    for name, fn in branches:
        copies = [f"{name}_{c}" for c in cols]
        out = fn(out.withColumns({cp: F.col(c) for cp, c in zip(copies, cols)}), copies)
    return out
