"""Cross-validation and grids whose folds share their work (M4, M5).

Naive Bayes and linear discriminants are sums over rows, so the sums of a fold's training rows are the total less the
fold's own: statistics of all folds come from grouped sums, and all of them, with every smoothing of a grid, are scored in
one scan as linear models looked up by fold. A k-NN grid searches the neighbours of all folds once, in one tree and at the
largest k: every smaller k and both weightings are votes over the same ranked list.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.operators.neighbors import knn
from tabforge.operators.summarize import cross_products
from tabforge.plans.bounded import BoundExceeded, settled

MAX_GROUPS = 10_000


def _sums(df: DataFrame, y: str, fold: str, x: list[Column]) -> dict[tuple, tuple[int, np.ndarray]]:
    """{(fold, class): (rows, sums of x)}; at most ``MAX_GROUPS`` of them, more raise."""
    rows = df.groupBy(fold, y).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]).limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise BoundExceeded(f"more than {MAX_GROUPS} pairs of a fold and a class")
    return {(r[fold], r[y]): (r["n"], np.array([r[f"s{i}"] for i in range(len(x))], dtype=float)) for r in rows}


def _others(sums: dict, held_out) -> list[tuple]:
    """(class, rows, sums) over all folds but one, in class order; classes without rows there are left out."""
    total: dict = {}
    for (f, c), (n, s) in sums.items():
        if f != held_out:
            m, t = total.get(c, (0, 0.0))
            total[c] = (m + n, t + s)
    return [(c, *total[c]) for c in sorted(total)]


def _known(df: DataFrame, cols: list[str], y: str, fold: str, x) -> DataFrame:
    """Narrow rows with a class, a fold and all features as one array ``_x``; others take no part."""
    x = F.array(*[x(F.col(c)).cast("double") for c in cols])
    return settled(df.dropna(subset=[*cols, y, fold]).select(F.col(y).alias("_y"), F.col(fold).alias("_f"), x.alias("_x")))


def _linear_scores(data: DataFrame, models: list[tuple]) -> DataFrame:
    """(params, fold, score): accuracy of the linear models (params, fold, class, weights, intercept) on their fold's rows.

    The class of the largest score is predicted, the first class of equal ones. Models are few (folds x classes x
    parameters) and joined as one row per fold.
    """
    spark, kind = data.sparkSession, data.schema["_f"].dataType.simpleString()
    of_class = f"_f {kind}, _p string, _c {data.schema['_y'].dataType.simpleString()}, _w array<double>, _b double"
    rows = [(f, p, c, [float(v) for v in w], float(b)) for p, f, c, w, b in models]
    by_fold = (spark.createDataFrame(rows, of_class).groupBy("_f", "_p").agg(F.array_sort(F.collect_list(F.struct("_c", "_w", "_b"))).alias("_m"))
               .groupBy("_f").agg(F.collect_list(F.struct("_p", "_m")).alias("_all")))

    def score(m):
        return F.aggregate(F.zip_with("_x", m["_w"], lambda a, b: a * b), m["_b"], lambda s, t: s + t)

    def right(of):
        scored = F.transform(of["_m"], lambda m: F.struct(score(m).alias("s"), m["_c"].alias("c")))
        top = F.array_max(F.transform(scored, lambda v: v["s"]))
        first = F.element_at(F.filter(scored, lambda v: v["s"] == top), 1)["c"]
        return F.struct(of["_p"].alias("params"), (first == F.col("_y")).cast("double").alias("hit"))
    hits = data.join(F.broadcast(by_fold), "_f").select(F.col("_f").alias("fold"), F.inline(F.transform("_all", right)))
    return hits.groupBy("params", "fold").agg(F.avg("hit").alias("score"))


def naive_bayes_folds(df: DataFrame, cols: list[str], y: str, fold: str, kind: str, alphas: list[float], binarize: float = 0.0) -> DataFrame:
    """(params, fold, score) of Bernoulli or multinomial naive Bayes for every smoothing (above 0): two scans for any
    number of folds and smoothings. Rows with a NULL class, fold or feature take no part; no rows give no scores."""
    if kind not in ("bernoulli", "multinomial") or min(alphas) <= 0:
        raise ValueError("kind is bernoulli or multinomial, alphas are above 0")
    data = _known(df, cols, y, fold, (lambda c: c > binarize) if kind == "bernoulli" else lambda c: c)
    sums = _sums(data, "_y", "_f", [F.col("_x")[i] for i in range(len(cols))])
    models = []
    for f in sorted({f for f, _ in sums}):
        classes = _others(sums, f)
        rows = sum(n for _, n, _ in classes)
        for alpha in alphas:
            for c, n, s in classes:
                if kind == "bernoulli":
                    on = (s + alpha) / (n + 2 * alpha)
                    w, b = np.log(on) - np.log(1 - on), np.log(1 - on).sum()
                else:
                    w, b = np.log((s + alpha) / (s.sum() + alpha * len(cols))), 0.0
                models.append((f"alpha={alpha}", f, c, w, b + math.log(n / rows)))
    return _linear_scores(data, models)


def lda_folds(df: DataFrame, cols: list[str], y: str, fold: str) -> DataFrame:
    """(params, fold, score) of linear discriminants: class sums of all folds in one scan, each fold's cross products about the
    common centre once; a fold's training statistics are the totals less its own. NULLs as in ``naive_bayes_folds``."""
    data = _known(df, cols, y, fold, lambda c: c)
    x = [F.col("_x")[i] for i in range(len(cols))]
    sums = _sums(data, "_y", "_f", x)
    rows = sum(n for n, _ in sums.values())
    if not rows:
        return _linear_scores(data, [])
    centre = sum(s for _, s in sums.values()) / rows
    folds = sorted({f for f, _ in sums})
    own = {f: cross_products(data.where(F.col("_f") == F.lit(f)), [c - F.lit(float(m)) for c, m in zip(x, centre)]) for f in folds}
    total, models = sum(own.values()), []
    for f in folds:
        classes = [(c, n, s / n) for c, n, s in _others(sums, f)]
        n_train = sum(n for _, n, _ in classes)
        if n_train <= len(classes):
            raise ValueError(f"too few rows outside of fold {f}")
        within = total - own[f] - sum(n * np.outer(m - centre, m - centre) for _, n, m in classes)
        inverse = np.linalg.pinv(within / (n_train - len(classes)))
        models += [("", f, c, inverse @ m, -0.5 * m @ inverse @ m + math.log(n / n_train)) for c, n, m in classes]
    return _linear_scores(data, models)


def knn_grid(df: DataFrame, cols: list[str], y: str, key: str, fold: str, ks: list[int],
             weights: list[str] = ("uniform", "distance"), p: int = 2) -> DataFrame:
    """(params, fold, score) of the k-NN classifier for every k and weighting, from one neighbour search for all folds.

    Ties between classes go to the smallest; with weights by distance, exact matches take all the weight. Rows with a NULL
    class or fold take no part; a row without neighbours counts as wrong.
    """
    data = settled(df.where(F.col(y).isNotNull() & F.col(fold).isNotNull()).select(F.col(key).alias("_k"), F.col(y).alias("_y"), F.col(fold).alias("_f"), *cols))
    folds = [r[0] for r in data.select("_f").distinct().limit(MAX_GROUPS + 1).collect()]
    if len(folds) > MAX_GROUPS:
        raise BoundExceeded(f"more than {MAX_GROUPS} folds")
    if not folds:
        return df.sparkSession.createDataFrame([], f"params string, fold {data.schema['_f'].dataType.simpleString()}, score double")
    data = data.withColumn("_g", F.array_position(F.array(*[F.lit(f) for f in sorted(folds)]), F.col("_f")))
    found = knn(data, data.withColumnRenamed("_k", "_d"), cols, max(ks), "_k", "_d", "_y", metric="manhattan" if p == 1 else "euclidean", apart="_g")
    found = found.select("_k", F.col("_y").alias("_c"), "dist", "rank")
    near, weight = [F.col("rank") <= k for k in ks], F.when(F.col("dist") > 0, 1.0 / F.col("dist")).otherwise(0.0)
    tally = found.groupBy("_k", "_c").agg(*[F.sum(F.when(near[i], v).otherwise(0.0)).alias(f"_{name}{i}") for i in range(len(ks)) for name, v in (
        ("n", F.lit(1.0)), ("w", weight), ("e", (F.col("dist") == 0).cast("double")))])

    def most(v):
        return F.min_by("_c", F.struct(-F.col(v), F.col("_c")))

    def vote(i, kind):
        return most(f"_n{i}") if kind == "uniform" else F.when(F.sum(f"_e{i}") > 0, most(f"_e{i}")).otherwise(most(f"_w{i}"))
    grid = [(i, w) for i in range(len(ks)) for w in weights]
    votes = tally.groupBy("_k").agg(*[vote(i, w).alias(f"_v{j}") for j, (i, w) in enumerate(grid)])
    hits = data.join(votes, "_k", "left").groupBy("_f").agg(*[F.avg(F.coalesce(F.col(f"_v{j}") == F.col("_y"), F.lit(False)).cast("double")).alias(f"_v{j}")
                                                             for j in range(len(grid))])
    return hits.select(F.col("_f").alias("fold"), F.inline(F.array(*[F.struct(F.lit(f"k={ks[i]}, weights={w}").alias("params"), F.col(f"_v{j}").alias("score"))
                                                                   for j, (i, w) in enumerate(grid)]))).select("params", "fold", "score")
