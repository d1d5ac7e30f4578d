"""Preprocessing / selection queries (K*) over lineitem numerics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tabforge.operators import preprocess as K
from tabforge.plans.registry import register
from tabforge.plans.tables import LABELLED_LINEITEM_SQL, labelled_lineitem, load

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_linenumber"]


def base(spark, sf):
    return load(spark, sf, "lineitem").select(*KEYS, *COLS)


def r4(c):
    return F.round(c, 4)


def _out(df, cols=COLS, digits=4):
    return df.select(*KEYS, *[F.round(c, digits).alias(c) for c in cols])


def _sel(exprs, digits=4):
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"round({e}, {digits}) + 0.0 AS \"{c}\"" for c, e in exprs.items()) + " FROM lineitem"


@register("minmax_scale_lineitem", _sel({c: f"({c} - (SELECT min({c}) FROM lineitem)) / "
                                            f"((SELECT max({c}) FROM lineitem) - (SELECT min({c}) FROM lineitem))"
                                         for c in COLS}))
def minmax_scale_lineitem(spark, sf):
    return _out(K.minmax_scale(base(spark, sf), COLS))


@register("maxabs_scale_lineitem", _sel({c: f"{c} / (SELECT max(abs({c})) FROM lineitem)" for c in COLS}))
def maxabs_scale_lineitem(spark, sf):
    return _out(K.maxabs_scale(base(spark, sf), COLS))


@register("standard_scale_lineitem", _sel({c: f"({c} - (SELECT avg({c}) FROM lineitem)) / "
                                              f"(SELECT stddev_pop({c}) FROM lineitem)" for c in COLS}))
def standard_scale_lineitem(spark, sf):
    return _out(K.standard_scale(base(spark, sf), COLS))


@register("robust_scale_lineitem", "WITH q AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) AS b_{c}"
    for c in COLS) + " FROM lineitem) " + _sel({c: f"({c} - m_{c}) / (b_{c} - a_{c})" for c in COLS}) + ", q")
def robust_scale_lineitem(spark, sf):
    return _out(K.robust_scale(base(spark, sf), COLS))


L1 = " + ".join(f"abs({c})" for c in COLS)
L2 = "sqrt(" + " + ".join(f"{c} * {c}" for c in COLS) + ")"
LMAX = "greatest(" + ", ".join(f"abs({c})" for c in COLS) + ")"


@register("normalize_rows_l1", _sel({c: f"{c} / ({L1})" for c in COLS}, 6))
def normalize_rows_l1(spark, sf):
    return _out(K.normalize_rows(base(spark, sf), COLS, "l1"), digits=6)


@register("normalize_rows_l2", _sel({c: f"{c} / ({L2})" for c in COLS}, 6))
def normalize_rows_l2(spark, sf):
    return _out(K.normalize_rows(base(spark, sf), COLS, "l2"), digits=6)


@register("normalize_rows_max", _sel({c: f"{c} / ({LMAX})" for c in COLS}, 6))
def normalize_rows_max(spark, sf):
    return _out(K.normalize_rows(base(spark, sf), COLS, "max"), digits=6)


@register("binarize_lineitem", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"CASE WHEN {c} > {t} THEN 1 ELSE 0 END AS {c}" for c, t in zip(COLS, [25, 30000, 0.05, 0.04])) + " FROM lineitem")
def binarize_lineitem(spark, sf):
    b = base(spark, sf)
    for c, t in zip(COLS, [25, 30000, 0.05, 0.04]):
        b = K.binarize(b, [c], t)
    return b


POLY = ["l_quantity", "l_discount", "l_tax"]


def _poly_names():
    out = []
    for i, a in enumerate(POLY):
        for b in POLY[i:]:
            out.append((f"{a}^2" if a == b else f"{a}*{b}", f"{a} * {b}"))
    return out


@register("poly2_lineitem", _sel({n: e for n, e in _poly_names()}, 6))
def poly2_lineitem(spark, sf):
    p = K.poly2(base(spark, sf).select(*KEYS, *POLY), POLY)
    return p.select(*KEYS, *[F.round(F.col(f"`{n}`"), 6).alias(n) for n, _ in _poly_names()])


@register("zero_count_lineitem", "SELECT l_orderkey, l_linenumber, " +
          "(" + " + ".join(f"CASE WHEN {c} <> 0 THEN 1 ELSE 0 END" for c in COLS) + ") AS non_zero, " +
          f"{len(COLS)} - (" + " + ".join(f"CASE WHEN {c} <> 0 THEN 1 ELSE 0 END" for c in COLS) + ") AS zero_count "
          "FROM lineitem")
def zero_count_lineitem(spark, sf):
    return K.zero_count(base(spark, sf), COLS).select(*KEYS, "non_zero", "zero_count")


@register("variances_lineitem", " UNION ALL ".join(
    f"SELECT '{c}' AS column, round(var_pop({c}), 4) AS variance FROM lineitem" for c in COLS))
def variances_lineitem(spark, sf):
    return K.variances(base(spark, sf), COLS).withColumn("variance", r4("variance"))


@register("variance_threshold_lineitem", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem""")
def variance_threshold_lineitem(spark, sf):
    return K.variance_threshold(base(spark, sf), COLS, threshold=0.01)


def _anova_sql():
    parts = []
    for c in COLS:
        parts.append(f"""SELECT '{c}' AS feature, round(((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1))
          / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))), 4) AS f, count(*) - 1 AS df_between,
          CAST(sum(n) - count(*) AS BIGINT) AS df_within
        FROM (SELECT label, count(*) AS n, sum({c}) AS s, sum({c} * {c}) AS q FROM {LABELLED_LINEITEM_SQL} GROUP BY label)""")
    return " UNION ALL ".join(parts)


@register("anova_f_lineitem", _anova_sql())
def anova_f_lineitem(spark, sf):
    a = K.anova_f(labelled_lineitem(spark, sf), COLS, "label")
    return a.select("feature", r4("f").alias("f"), F.col("df_between").cast("long").alias("df_between"),
                    F.col("df_within").cast("long").alias("df_within"))


@register("select_fwe_lineitem")
def select_fwe_lineitem(spark, sf):
    return K.select_fwe(labelled_lineitem(spark, sf), COLS, "label", alpha=0.05)


@register("select_percentile_lineitem")
def select_percentile_lineitem(spark, sf):
    return K.select_percentile(labelled_lineitem(spark, sf), COLS, "label", percentile=50)


@register("rfe_lineitem")
def rfe_lineitem(spark, sf):
    return K.rfe(labelled_lineitem(spark, sf), COLS, "label", step=1, keep=2, num_trees=10)


@register("pca_lineitem")
def pca_lineitem(spark, sf):
    return K.pca(base(spark, sf), COLS, 2).select(*KEYS, "pc0", "pc1")


RFF_COLS = ["l_discount", "l_tax"]


def _rff_sql(gamma=1.0, d=4, seed=11):
    rng = np.random.RandomState(seed)
    W = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(len(RFF_COLS), d))
    b = rng.uniform(0.0, 2 * math.pi, size=d)
    sc = math.sqrt(2.0 / d)
    exprs = {}
    for j in range(d):
        lin = " + ".join(f"{c} * {float(W[i, j])!r}" for i, c in enumerate(RFF_COLS)) + f" + {float(b[j])!r}"
        exprs[f"rff{j}"] = f"cos({lin}) * {sc!r}"
    return _sel(exprs, 6)


@register("rbf_features_lineitem", _rff_sql())
def rbf_features_lineitem(spark, sf):
    r = K.rbf_features(base(spark, sf), RFF_COLS, gamma=1.0, n_components=4, seed=11)
    return r.select(*KEYS, *[F.round(f"rff{j}", 6).alias(f"rff{j}") for j in range(4)])


@register("nystroem_lineitem")
def nystroem_lineitem(spark, sf):
    li = base(spark, sf).withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    n = K.nystroem(li, ["l_discount", "l_tax"], "key", gamma=10.0, n_components=5, seed=1)
    return n.select(*KEYS, *[f"ny{j}" for j in range(5)])


@register("agglomerate_lineitem")
def agglomerate_lineitem(spark, sf):
    a = K.agglomerate(base(spark, sf), COLS, 2)
    return a.select(*KEYS, "agg0", "agg1")


@register("stack_lineitem")
def stack_lineitem(spark, sf):
    from pyspark.ml.classification import DecisionTreeClassifier
    s = K.stack(labelled_lineitem(spark, sf), COLS, "label", DecisionTreeClassifier(maxDepth=3, seed=0))
    return s.select(*KEYS, "stack_pred", "stack_p0", "stack_p1")


@register("feature_union_lineitem", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    [f"round({c}, 4) AS {c}" for c in COLS] +
    [f"round(({c} - (SELECT min({c}) FROM lineitem)) / ((SELECT max({c}) FROM lineitem) - (SELECT min({c}) FROM lineitem)), 4)"
     f" AS mm_{c}" for c in COLS] +
    [f"CASE WHEN {c} > 0 THEN 1 ELSE 0 END AS bin_{c}" for c in COLS]) + " FROM lineitem")
def feature_union_lineitem(spark, sf):
    u = K.feature_union(base(spark, sf), COLS, [("mm", K.minmax_scale), ("bin", K.binarize)])
    return u.select(*KEYS, *[r4(c).alias(c) for c in COLS], *[r4(f"mm_{c}").alias(f"mm_{c}") for c in COLS],
                    *[f"bin_{c}" for c in COLS])
