"""Fitted operators on a planted rule, where the fit is known in closed form or is the majority label per flag value.

``flag`` is 0/1 and ``one`` constant, so every sound classifier must predict the label most rows of a flag value have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators import features as J
from tabforge.operators import models as L
from tabforge.operators import preprocess as K
from tabforge.operators import validate as V
from tabforge.plans.registry import register
from tabforge.plans.tables import LABELLED_ORDERS_SQL, labelled_orders, load
from tabforge.sources import io as A

COLS = ["flag", "one"]
FOLDS = 9

PLANTED_SQL = """(SELECT o_orderkey, CAST(flag AS DOUBLE) AS flag, CAST(1 AS DOUBLE) AS one,
  CAST(CASE WHEN flag = 1 THEN u < 70 ELSE u < 20 END AS INTEGER) AS label
  FROM (SELECT o_orderkey, (o_orderkey * 37) % 101 AS u, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS flag FROM orders))"""
RULE_SQL = f"(SELECT flag, CAST(avg(label) > 0.5 AS INTEGER) AS prediction FROM {PLANTED_SQL} GROUP BY flag)"
PREDICT_SQL = f"SELECT o_orderkey, prediction FROM {PLANTED_SQL} JOIN {RULE_SQL} USING (flag)"
FOLD_SCORE_SQL = f"""(SELECT fold, avg(CAST(prediction = label AS DOUBLE)) AS score FROM (
  SELECT flag, label, CAST((row_number() OVER (PARTITION BY label ORDER BY o_orderkey) - 1) % {FOLDS} AS INTEGER) AS fold
  FROM {PLANTED_SQL}) JOIN {RULE_SQL} USING (flag) GROUP BY fold)"""
KEPT_SQL = f"""
SELECT 'flag' AS feature, abs(corr(flag, label)) > 0 AS keep FROM {PLANTED_SQL} UNION ALL SELECT 'one' AS feature, false AS keep"""


def planted(spark, sf) -> DataFrame:
    flag = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")
    o = load(spark, sf, "orders").select("o_orderkey", flag.alias("flag"), ((F.col("o_orderkey") * 37) % 101).alias("u"))
    return o.select("o_orderkey", F.col("flag").cast("double").alias("flag"), F.lit(1.0).alias("one"),
                    F.when(F.col("flag") == 1, F.col("u") < 70).otherwise(F.col("u") < 20).cast("int").alias("label"))


def folded(spark, sf) -> DataFrame:
    return V.stratified_folds(planted(spark, sf), "label", "o_orderkey", FOLDS)


ESTIMATORS = {
    "logreg": lambda: L.logreg(), "tree": lambda: L.tree(maxDepth=3, seed=0),
    "forest": lambda: L.forest(numTrees=10, maxDepth=3, seed=0),
    "forest_no_bootstrap": lambda: L.forest_no_bootstrap(numTrees=10, maxDepth=3, seed=0),
    "boosted_trees": lambda: L.boosted_trees(maxIter=5, maxDepth=2, seed=0), "linear_svm": lambda: L.linear_svm(maxIter=100),
    "mlp": lambda: L.mlp([2, 4, 2], maxIter=100, seed=1),
}


def _fit_query(make):
    def run(spark, sf):
        d = L.with_label(planted(spark, sf), "label")
        return L.assembled(make(), COLS).fit(d).transform(d).select("o_orderkey", F.col("prediction").cast("int").alias("prediction"))
    return run


for _name, _make in ESTIMATORS.items():
    register(f"fit_{_name}_planted", PREDICT_SQL)(_fit_query(_make))


@register("fit_rbf_svm_planted", PREDICT_SQL)
def fit_rbf_svm_planted(spark, sf):
    d = L.with_label(planted(spark, sf), "label")
    m = L.rbf_svm(COLS, d.count(), gamma=0.5, C=1.0, n_components=20).fit(d)
    return m.transform(d).select("o_orderkey", F.col("prediction").cast("int").alias("prediction"))


@register("fit_adaboost_planted", PREDICT_SQL)
def fit_adaboost_planted(spark, sf):
    d = planted(spark, sf)
    return L.adaboost_predict(L.adaboost(d, COLS, "label", "o_orderkey", depth=1, rounds=3), d, COLS, "o_orderkey").select(
        "o_orderkey", "prediction")


@register("reload_model_planted", PREDICT_SQL)
def reload_model_planted(spark, sf):
    d = L.with_label(planted(spark, sf), "label")
    path = A.save_model(L.assembled(L.tree(maxDepth=3, seed=0), COLS).fit(d), A.scratch_dir(spark, "model"))
    return A.load_model(path).transform(d).select("o_orderkey", F.col("prediction").cast("int").alias("prediction"))


@register("logreg_log_odds_planted", f"""
WITH p AS (SELECT flag, avg(label) AS p FROM {PLANTED_SQL} GROUP BY flag),
     o AS (SELECT flag, ln(p / (1 - p)) AS odds FROM p)
SELECT round(max(odds) FILTER (flag = 0), 3) AS intercept,
       round(max(odds) FILTER (flag = 1) - max(odds) FILTER (flag = 0), 3) AS weight FROM o""")
def logreg_log_odds_planted(spark, sf):
    m = L.assembled(L.logreg(maxIter=200, tol=1e-10), ["flag"]).fit(L.with_label(planted(spark, sf), "label")).stages[-1]
    return spark.createDataFrame([(round(float(m.intercept), 3), round(float(m.coefficients[0]), 3))], "intercept double, weight double")


@register("lda_closed_form_orders", f"""
WITH d AS (SELECT o_orderkey, label, o_totalprice / 100000 AS a, c_acctbal / 1000 AS b FROM {LABELLED_ORDERS_SQL}),
     s AS (SELECT label, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) AS saa, var_pop(b) * count(*) AS sbb,
                  covar_pop(a, b) * count(*) AS sab FROM d GROUP BY label),
     w AS (SELECT sum(saa) / (sum(n) - 2) AS aa, sum(sbb) / (sum(n) - 2) AS bb, sum(sab) / (sum(n) - 2) AS ab, sum(n) AS n FROM s),
     c AS (SELECT label, (bb * ma - ab * mb) / (aa * bb - ab * ab) AS wa, (aa * mb - ab * ma) / (aa * bb - ab * ab) AS wb, ma, mb,
                  ln(s.n / w.n) AS prior FROM s, w)
SELECT o_orderkey, arg_max(c.label, a * wa + b * wb - 0.5 * (ma * wa + mb * wb) + prior) AS prediction FROM d, c GROUP BY o_orderkey""")
def lda_closed_form_orders(spark, sf):
    d = labelled_orders(spark, sf).select("o_orderkey", "label", (F.col("o_totalprice") / 100000).alias("a"), (F.col("c_acctbal") / 1000).alias("b"))
    return L.lda_predict(L.lda_fit(d, ["a", "b"], "label"), d, "o_orderkey")


@register("importances_planted", f"""
SELECT model, feature, CAST(feature = 'flag' AND keep AS INTEGER) AS importance
FROM (VALUES ('forest'), ('boosted_trees')) m(model), ({KEPT_SQL})""")
def importances_planted(spark, sf):
    d = L.with_label(planted(spark, sf), "label")
    rows = [r for m in ("forest", "boosted_trees") for r in L.importances(L.assembled(ESTIMATORS[m](), COLS).fit(d), COLS, m)]
    return spark.createDataFrame(rows, "model string, feature string, importance double").select(
        "model", "feature", F.round("importance", 6).cast("int").alias("importance"))


def _select_query(model):
    def run(spark, sf):
        return J.select_from_model(planted(spark, sf), COLS, "label", model=model, num_trees=5).select("feature", "keep")
    return run


for _model in ("linear_svm", "boosted_trees", "forest"):
    register(f"select_{_model}_planted", KEPT_SQL)(_select_query(_model))


@register("select_percentile_planted", f"""
WITH r AS (SELECT abs(corr(flag, label)) AS f, abs(corr(o_orderkey % 7, label)) AS s FROM {PLANTED_SQL})
SELECT 'flag' AS feature, f > s AS keep FROM r UNION ALL SELECT 'seven' AS feature, f <= s AS keep FROM r""")
def select_percentile_planted(spark, sf):
    d = planted(spark, sf).withColumn("seven", (F.col("o_orderkey") % 7).cast("double"))
    return K.select_percentile(d, ["flag", "seven"], "label", percentile=50)


@register("rfe_planted", f"SELECT feature, CAST(CASE WHEN keep THEN 1 ELSE 2 END AS INTEGER) AS rank FROM ({KEPT_SQL})")
def rfe_planted(spark, sf):
    return K.rfe(planted(spark, sf), COLS, "label", step=1, keep=1, num_trees=5)


@register("stack_planted", f"""
SELECT o_orderkey, CAST(p > 0.5 AS DOUBLE) AS stack_pred, round(1 - p, 6) AS stack_p0, round(p, 6) AS stack_p1
FROM {PLANTED_SQL} JOIN (SELECT flag, avg(label) AS p FROM {PLANTED_SQL} GROUP BY flag) USING (flag)""")
def stack_planted(spark, sf):
    s = K.stack(planted(spark, sf), COLS, "label", L.tree(maxDepth=3, seed=0))
    return s.select("o_orderkey", "stack_pred", F.round("stack_p0", 6).alias("stack_p0"), F.round("stack_p1", 6).alias("stack_p1"))


# --- M4-M7: every fold's model is the planted rule -------------------------------------------------------
@register("cross_validate_planted", f"""
SELECT model, fold, round(score, 6) AS score FROM {FOLD_SCORE_SQL}, (VALUES ('logreg'), ('tree')) m(model)""")
def cross_validate_planted(spark, sf):
    cv = L.cross_validate(folded(spark, sf), {m: ESTIMATORS[m]() for m in ("logreg", "tree")}, COLS, "label", "fold")
    return cv.select("model", "fold", F.round("score", 6).alias("score"))


@register("grid_search_planted", f"""
SELECT 'impurity=' || i || ', maxDepth=' || d AS params, round(s, 6) AS score
FROM (SELECT avg(score) AS s FROM {FOLD_SCORE_SQL}), (VALUES ('gini'), ('entropy')) a(i), (VALUES (1), (3)) b(d)""")
def grid_search_planted(spark, sf):
    table, _ = L.grid_search(folded(spark, sf), L.tree(seed=0), {"maxDepth": [1, 3], "impurity": ["gini", "entropy"]}, COLS, "label", "fold")
    return table.select("params", F.round("score", 6).alias("score"))


@register("random_search_planted", f"SELECT round(avg(score), 6) AS score FROM {FOLD_SCORE_SQL}, range(3) GROUP BY range")
def random_search_planted(spark, sf):
    table, _ = L.random_search(folded(spark, sf), L.tree(seed=0), {"maxDepth": (1, 5, "int")}, COLS, "label", "fold", n_iter=3, seed=2)
    return table.select(F.round("score", 6).alias("score"))


@register("pipeline_search_planted", f"""
SELECT CAST(range AS INTEGER) AS step, round(avg(score), 6) AS score, round(avg(score), 6) AS best_so_far
FROM {FOLD_SCORE_SQL}, range(3) GROUP BY range""")
def pipeline_search_planted(spark, sf):
    cands = {"tree": lambda c: L.tree(maxDepth=2, seed=0), "logreg": lambda c: L.logreg()}
    t = L.pipeline_search(folded(spark, sf), cands, COLS, "label", "fold", n=3, seed=1, patience=3)
    return t.select("step", F.round("score", 6).alias("score"), F.round("best_so_far", 6).alias("best_so_far"))


# --- K14, K16, K17 in closed form ------------------------------------------------------------------------
LINE_SQL = """(SELECT l_orderkey, l_linenumber, l_quantity / 10 AS a, l_extendedprice / 10000 AS b, l_discount * 20 AS c FROM lineitem)"""


def line(spark, sf) -> DataFrame:
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("a"),
                                              (F.col("l_extendedprice") / 10000).alias("b"), (F.col("l_discount") * 20).alias("c"))


@register("pca_closed_form_lineitem", f"""
WITH s AS (SELECT var_samp(a) AS aa, covar_samp(a, b) AS ab, var_samp(b) AS bb FROM {LINE_SQL}),
     e AS (SELECT ab, (aa + bb + sqrt((aa - bb) ^ 2 + 4 * ab ^ 2)) / 2 - aa AS y FROM s),
     v AS (SELECT ab / sqrt(ab ^ 2 + y ^ 2) AS va, y / sqrt(ab ^ 2 + y ^ 2) AS vb FROM e)
SELECT l_orderkey, l_linenumber, round(abs(a * va + b * vb), 4) AS pc0, round(abs(b * va - a * vb), 4) AS pc1 FROM {LINE_SQL}, v""")
def pca_closed_form_lineitem(spark, sf):
    p = K.pca(line(spark, sf), ["a", "b"], 2)  # signs are arbitrary
    return p.select("l_orderkey", "l_linenumber", F.round(F.abs("pc0"), 4).alias("pc0"), F.round(F.abs("pc1"), 4).alias("pc1"))


@register("agglomerate_closed_form_lineitem", f"""
WITH s AS (SELECT sum((a - b) ^ 2) AS ab, sum((a - c) ^ 2) AS ac, sum((b - c) ^ 2) AS bc FROM {LINE_SQL})
SELECT l_orderkey, l_linenumber,
  round(CASE WHEN ab <= ac AND ab <= bc THEN (a + b) / 2 WHEN ac <= bc THEN (a + c) / 2 ELSE a END, 6) AS agg0,
  round(CASE WHEN ab <= ac AND ab <= bc THEN c WHEN ac <= bc THEN b ELSE (b + c) / 2 END, 6) AS agg1 FROM {LINE_SQL}, s""")
def agglomerate_closed_form_lineitem(spark, sf):
    g = K.agglomerate(line(spark, sf), ["a", "b", "c"], 2)
    return g.select("l_orderkey", "l_linenumber", F.round("agg0", 6).alias("agg0"), F.round("agg1", 6).alias("agg1"))


@register("nystroem_kernel_orders", f"""
WITH d AS (SELECT o_orderkey, o_totalprice / 100000 AS a, c_acctbal / 5000 AS b FROM {LABELLED_ORDERS_SQL}),
     m AS (SELECT a, b, row_number() OVER (ORDER BY md5('1#' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS j FROM d),
     l AS (SELECT * FROM m WHERE j < 4)
SELECT o_orderkey, {", ".join(f"round(max(exp(-0.5 * ((d.a - l.a) ^ 2 + (d.b - l.b) ^ 2))) FILTER (j = {j}), 4) AS k{j}" for j in range(4))}
FROM d, l GROUP BY o_orderkey""")
def nystroem_kernel_orders(spark, sf):
    # A row's features times a landmark's are the kernel of the two.
    d = labelled_orders(spark, sf).select("o_orderkey", (F.col("o_totalprice") / 100000).alias("a"), (F.col("c_acctbal") / 5000).alias("b"))
    z = K.nystroem(d, ["a", "b"], "o_orderkey", gamma=0.5, n_components=4, seed=1)
    marks = z.orderBy(F.md5(F.concat(F.lit("1#"), F.col("o_orderkey").cast("string"))), "o_orderkey").limit(4).collect()
    return z.select("o_orderkey", *[F.round(sum(F.col(f"ny{i}") * float(m[f"ny{i}"]) for i in range(4)), 4).alias(f"k{j}")
                                    for j, m in enumerate(marks)])
