"""Pipeline search, early stopping and saved models on planted rules where parameters matter and the outcome is known in SQL."""

from __future__ import annotations

from pyspark.ml import feature as MF
from pyspark.sql import functions as F

from tabforge.operators import models as L
from tabforge.operators import search as R
from tabforge.operators import validate as V
from tabforge.plans.q_fitted import COLS, PLANTED_SQL, PREDICT_SQL, folded, planted
from tabforge.plans.registry import ORACLES, register
from tabforge.plans.tables import LABELLED_ORDERS_SQL, labelled_orders, load
from tabforge.sources import io as A

# --- M7: the label is a band of the quantity. A tree needs two levels to see it; binarizing hides it; depth 1 and
# binarized input can only say 0, as most rows on either side of any cut are.
BAND_SQL = "(SELECT o_orderkey, o_custkey % 50 AS q, o_orderkey % 7 AS noise, CAST(o_custkey % 50 BETWEEN 20 AND 29 AS INTEGER) AS label FROM orders)"
N_FOLDS = 9


def band(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).cast("double").alias("q"), (F.col("o_orderkey") % 7).cast("double").alias("noise"))
    return V.stratified_folds(o.withColumn("label", F.col("q").between(20, 29).cast("int")), "label", "o_orderkey", N_FOLDS)


def _tree(**p):
    return L.tree(seed=0, maxBins=64, **p)


def space():
    return R.Space([R.Step("binarize", R._same(MF.Binarizer), {"threshold": R.Choice((25.0, 40.0))}), R.Step("maxabs", R._same(MF.MaxAbsScaler))],
                   [R.Step("tree", R._same(_tree), {"maxDepth": R.Whole(1, 3), "impurity": R.Choice(("gini", "entropy"))})], max_transformers=1)


PATIENCE, SEED, DRAWS = 4, 5, 12


def _search_sql():
    """Every candidate's score from its parameters alone; the search stops ``PATIENCE`` candidates after the first winner."""
    rows = []
    for k, c in enumerate(R.draw(space(), DRAWS, SEED)):
        names = [s.name for s, _ in c.steps]
        rows.append(f"({k}, '{c}', {'binarize' not in names and c.steps[-1][1]['maxDepth'] >= 2})".replace("True", "true").replace("False", "false"))
    return f"""
WITH c(step, pipeline, wins) AS (VALUES {', '.join(rows)}),
     f AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY o_orderkey) - 1) % {N_FOLDS} AS fold FROM {BAND_SQL}),
     m AS (SELECT avg(s) AS zero FROM (SELECT fold, avg(1 - label) AS s FROM f GROUP BY fold)),
     s AS (SELECT step, pipeline, CASE WHEN wins THEN 1 ELSE zero END AS mean FROM c, m),
     b AS (SELECT *, max(mean) OVER (ORDER BY step) AS best_so_far FROM s),
     l AS (SELECT *, max(CASE WHEN better THEN step END) OVER (ORDER BY step) AS last FROM (
       SELECT *, best_so_far > coalesce(lag(best_so_far) OVER (ORDER BY step), -1) AS better FROM b))
SELECT step, pipeline, round(mean, 6) AS mean, round(best_so_far, 6) AS best_so_far FROM l
WHERE step <= coalesce((SELECT min(step) FROM l WHERE step - last >= {PATIENCE}), {DRAWS})"""


def found(spark, sf):
    return R.search(band(spark, sf), space(), ["q", "noise"], "label", "fold", n=DRAWS, seed=SEED, patience=PATIENCE)


@register("search_space_planted", _search_sql())
def search_space_planted(spark, sf):
    return found(spark, sf)[0].select("step", "pipeline", F.round("mean", 6).alias("mean"), F.round("best_so_far", 6).alias("best_so_far"))


@register("search_best_model_planted", f"SELECT o_orderkey, label AS prediction FROM {BAND_SQL}")
def search_best_model_planted(spark, sf):
    """The best pipeline, saved and loaded, must have learned the rule exactly."""
    _, best, _ = found(spark, sf)
    path = A.save_fitted(spark, best, A.scratch_dir(spark, "best"))
    return A.load_fitted(spark, path).transform(L.with_label(band(spark, sf), "label")).select("o_orderkey", F.col("prediction").cast("int").alias("prediction"))


# --- grid over the parameters of two stages: a transformer's and the model's
@register("grid_two_stages_planted", f"""
WITH f AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY o_orderkey) - 1) % {N_FOLDS} AS fold FROM {BAND_SQL}),
     m AS (SELECT avg(s) AS zero FROM (SELECT fold, avg(1 - label) AS s FROM f GROUP BY fold))
SELECT 'degree=' || g || ', maxDepth=' || d AS params, round(CASE WHEN d > 1 THEN 1 ELSE zero END, 6) AS score
FROM m, (VALUES (1), (2)) a(g), (VALUES (1), (2)) b(d)""")
def grid_two_stages_planted(spark, sf):
    from pyspark.ml import Pipeline
    pipe = Pipeline(stages=[MF.VectorAssembler(inputCols=["q"], outputCol="_v"), MF.PolynomialExpansion(inputCol="_v", outputCol="features"), _tree(labelCol="label")])
    table, _ = L.grid_search(band(spark, sf), pipe, {"1.degree": [1, 2], "maxDepth": [1, 2]}, ["q"], "label", "fold")
    return table.select("params", F.round("score", 6).alias("score"))


# --- K12 with a fraction: 4 features, half of them go each round
@register("rfe_fraction_planted", """
SELECT * FROM (VALUES ('q', 1), ('noise', 2), ('one', 2), ('two', 2)) r(feature, rank) WHERE (SELECT count(*) FROM orders) > 0""")
def rfe_fraction_planted(spark, sf):
    from tabforge.operators import preprocess as K
    d = band(spark, sf).withColumn("one", F.lit(1.0)).withColumn("two", F.lit(2.0))
    return K.rfe(d, ["q", "noise", "one", "two"], "label", step=0.75, keep=1, num_trees=10)


# --- L6: boosting on one flag has a closed form: per flag value F1 = mean of y, then F += rate * mean of the gradient.
# In the rows kept for validation the flag means less, so their loss falls and rises again.
ROUNDS, RATE, WAIT = 30, 0.3, 5
DRIFT_SQL = f"""(SELECT o_orderkey, flag, o_orderkey % 4 = 0 AS valid,
  CAST(CASE WHEN flag = 1 THEN u < CASE WHEN o_orderkey % 4 = 0 THEN 60 ELSE 85 END ELSE u < CASE WHEN o_orderkey % 4 = 0 THEN 40 ELSE 10 END END AS INTEGER) AS label
  FROM (SELECT o_orderkey, (o_orderkey * 37) % 101 AS u, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS flag FROM orders))"""


def drift(spark, sf):
    flag, valid = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int"), F.col("o_orderkey") % 4 == 0
    o = load(spark, sf, "orders").select("o_orderkey", flag.cast("double").alias("flag"), valid.alias("valid"), ((F.col("o_orderkey") * 37) % 101).alias("u"))
    limit = F.when(F.col("flag") == 1, F.when(F.col("valid"), 60).otherwise(85)).otherwise(F.when(F.col("valid"), 40).otherwise(10))
    return o.select("o_orderkey", "flag", "valid", (F.col("u") < limit).cast("int").alias("label"))


BOOST_SQL = f"""
WITH RECURSIVE d AS {DRIFT_SQL},
     p AS (SELECT flag, avg(label) FILTER (NOT valid) AS p, avg(label) FILTER (valid) AS pv, count(*) FILTER (valid) AS nv FROM d GROUP BY flag),
     b(flag, iteration, f) AS (SELECT flag, 1, 2 * p - 1 FROM p UNION ALL
       SELECT b.flag, iteration + 1, f + {RATE} * (p * 4 / (1 + exp(2 * f)) - (1 - p) * 4 / (1 + exp(-2 * f))) FROM b JOIN p ON b.flag = p.flag
       WHERE iteration < {ROUNDS}),
     l AS (SELECT iteration, sum(nv * (pv * 2 * ln(1 + exp(-2 * f)) + (1 - pv) * 2 * ln(1 + exp(2 * f)))) / sum(nv) AS loss
       FROM b JOIN p ON b.flag = p.flag GROUP BY iteration),
     r AS (SELECT *, min(loss) OVER (ORDER BY iteration) AS least FROM l),
     g AS (SELECT *, max(CASE WHEN loss = least THEN iteration END) OVER (ORDER BY iteration) AS hit FROM r),
     e AS (SELECT coalesce(min(iteration) FILTER (iteration - hit >= {WAIT}), {ROUNDS}) AS stop FROM g),
     t AS (SELECT max(hit) AS best FROM g, e WHERE iteration <= stop)"""


@register("boost_early_stop_planted", BOOST_SQL + " SELECT iteration, round(loss, 5) AS valid_loss, iteration = best AS best FROM l, t")
def boost_early_stop_planted(spark, sf):
    d = drift(spark, sf)
    table, _, _ = R.boost_with_early_stop(d.where("not valid"), d.where("valid"), ["flag"], "label", patience=WAIT,
                                          maxIter=ROUNDS, maxDepth=1, stepSize=RATE, seed=0)
    return table.select("iteration", F.round("valid_loss", 5).alias("valid_loss"), "best")


@register("boost_truncated_planted", BOOST_SQL + """
 SELECT o_orderkey, round(1 / (1 + exp(-2 * f)), 5) AS p1 FROM d JOIN b ON d.flag = b.flag, t WHERE iteration = best""")
def boost_truncated_planted(spark, sf):
    """The truncated model, saved and loaded, gives the staged sum at the best iteration."""
    from pyspark.ml.functions import vector_to_array
    d = drift(spark, sf)
    _, model, _ = R.boost_with_early_stop(d.where("not valid"), d.where("valid"), ["flag"], "label", patience=WAIT,
                                          maxIter=ROUNDS, maxDepth=1, stepSize=RATE, seed=0)
    model = A.load_fitted(spark, A.save_fitted(spark, model, A.scratch_dir(spark, "boost")))
    return model.transform(d).select("o_orderkey", F.round(vector_to_array("probability")[1], 5).alias("p1"))


# --- A6: models other than pipelines of Spark ML's own stages, saved, loaded, and used
def _reloaded(spark, model):
    return A.load_fitted(spark, A.save_fitted(spark, model, A.scratch_dir(spark, "fitted")))


@register("reload_rbf_svm_planted", PREDICT_SQL)
def reload_rbf_svm_planted(spark, sf):
    d = L.with_label(planted(spark, sf), "label")
    m = _reloaded(spark, L.rbf_svm(COLS, d.count(), gamma=0.5, C=1.0, n_components=20).fit(d))
    return m.transform(d).select("o_orderkey", F.col("prediction").cast("int").alias("prediction"))


@register("reload_adaboost_planted", PREDICT_SQL)
def reload_adaboost_planted(spark, sf):
    d = planted(spark, sf)
    m = _reloaded(spark, L.adaboost(d, COLS, "label", "o_orderkey", depth=1, rounds=3))
    return L.adaboost_predict(m, d, COLS, "o_orderkey").select("o_orderkey", "prediction")


@register("reload_naive_bayes_planted", f"""
WITH s AS (SELECT label, count(*) AS n, sum(flag) AS k, sum(count(*)) OVER () AS t FROM {PLANTED_SQL} GROUP BY label),
     p AS (SELECT o_orderkey, label, ln(n / t) + flag * ln((k + 1) / (n + 2)) + (1 - flag) * ln(1 - (k + 1) / (n + 2)) + ln((n + 1) / (n + 2)) AS s
           FROM (SELECT o_orderkey, flag FROM {PLANTED_SQL}), s)
SELECT o_orderkey, arg_max(label, s) AS prediction FROM p GROUP BY o_orderkey""")
def reload_naive_bayes_planted(spark, sf):
    d = planted(spark, sf)
    return L.nb_predict(_reloaded(spark, L.bernoulli_nb_fit(d, COLS, "label")), d, "o_orderkey").select("o_orderkey", "prediction")


def _lda_data(spark, sf):
    return labelled_orders(spark, sf).select("o_orderkey", "label", (F.col("o_totalprice") / 100000).alias("a"), (F.col("c_acctbal") / 1000).alias("b"))


@register("reload_lda_orders", ORACLES["lda_closed_form_orders"])
def reload_lda_orders(spark, sf):
    d = _lda_data(spark, sf)
    return L.lda_predict(_reloaded(spark, L.lda_fit(d, ["a", "b"], "label")), d, "o_orderkey")


# --- L5 with three classes: the label is the third of the flagged remainder, which a depth-2 tree separates
@register("adaboost_three_classes_orders", "SELECT o_orderkey, CAST(o_orderkey % 30 // 10 AS INTEGER) AS prediction FROM orders")
def adaboost_three_classes_orders(spark, sf):
    d = load(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 30).cast("double").alias("r"), F.expr("cast(o_orderkey % 30 div 10 as int)").alias("label"))
    m = L.adaboost(d, ["r"], "label", "o_orderkey", depth=1, rounds=12)
    return L.adaboost_predict(m, d, ["r"], "o_orderkey").select("o_orderkey", "prediction")


# --- L12 without smoothing: what a class never shows rules it out
@register("naive_bayes_unsmoothed_orders", f"""
WITH d AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS label, CAST(o_orderstatus = 'O' AS INTEGER) AS x, CAST(o_orderkey % 3 = 0 AS INTEGER) AS z FROM orders),
     s AS (SELECT label, count(*) AS n, sum(x) AS kx, sum(z) AS kz, sum(count(*)) OVER () AS t FROM d GROUP BY label),
     p AS (SELECT o_orderkey, s.label, n / t * CASE WHEN x = 1 THEN kx / n ELSE 1 - kx / n END * CASE WHEN z = 1 THEN kz / n ELSE 1 - kz / n END AS s FROM d, s)
SELECT o_orderkey, arg_max(label, s) AS prediction, round(max(s) FILTER (label = 1) / sum(s), 6) AS p1 FROM p GROUP BY o_orderkey""")
def naive_bayes_unsmoothed_orders(spark, sf):
    d = load(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"),
                                         (F.col("o_orderstatus") == "O").cast("int").alias("x"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("z"))
    return L.bernoulli_nb(d, d, ["x", "z"], "label", "o_orderkey", alpha=0.0).select("o_orderkey", "prediction", F.round("p1", 6).alias("p1"))
