"""Split, fold, metric and comparison queries (M*, G14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import combine as J
from tabforge.operators import summarize as S
from tabforge.operators import validate as V
from tabforge.plans.registry import register
from tabforge.plans.tables import LABELLED_ORDERS_SQL, labelled_orders, load


def r4(c):
    return F.round(c, 4)


@register("split_orders_exact", """
WITH n AS (SELECT count(*) AS n FROM orders),
     r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7#' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn
           FROM orders)
SELECT o_orderkey, CASE WHEN rn <= n - ceil((CAST(1.0 AS DOUBLE) - CAST(0.8 AS DOUBLE)) * n) THEN 'train' ELSE 'test' END
       AS part FROM r, n""")
def split_orders_exact(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey")
    return V.split(o, "o_orderkey", 0.8, seed=7)


@register("sample_remainder_orders", """
WITH n AS (SELECT count(*) AS n FROM orders),
     r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('3#' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn
           FROM orders)
SELECT o_orderkey FROM r, n WHERE rn > round(0.35 * n)""")
def sample_remainder_orders(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey")
    sample = V.sample_exact(o, "o_orderkey", 0.35, seed=3)
    return J.remainder(o, sample, "o_orderkey")


FOLDS_SQL = f"""(SELECT o_orderkey, label, o_totalprice, o_orderpriority,
  CAST((row_number() OVER (PARTITION BY label ORDER BY o_orderkey) - 1) % 9 AS INTEGER) AS fold
  FROM {LABELLED_ORDERS_SQL})"""


def folds(spark, sf):
    o = labelled_orders(spark, sf).select("o_orderkey", "label", "o_totalprice", "o_orderpriority")
    return V.stratified_folds(o, "label", "o_orderkey", 9)


@register("stratified_folds_orders", f"SELECT o_orderkey, label, fold FROM {FOLDS_SQL}")
def stratified_folds_orders(spark, sf):
    return folds(spark, sf).select("o_orderkey", "label", "fold")


@register("stratified_folds_shuffled_balance", f"""
SELECT label, fold, count(*) AS n FROM (
  SELECT label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42#' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1)
                     % 5 AS INTEGER) AS fold FROM {LABELLED_ORDERS_SQL}) GROUP BY label, fold""")
def stratified_folds_shuffled_balance(spark, sf):
    o = labelled_orders(spark, sf).select("o_orderkey", "label")
    f = V.stratified_folds(o, "label", "o_orderkey", 5, shuffle_seed=42)
    return f.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


RULES = {"price_rule": "CAST(o_totalprice > 150000 AS INTEGER)",
         "priority_rule": "CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER)"}
def rule_cols():
    return {"price_rule": (F.col("o_totalprice") > 150000).cast("int"),
            "priority_rule": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")}


def fold_scores(spark, sf):
    f = folds(spark, sf)
    parts = [V.accuracy(f.withColumn("pred", expr), "label", "pred", by=["fold"])
             .select(F.lit(name).alias("model"), "fold", F.col("accuracy").alias("score"))
             for name, expr in rule_cols().items()]
    return parts[0].unionByName(parts[1])


FOLD_SCORES_SQL = "(" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, fold, avg(CAST(label = {e} AS DOUBLE)) AS score FROM {FOLDS_SQL} GROUP BY fold"
    for m, e in RULES.items()) + ")"


@register("score_summary_rules", f"""
SELECT model, round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS std, count(score) AS n_folds
FROM {FOLD_SCORES_SQL} GROUP BY model""")
def score_summary_rules(spark, sf):
    s = S.score_summary(fold_scores(spark, sf))
    return s.select("model", r4("mean").alias("mean"), r4("std").alias("std"), "n_folds")


@register("filter_models_rules", f"""
SELECT model, fold, round(score, 4) AS score FROM {FOLD_SCORES_SQL} WHERE score >= 0.34""")
def filter_models_rules(spark, sf):
    s = V.filter_models(fold_scores(spark, sf), "score", 0.34)
    return s.select("model", "fold", r4("score").alias("score"))


@register("accuracy_price_rule", f"""
SELECT round(avg(CAST(label = {RULES['price_rule']} AS DOUBLE)), 4) AS accuracy,
       round(1 - avg(CAST(label = {RULES['price_rule']} AS DOUBLE)), 4) AS error, count(*) AS n
FROM {LABELLED_ORDERS_SQL}""")
def accuracy_price_rule(spark, sf):
    o = labelled_orders(spark, sf).withColumn("pred", rule_cols()["price_rule"])
    a = V.accuracy(o, "label", "pred")
    return a.select(r4("accuracy").alias("accuracy"), r4("error").alias("error"), "n")


SCORE = "((o_totalprice - 150000) / 50000)"


@register("score_metrics_orders", f"""
WITH s AS (SELECT label, {SCORE} AS s FROM {LABELLED_ORDERS_SQL})
SELECT CAST(sum(CAST(CAST((1e-15 + 1 / (1 + exp(-s))) > 0.5 AS INTEGER) = label AS INTEGER)) AS BIGINT) AS correct,
       round(-avg(label * ln(CASE WHEN s >= 0 THEN 1 / (1 + exp(-s)) ELSE exp(s) / (1 + exp(s)) END)
              + (1 - label) * ln(1 - CASE WHEN s >= 0 THEN 1 / (1 + exp(-s)) ELSE exp(s) / (1 + exp(s)) END)), 4)
         AS cross_entropy,
       round(avg(greatest(s, 0) + ln(1 + exp(-abs(s))) - label * s), 4) AS cross_entropy_softplus
FROM s""")
def score_metrics_orders(spark, sf):
    o = labelled_orders(spark, sf).withColumn("s", (F.col("o_totalprice") - 150000) / 50000)
    return o.agg(V.correct_count(o, "label", "s").cast("long").alias("correct"),
                 r4(V.cross_entropy(o, "label", "s")).alias("cross_entropy"),
                 r4(V.cross_entropy(o, "label", "s", form="softplus")).alias("cross_entropy_softplus"))


@register("auc_price_score", f"""
WITH s AS (SELECT label, round(o_totalprice / 1000) AS s FROM {LABELLED_ORDERS_SQL}),
     r AS (SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS ar FROM s),
     c AS (SELECT sum(label) AS p, sum(1 - label) AS n FROM s)
SELECT round((sum(ar) FILTER (WHERE label = 1) - any_value(p) * (any_value(p) + 1) / 2.0)
             / (any_value(p) * any_value(n)), 4) AS auc FROM r, c""")
def auc_price_score(spark, sf):
    o = labelled_orders(spark, sf).withColumn("s", F.round(F.col("o_totalprice") / 1000))
    return V.auc(o, "label", "s").select(r4("auc").alias("auc"))


@register("submission_balance", f"""
SELECT pred AS label, count(*) AS n FROM (SELECT o_orderkey, {RULES['price_rule']} AS pred FROM {LABELLED_ORDERS_SQL})
GROUP BY pred""")
def submission_balance(spark, sf):
    o = labelled_orders(spark, sf).withColumn("pred", rule_cols()["price_rule"])
    sub = V.submission(o, "o_orderkey", "pred", label_name="label")
    return sub.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("agreement_labels", """
WITH j AS (SELECT quality AS p1, 1 - toxic AS p2 FROM labels)
SELECT p1, p2, count(*) AS n, round((SELECT avg(CAST(p1 = p2 AS DOUBLE)) FROM j), 4) AS agreement FROM j GROUP BY p1, p2""")
def agreement_labels(spark, sf):
    lab = load(spark, sf, "labels")
    a = lab.select("doc_id", "quality")
    b = lab.select("doc_id", (1 - F.col("toxic")).alias("clean"))
    return V.agreement(a, b, "doc_id", "quality", "clean").withColumn("agreement", r4("agreement"))


@register("prediction_correlation_rules", f"""
SELECT 'price_rule' AS a, 'priority_rule' AS b, round(corr({RULES['price_rule']}, {RULES['priority_rule']}), 4) AS r,
       round(abs(corr({RULES['price_rule']}, {RULES['priority_rule']})), 4) AS abs_r FROM {LABELLED_ORDERS_SQL}""")
def prediction_correlation_rules(spark, sf):
    o = labelled_orders(spark, sf)
    preds = {m: o.select("o_orderkey", e.alias("pred")) for m, e in rule_cols().items()}
    j = J.join_predictions(preds, "o_orderkey")
    return S.corr_matrix(j, list(rule_cols())).select("a", "b", r4("r").alias("r"), r4("abs_r").alias("abs_r"))
