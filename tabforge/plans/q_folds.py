"""Nine-fold scores and grids on real columns, every row scored by models that never saw it (M4, M5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import folds as X
from tabforge.operators import newton as N
from tabforge.operators import summarize as S
from tabforge.operators import validate as V
from tabforge.plans.registry import register
from tabforge.plans.tables import LABELLED_ORDERS_SQL, labelled_orders, load

K = 9
FOLD_SQL = f"(row_number() OVER (PARTITION BY label ORDER BY key) - 1) % {K} AS fold"


def _rounded(scores):
    return scores.select("params", F.col("fold").cast("long").alias("fold"), F.round("score", 6).alias("score"))


# --- k-NN: 3 numbers of neighbours x 2 weightings
KS, KNN_COLS = [10, 15, 20], ["nation", "balance"]
CUSTOMERS_SQL = """(SELECT c_custkey AS key, CAST(c_nationkey AS DOUBLE) AS nation, c_acctbal / 1000 AS balance,
  CAST(c_mktsegment IN ('BUILDING', 'MACHINERY') AS INTEGER) AS label FROM customer)"""


def customers(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("double").alias("nation"), (F.col("c_acctbal") / 1000).alias("balance"),
                                           F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("label"))
    return V.stratified_folds(c, "label", "key", K)


KNN_SQL = f"""
WITH d AS (SELECT *, {FOLD_SQL} FROM {CUSTOMERS_SQL}),
     n AS (SELECT a.key, a.label AS truth, a.fold, b.label, sqrt((a.nation - b.nation) ^ 2 + (a.balance - b.balance) ^ 2) AS dist,
             row_number() OVER (PARTITION BY a.key ORDER BY sqrt((a.nation - b.nation) ^ 2 + (a.balance - b.balance) ^ 2), b.key) AS r
           FROM d a JOIN d b ON a.fold <> b.fold QUALIFY r <= {max(KS)}),
     g AS (SELECT k, w FROM (VALUES {', '.join(f'({k})' for k in KS)}) k(k), (VALUES ('uniform'), ('distance')) w(w)),
     z AS (SELECT key, k, bool_or(dist = 0) AS exact FROM n, (SELECT DISTINCT k FROM g) WHERE r <= k GROUP BY key, k),
     t AS (SELECT n.key, truth, fold, label, g.k, g.w, sum(CASE WHEN g.w = 'uniform' THEN 1 WHEN exact THEN CAST(dist = 0 AS DOUBLE) ELSE 1 / dist END) AS v
           FROM n JOIN g ON r <= g.k JOIN z ON z.key = n.key AND z.k = g.k GROUP BY ALL),
     p AS (SELECT key, truth, fold, k, w, arg_max(label, (v, -label)) AS prediction FROM t GROUP BY ALL)
SELECT 'k=' || k || ', weights=' || w AS params, fold, round(avg(CAST(prediction = truth AS DOUBLE)), 6) AS score FROM p GROUP BY k, w, fold"""


@register("knn_grid_customers", KNN_SQL)
def knn_grid_customers(spark, sf):
    return _rounded(X.knn_grid(customers(spark, sf), KNN_COLS, "label", "key", "fold", KS))


@register("knn_grid_best_customers", f"""
SELECT params, round(avg(score), 5) AS mean, round(stddev_pop(score), 5) AS std FROM ({KNN_SQL}) GROUP BY params
QUALIFY row_number() OVER (ORDER BY round(avg(score), 5) DESC, params) = 1""")
def knn_grid_best_customers(spark, sf):
    """The best setting by the mean over folds: smallest name of equal ones."""
    s = S.score_summary(knn_grid_customers(spark, sf), "params")
    return s.select("params", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std")).orderBy(F.desc("mean"), "params").limit(1)


# --- naive Bayes with three smoothings
ALPHAS = [0.01, 1.0, 1000.0]
CARTS_SQL = """(SELECT l_orderkey AS key, CAST(sum(l_extendedprice) > 100000 AS INTEGER) AS label, count(*) AS n_lines, sum(l_quantity) AS quantity,
  sum(round(l_tax * 100)) AS tax_pts, max(round(l_discount * 100)) AS disc_pts FROM lineitem GROUP BY l_orderkey)"""
CUTS = {"n_lines": 3, "quantity": 90, "tax_pts": 14, "disc_pts": 8}


def carts(spark, sf):
    """Orders by their lines: is the price of all of them above 100,000?"""
    d = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(
        (F.sum("l_extendedprice") > 100000).cast("int").alias("label"), F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"),
        F.sum(F.round(F.col("l_tax") * 100)).alias("tax_pts"), F.max(F.round(F.col("l_discount") * 100)).alias("disc_pts"))
    return V.stratified_folds(d, "label", "key", K)


def _nb_sql(kind):
    xs = CUTS
    x = {c: f"CAST({c} - {cut} > 0 AS DOUBLE)" if kind == "bernoulli" else f"CAST({c} AS DOUBLE)" for c, cut in xs.items()}
    if kind == "bernoulli":
        term = " + ".join(f"d.x{i} * ln((s{i} + alpha) / (n + 2 * alpha)) + (1 - d.x{i}) * ln(1 - (s{i} + alpha) / (n + 2 * alpha))" for i in range(len(xs)))
    else:
        everything = " + ".join(f"s{i}" for i in range(len(xs)))
        term = " + ".join(f"d.x{i} * ln((s{i} + alpha) / ({everything} + {len(xs)} * alpha))" for i in range(len(xs)))
    own, train = (", ".join(f(i) for i in range(len(xs))) for f in (lambda i: f"sum(x{i}) AS s{i}", lambda i: f"sum(s{i}) AS s{i}"))
    return f"""
WITH d AS (SELECT key, label, {', '.join(f'{e} AS x{i}' for i, e in enumerate(x.values()))}, {FOLD_SQL} FROM {CARTS_SQL}),
     o AS (SELECT fold, label, count(*) AS n, {own} FROM d GROUP BY fold, label),
     t AS (SELECT f.fold, label, sum(n) AS n, {train} FROM o JOIN (SELECT DISTINCT fold FROM o) f ON o.fold <> f.fold GROUP BY f.fold, label),
     m AS (SELECT *, ln(n / sum(n) OVER (PARTITION BY fold, alpha)) AS prior FROM t, (VALUES {', '.join(f'(CAST({a} AS DOUBLE))' for a in ALPHAS)}) a(alpha)),
     p AS (SELECT d.key, d.label AS truth, d.fold, alpha, arg_max(m.label, prior + {term}) AS prediction FROM d JOIN m ON d.fold = m.fold GROUP BY ALL)
SELECT 'alpha=' || alpha AS params, fold, round(avg(CAST(prediction = truth AS DOUBLE)), 6) AS score FROM p GROUP BY alpha, fold"""


@register("bernoulli_folds_carts", _nb_sql("bernoulli"))
def bernoulli_folds_carts(spark, sf):
    d = carts(spark, sf)
    return _rounded(X.naive_bayes_folds(d.withColumns({c: F.col(c) - cut for c, cut in CUTS.items()}), list(CUTS), "label", "fold", "bernoulli", ALPHAS))


@register("multinomial_folds_carts", _nb_sql("multinomial"))
def multinomial_folds_carts(spark, sf):
    return _rounded(X.naive_bayes_folds(carts(spark, sf), list(CUTS), "label", "fold", "multinomial", ALPHAS))


# --- linear discriminants
@register("lda_folds_orders", f"""
WITH d AS (SELECT *, {FOLD_SQL} FROM (SELECT o_orderkey AS key, label, o_totalprice / 100000 AS a, c_acctbal / 1000 AS b FROM {LABELLED_ORDERS_SQL})),
     s AS (SELECT f.fold, label, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) AS saa, var_pop(b) * count(*) AS sbb,
                  covar_pop(a, b) * count(*) AS sab FROM d JOIN (SELECT DISTINCT fold FROM d) f ON d.fold <> f.fold GROUP BY f.fold, label),
     w AS (SELECT fold, sum(saa) / (sum(n) - 2) AS aa, sum(sbb) / (sum(n) - 2) AS bb, sum(sab) / (sum(n) - 2) AS ab, sum(n) AS n FROM s GROUP BY fold),
     c AS (SELECT s.fold, label, (bb * ma - ab * mb) / (aa * bb - ab * ab) AS wa, (aa * mb - ab * ma) / (aa * bb - ab * ab) AS wb, ma, mb,
                  ln(s.n / w.n) AS prior FROM s JOIN w USING (fold)),
     p AS (SELECT key, d.label AS truth, d.fold, arg_max(c.label, a * wa + b * wb - 0.5 * (ma * wa + mb * wb) + prior) AS prediction
           FROM d JOIN c ON c.fold = d.fold GROUP BY ALL)
SELECT fold, round(avg(CAST(prediction = truth AS DOUBLE)), 6) AS score FROM p GROUP BY fold""")
def lda_folds_orders(spark, sf):
    d = labelled_orders(spark, sf).select(F.col("o_orderkey").alias("key"), "label", (F.col("o_totalprice") / 100000).alias("a"), (F.col("c_acctbal") / 1000).alias("b"))
    return _rounded(X.lda_folds(V.stratified_folds(d, "label", "key", K), ["a", "b"], "label", "fold")).drop("params")


# --- linear classifiers, every fold and penalty in the same scans
CS = [0.0001, 1.0, 100.0]
LINEAR = {"a": "n_lines", "b": "quantity"}


@register("ridge_folds_carts", f"""
WITH d AS (SELECT key, label, n_lines AS a, quantity AS b, 2.0 * label - 1 AS y, {FOLD_SQL} FROM {CARTS_SQL}),
     s AS (SELECT f.fold, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, 2 * var_pop(a) * count(*) AS aa, 2 * var_pop(b) * count(*) AS bb,
                  2 * covar_pop(a, b) * count(*) AS ab, 2 * covar_pop(a, y) * count(*) AS ay, 2 * covar_pop(b, y) * count(*) AS by_
           FROM d JOIN (SELECT DISTINCT fold FROM d) f ON d.fold <> f.fold GROUP BY f.fold),
     w AS (SELECT *, ((bb + 1 / c) * ay - ab * by_) / ((aa + 1 / c) * (bb + 1 / c) - ab * ab) AS wa,
                  ((aa + 1 / c) * by_ - ab * ay) / ((aa + 1 / c) * (bb + 1 / c) - ab * ab) AS wb
           FROM s, (VALUES {', '.join(f"('C={c}', CAST({c} AS DOUBLE))" for c in CS)}) g(params, c))
SELECT params, d.fold, round(avg(CAST((my + (a - ma) * wa + (b - mb) * wb > 0) = (label = 1) AS DOUBLE)), 6) AS score
FROM d JOIN w ON w.fold = d.fold GROUP BY params, d.fold""")
def ridge_folds_carts(spark, sf):
    d = carts(spark, sf).withColumnsRenamed({v: k for k, v in LINEAR.items()})
    return _rounded(N.linear_folds(d, list(LINEAR), "label", "fold", "squared", CS))


@register("logistic_folds_carts")
def logistic_folds_carts(spark, sf):
    return _rounded(N.linear_folds(carts(spark, sf), list(CUTS), "label", "fold", "logistic", CS))


@register("linear_svm_folds_carts")
def linear_svm_folds_carts(spark, sf):
    return _rounded(N.linear_folds(carts(spark, sf), list(CUTS), "label", "fold", "squared_hinge", CS))
