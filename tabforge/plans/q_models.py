"""Model queries (L*, M4–M7). Exact ones (NB, KNN, voting) carry SQL oracles; fitted models are rows-only."""

from __future__ import annotations


from pyspark.sql import functions as F

from tabforge.operators import models as L
from tabforge.operators import sequence as H
from tabforge.operators import validate as V
from tabforge.plans.registry import register
from tabforge.plans.tables import LABELLED_LINEITEM_SQL, LABELLED_ORDERS_SQL, labelled_lineitem, labelled_orders, load

FEATS = ["price", "balance", "c_nationkey", "prio"]


def order_data(spark, sf, k=9):
    o = labelled_orders(spark, sf).select(
        "o_orderkey", "label", (F.col("o_totalprice") / 100000).alias("price"),
        (F.col("c_acctbal") / 1000).alias("balance"), "c_nationkey",
        F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"))
    return V.stratified_folds(o, "label", "o_orderkey", k)


def held_out(spark, sf):
    """(training rows, held-out rows): the last of the folds is held out."""
    d = order_data(spark, sf)
    return d.where(F.col("fold") < 8), d.where(F.col("fold") == 8)


@register("cross_validate_models_orders")
def cross_validate_models_orders(spark, sf):
    d = order_data(spark, sf, 3)
    ests = {"logreg": L.logreg(maxIter=20), "tree": L.tree(maxDepth=4, seed=0),
            "forest": L.forest(numTrees=10, maxDepth=4, seed=0),
            "forest_no_bootstrap": L.forest_no_bootstrap(numTrees=10, maxDepth=4, seed=0),
            "boosted_trees": L.boosted_trees(maxIter=5, maxDepth=3, seed=0), "linear_svm": L.linear_svm(maxIter=20)}
    return L.cross_validate(d, ests, FEATS, "label", "fold")


@register("grid_search_forest_orders")
def grid_search_forest_orders(spark, sf):
    table, _ = L.grid_search(order_data(spark, sf, 3), L.forest(seed=0), {"numTrees": [5, 10], "maxDepth": [3, 5]},
                             FEATS, "label", "fold")
    return table


@register("random_search_logreg_orders")
def random_search_logreg_orders(spark, sf):
    table, _ = L.random_search(order_data(spark, sf, 3), L.logreg(maxIter=20),
                               {"regParam": (1e-4, 1.0, "log"), "elasticNetParam": [0.0, 1.0]},
                               FEATS, "label", "fold", n_iter=4, seed=3)
    return table


@register("pipeline_search_orders")
def pipeline_search_orders(spark, sf):
    n = order_data(spark, sf, 3).count()
    cands = {"tree": lambda c: L.tree(maxDepth=3, seed=0), "logreg": lambda c: L.logreg(maxIter=10),
             "rbf_svm": lambda c: L.rbf_svm(c, n, gamma=0.5, C=1.0, n_components=20, seed=0)}
    return L.pipeline_search(order_data(spark, sf, 3), cands, FEATS, "label", "fold", n=4, seed=1, patience=2)


@register("adaboost_orders")
def adaboost_orders(spark, sf):
    train, test = held_out(spark, sf)
    ens = L.adaboost(train, FEATS, "label", "o_orderkey", depth=3, rounds=8)
    p = L.adaboost_predict(ens, test, FEATS, "o_orderkey")
    return V.accuracy(p.join(test.select("o_orderkey", "label"), "o_orderkey"), "label", "prediction")


@register("rbf_svm_mlp_orders")
def rbf_svm_mlp_orders(spark, sf):
    train, test = (L.with_label(d, "label") for d in held_out(spark, sf))
    out = []
    for name, est in [("rbf_svm", L.rbf_svm(FEATS, train.count(), gamma=0.5, C=1.0, n_components=20)),
                      ("mlp", L.assembled(L.mlp([len(FEATS), 5, 2], maxIter=30, seed=0), FEATS))]:
        m = est.fit(train)
        acc = V.accuracy(m.transform(test), "label", "prediction").select(F.lit(name).alias("model"), "accuracy")
        out.append(acc)
    return out[0].unionByName(out[1])


@register("lda_orders")
def lda_orders(spark, sf):
    train, test = held_out(spark, sf)
    m = L.lda_fit(train, FEATS, "label")
    p = L.lda_predict(m, test, "o_orderkey")
    return V.accuracy(p.join(test.select("o_orderkey", "label"), "o_orderkey"), "label", "prediction")


@register("importances_top_forest")
def importances_top_forest(spark, sf):
    d = L.with_label(order_data(spark, sf), "label")
    rows = []
    for name, est in [("forest", L.forest(numTrees=10, seed=0)), ("boosted_trees", L.boosted_trees(maxIter=5, seed=0))]:
        rows += L.importances(L.assembled(est, FEATS).fit(d), FEATS, name)
    imp = spark.createDataFrame(rows, "model string, feature string, importance double")
    return H.top_k(imp, "model", "importance", 2, tie=["feature"])


# --- KNN classifier: customers, label = BUILDING segment, exact split by hash order -------------
def customer_split(spark, sf):
    c = load(spark, sf, "customer")
    n = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    c = c.join(n, "c_custkey", "left").select(
        "c_custkey", "c_nationkey", (F.col("c_acctbal") / 1000).alias("bal"),
        F.coalesce("n_orders", F.lit(0)).cast("double").alias("n_orders"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label"))
    s = V.split(c, "c_custkey", 0.8, seed=9)
    return s.where(F.col("part") == "train").drop("part"), s.where(F.col("part") == "test").drop("part")


CUST_SQL = """(SELECT c.c_custkey, CAST(c.c_nationkey AS DOUBLE) AS c_nationkey, c.c_acctbal / 1000 AS bal,
  CAST(coalesce(o.n, 0) AS DOUBLE) AS n_orders, CAST(c.c_mktsegment = 'BUILDING' AS INTEGER) AS label,
  row_number() OVER (ORDER BY md5('9#' || CAST(c.c_custkey AS VARCHAR)), c.c_custkey) AS rn,
  count(*) OVER () AS n
  FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey)"""


def _knn_sql(k, weights, p):
    dist = ("abs(t.c_nationkey - d.c_nationkey) + abs(t.bal - d.bal) + abs(t.n_orders - d.n_orders)" if p == 1 else
            "sqrt((t.c_nationkey - d.c_nationkey) ^ 2 + (t.bal - d.bal) ^ 2 + (t.n_orders - d.n_orders) ^ 2)")
    w = "1.0" if weights == "uniform" else "CASE WHEN dist = 0 THEN 1e12 ELSE 1.0 / greatest(dist, 1e-12) END"
    return f"""
WITH b AS {CUST_SQL},
     tr AS (SELECT * FROM b WHERE rn <= n - ceil((CAST(1.0 AS DOUBLE) - CAST(0.8 AS DOUBLE)) * n)),
     te AS (SELECT * FROM b WHERE rn > n - ceil((CAST(1.0 AS DOUBLE) - CAST(0.8 AS DOUBLE)) * n)),
     pr AS (SELECT t.c_custkey, d.label, {dist} AS dist,
                   row_number() OVER (PARTITION BY t.c_custkey ORDER BY {dist}, d.c_custkey) AS r FROM te t, tr d),
     v AS (SELECT c_custkey, label, sum({w}) AS w FROM pr WHERE r <= {k} GROUP BY c_custkey, label)
SELECT c_custkey, arg_max(label, (w, -label)) AS prediction,
       round(sum(CASE WHEN label = 1 THEN w ELSE 0 END) / sum(w), 4) AS p1
FROM v GROUP BY c_custkey"""


@register("knn_classify_customers", _knn_sql(5, "uniform", 2))
def knn_classify_customers(spark, sf):
    tr, te = customer_split(spark, sf)
    out = L.knn_classify(tr, te, ["c_nationkey", "bal", "n_orders"], "label", "c_custkey", k=5)
    return out.select("c_custkey", "prediction", F.round("p1", 4).alias("p1"))


@register("knn_classify_customers_distance_l1", _knn_sql(9, "distance", 1))
def knn_classify_customers_distance_l1(spark, sf):
    tr, te = customer_split(spark, sf)
    out = L.knn_classify(tr, te, ["c_nationkey", "bal", "n_orders"], "label", "c_custkey", k=9,
                         weights="distance", p=1)
    return out.select("c_custkey", "prediction", F.round("p1", 4).alias("p1"))


# --- naive Bayes on lineitem (train = test = whole table) -------------------------------------------
NB_COLS = ["l_discount", "l_tax", "qty_hi"]


def nb_data(spark, sf):
    return labelled_lineitem(spark, sf).select("l_orderkey", "l_linenumber", "label", "l_discount", "l_tax",
                                               (F.col("l_quantity") - 25).alias("qty_hi"),
                                               (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"),
                                               "l_quantity", "l_linenumber",
                                               F.round(F.col("l_tax") * 100).alias("tax_pts"))


def _bnb_sql(alpha=1.0):
    xs = {"l_discount": "l_discount", "l_tax": "l_tax", "qty_hi": "l_quantity - 25"}
    st = ", ".join(f"sum(CAST({e} > 0 AS DOUBLE)) AS k_{c}" for c, e in xs.items())
    score = " + ".join(
        f"CAST({e} > 0 AS DOUBLE) * ln((k_{c} + {alpha}) / (n + {2 * alpha})) + "
        f"(1 - CAST({e} > 0 AS DOUBLE)) * ln(1 - (k_{c} + {alpha}) / (n + {2 * alpha}))" for c, e in xs.items())
    return f"""
WITH d AS {LABELLED_LINEITEM_SQL},
     st AS (SELECT label, count(*) AS n, {st} FROM d GROUP BY label),
     s0 AS (SELECT * FROM st WHERE label = 0), s1 AS (SELECT * FROM st WHERE label = 1),
     w AS (SELECT d.l_orderkey * 8 + d.l_linenumber AS k,
                  (SELECT ln(n / (SELECT count(*) FROM d)) FROM s0) + {score.replace("k_", "s0.k_").replace("t_", "s0.t_").replace("(n +", "(s0.n +")} AS s0,
                  (SELECT ln(n / (SELECT count(*) FROM d)) FROM s1) + {score.replace("k_", "s1.k_").replace("t_", "s1.t_").replace("(n +", "(s1.n +")} AS s1
           FROM d, s0, s1)
SELECT k, CASE WHEN s0 >= s1 THEN 0 ELSE 1 END AS prediction,
       round(exp(s1 - greatest(s0, s1)) / (exp(s0 - greatest(s0, s1)) + exp(s1 - greatest(s0, s1))), 4) AS p1 FROM w"""


@register("bernoulli_nb_lineitem", _bnb_sql())
def bernoulli_nb_lineitem(spark, sf):
    d = nb_data(spark, sf)
    out = L.bernoulli_nb(d, d, NB_COLS, "label", "k", alpha=1.0)
    return out.select("k", "prediction", F.round("p1", 4).alias("p1"))


MNB_COLS = ["l_quantity", "l_linenumber", "tax_pts"]


def _mnb_sql(alpha=0.01):
    xs = {"l_quantity": "l_quantity", "l_linenumber": "l_linenumber", "tax_pts": "round(l_tax * 100)"}
    st = ", ".join(f"sum(CAST({e} AS DOUBLE)) AS t_{c}" for c, e in xs.items())
    tot = " + ".join(f"t_{c}" for c in xs) + f" + {alpha * len(xs)}"
    score = " + ".join(f"CAST({e} AS DOUBLE) * ln((t_{c} + {alpha}) / ({tot}))" for c, e in xs.items())
    return f"""
WITH d AS {LABELLED_LINEITEM_SQL},
     st AS (SELECT label, count(*) AS n, {st} FROM d GROUP BY label),
     s0 AS (SELECT * FROM st WHERE label = 0), s1 AS (SELECT * FROM st WHERE label = 1),
     w AS (SELECT d.l_orderkey * 8 + d.l_linenumber AS k,
                  (SELECT ln(n / (SELECT count(*) FROM d)) FROM s0) + {score.replace("k_", "s0.k_").replace("t_", "s0.t_").replace("(n +", "(s0.n +")} AS s0,
                  (SELECT ln(n / (SELECT count(*) FROM d)) FROM s1) + {score.replace("k_", "s1.k_").replace("t_", "s1.t_").replace("(n +", "(s1.n +")} AS s1
           FROM d, s0, s1)
SELECT k, CASE WHEN s0 >= s1 THEN 0 ELSE 1 END AS prediction,
       round(exp(s1 - greatest(s0, s1)) / (exp(s0 - greatest(s0, s1)) + exp(s1 - greatest(s0, s1))), 4) AS p1 FROM w"""


@register("multinomial_nb_lineitem", _mnb_sql())
def multinomial_nb_lineitem(spark, sf):
    d = nb_data(spark, sf)
    out = L.multinomial_nb(d, d, MNB_COLS, "label", "k", alpha=0.01)
    return out.select("k", "prediction", F.round("p1", 4).alias("p1"))


# --- soft voting of two rule probabilities weighted by their accuracy ---------------------------------
PROB_SQL = {"price_rule": "1 / (1 + exp(-((o_totalprice - 150000) / 50000)))",
            "priority_rule": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0.7 ELSE 0.4 END"}


@register("soft_vote_orders", f"""
WITH d AS {LABELLED_ORDERS_SQL},
     p AS ({" UNION ALL ".join(f"SELECT o_orderkey AS key, '{m}' AS model, {e} AS p FROM d" for m, e in PROB_SQL.items())}),
     s AS (SELECT model, avg(CAST((p >= 0.5) = (label = 1) AS DOUBLE)) AS score FROM p JOIN d ON p.key = d.o_orderkey
           GROUP BY model),
     w AS (SELECT model, pow(1 + score - (SELECT min(score) FROM s), 10) AS w FROM s)
SELECT key, round(sum(w * p) / sum(w), 4) AS p, CAST(sum(w * p) / sum(w) > 0.5 AS INTEGER) AS prediction
FROM p JOIN w USING (model) GROUP BY key""")
def soft_vote_orders(spark, sf):
    d = labelled_orders(spark, sf)
    probs = d.select(F.col("o_orderkey").alias("key"), F.lit("price_rule").alias("model"),
                     (1 / (1 + F.exp(-((F.col("o_totalprice") - 150000) / 50000)))).alias("p")).unionByName(
        d.select(F.col("o_orderkey").alias("key"), F.lit("priority_rule").alias("model"),
                 F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 0.7).otherwise(0.4).alias("p")))
    scores = (probs.join(d.select(F.col("o_orderkey").alias("key"), "label"), "key")
                   .groupBy("model").agg(F.avg(((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("double")).alias("score")))
    v = L.soft_vote(probs, scores, power=10)
    return v.select("key", F.round("p", 4).alias("p"), "prediction")
