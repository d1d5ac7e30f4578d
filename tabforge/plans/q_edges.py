"""Operators on input that has no spread, one class, no values or no rows: each gives a stated result (mostly NULL), never an error.

The inputs are derived from the driver's tables: a constant, a column that is NULL where a key says so, groups of one row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.functions import columns as C
from tabforge.operators import encode as E
from tabforge.operators import preprocess as K
from tabforge.operators import profile as P
from tabforge.operators import summarize as S
from tabforge.operators import validate as V
from tabforge.plans.registry import register
from tabforge.plans.tables import LABELLED_LINEITEM_SQL, LABELLED_ORDERS_SQL, labelled_lineitem, labelled_orders, load


def r4(c):
    return F.round(c, 4)


# A feature with NULLs, a constant one, one that parts the classes, one that one class alone knows, one that nobody knows.
EDGE = {
    "holes": "CASE WHEN l_linenumber > 2 THEN l_quantity END", "constant": "CAST(7.1 AS DOUBLE)", "parting": "CAST(label * 2 AS DOUBLE)",
    "one_class": "CASE WHEN label = 1 THEN l_quantity END", "nothing": "CAST(NULL AS DOUBLE)",
}


def _edge_sql(name, expr):
    return f"""SELECT '{name}' AS feature, CASE WHEN k < 2 OR n - k < 1 OR (ssw = 0 AND ssb = 0) THEN NULL WHEN ssw = 0 THEN 'inf'::DOUBLE
  ELSE round((ssb / (k - 1)) / (ssw / (n - k)), 4) END AS f, greatest(k - 1, 0) AS df_between, greatest(n - k, 0) AS df_within
FROM (SELECT coalesce(sum(c), 0)::BIGINT AS n, (count(*) FILTER (c > 0))::BIGINT AS k, coalesce(sum(v), 0) AS ssw,
    CASE WHEN max(m) - min(m) < 1e-9 THEN 0 ELSE coalesce(sum(c * (m - g) ^ 2), 0) END AS ssb
  FROM (SELECT label, count(x) AS c, avg(x) AS m, var_pop(x) * count(x) AS v, any_value(g) AS g FROM (
    SELECT label, {expr} AS x, avg({expr}) OVER () AS g FROM {LABELLED_LINEITEM_SQL}) GROUP BY label))"""


@register("anova_f_edges_lineitem", " UNION ALL ".join(_edge_sql(n, e) for n, e in EDGE.items()))
def anova_f_edges_lineitem(spark, sf):
    d = labelled_lineitem(spark, sf).select("label", *[F.expr(e).alias(n) for n, e in EDGE.items()])
    return K.anova_f(d, list(EDGE), "label").withColumn("f", r4("f"))


# K10, the selection: a rule with an exact p-value, as two classes have F = t^2.
@register("select_fwe_edges_lineitem", f"""
WITH f AS ({" UNION ALL ".join(_edge_sql(n, e) for n, e in EDGE.items())})
SELECT feature, f, CASE WHEN f IS NULL THEN false WHEN isinf(f) THEN true ELSE f > 100 END AS keep FROM f""")
def select_fwe_edges_lineitem(spark, sf):
    """With thousands of rows p < 0.01 needs F of about 7: the features here lie far above 100 or below 5."""
    d = labelled_lineitem(spark, sf).select("label", *[F.expr(e).alias(n) for n, e in EDGE.items()])
    return K.select_fwe(d, list(EDGE), "label", alpha=0.05).select("feature", r4("f").alias("f"), "keep")


# C15 / C16
@register("standardize_edges_orders", """
WITH s AS (SELECT o_orderkey, o_orderstatus AS g, CASE WHEN o_orderstatus = 'F' THEN 5 ELSE o_totalprice / 1000 END AS x, CAST(3.3 AS DOUBLE) AS c FROM orders)
SELECT o_orderkey, CASE WHEN g <> 'F' THEN round((x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0), 4) END AS x, CAST(NULL AS DOUBLE) AS c
FROM s WINDOW w AS (PARTITION BY g)""")
def standardize_edges_orders(spark, sf):
    """A group without spread, and (over all rows) a constant column: both NULL."""
    d = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("g"), F.lit(3.3).alias("c"),
                                         F.when(F.col("o_orderstatus") == "F", 5.0).otherwise(F.col("o_totalprice") / 1000).alias("x"))
    d = C.standardize(C.standardize(d, ["x"], by="g"), ["c"])
    return d.select("o_orderkey", r4("x").alias("x"), r4("c").alias("c"))


@register("frobenius_edges_orders", "SELECT o_orderkey, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b FROM orders")
def frobenius_edges_orders(spark, sf):
    d = load(spark, sf, "orders").select("o_orderkey", F.lit(0.0).alias("a"), F.lit(None).cast("double").alias("b"))
    return C.frobenius_scale(d, ["a", "b"])


# K4
@register("robust_scale_edges_lineitem", """
WITH q AS (SELECT quantile_cont(h, 0.5) AS m, quantile_cont(h, 0.75) - quantile_cont(h, 0.25) AS r
           FROM (SELECT CASE WHEN l_linenumber > 2 THEN l_quantity END AS h FROM lineitem))
SELECT l_orderkey, l_linenumber, round((CASE WHEN l_linenumber > 2 THEN l_quantity END - m) / r, 4) AS holes, CAST(0 AS DOUBLE) AS constant,
  CAST(NULL AS DOUBLE) AS nothing FROM lineitem, q""")
def robust_scale_edges_lineitem(spark, sf):
    d = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(EDGE[n]).alias(n) for n in ("holes", "constant", "nothing")])
    return K.robust_scale(d, ["holes", "constant", "nothing"]).withColumn("holes", r4("holes"))


# Groups of one order each have no bandwidth, the others do.
@register("kde_edges_orders", f"""
WITH b AS (SELECT CASE WHEN o_orderkey <= 5 THEN o_orderkey ELSE 0 END AS g, o_totalprice / 100000 AS x FROM orders),
     st AS (SELECT g, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h FROM b GROUP BY g),
     p AS (SELECT i, lo + i * (hi - lo) / 9 AS gx FROM range(10) t(i), (SELECT min(x) AS lo, max(x) AS hi FROM b))
SELECT b.g, CAST(p.i AS INTEGER) AS grid_index, CASE WHEN b.g = 0 THEN round(sum(exp(-0.5 * pow((p.gx - b.x) / st.h, 2)))
  / (any_value(st.n) * any_value(st.h) * sqrt(2 * pi())), 4) END AS density
FROM b JOIN st ON b.g = st.g, p GROUP BY b.g, p.i, p.gx""")
def kde_edges_orders(spark, sf):
    d = load(spark, sf, "orders").select(F.when(F.col("o_orderkey") <= 5, F.col("o_orderkey")).otherwise(0).alias("g"), (F.col("o_totalprice") / 100000).alias("x"))
    return S.kde(d, "x", points=10, by="g").select("g", "grid_index", r4("density").alias("density"))


# M11
@register("auc_edges_orders", f"""
SELECT 'one class' AS input, CAST(NULL AS DOUBLE) AS auc UNION ALL SELECT 'no rows' AS input, NULL AS auc UNION ALL
SELECT 'holes' AS input, round((sum(ar) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2)
  / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 4) AS auc
FROM (SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS ar FROM (
  SELECT label, CASE WHEN o_custkey % 3 > 0 THEN round(o_totalprice / 1000) END AS s FROM {LABELLED_ORDERS_SQL}) WHERE s IS NOT NULL)""")
def auc_edges_orders(spark, sf):
    o = labelled_orders(spark, sf).withColumn("s", F.when(F.col("o_custkey") % 3 > 0, F.round(F.col("o_totalprice") / 1000)))
    parts = [("one class", o.withColumn("label", F.lit(1))), ("no rows", o.where("s < 0")), ("holes", o)]
    out = [V.auc(d, "label", "s").select(F.lit(n).alias("input"), r4("auc").alias("auc")) for n, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


# B4
@register("null_profile_edges_customer", """
SELECT 'some' AS input, 'c_acctbal' AS column, count(*) FILTER (c_custkey % 5 = 0) * 100.0 / count(*) AS null_pct FROM customer""")
def null_profile_edges_customer(spark, sf):
    """A table without rows has no NULL share to report; one with some NULLs has."""
    c = load(spark, sf, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")))
    parts = [P.null_profile(d).select(F.lit(n).alias("input"), "column", "null_pct") for n, d in (("none", c.where("c_custkey < 0")), ("some", c))]
    return parts[0].unionByName(parts[1])


# E7 / E8 with any number of values
@register("one_hot_sparse_lineitem", """
SELECT l_orderkey, l_linenumber, CAST(n AS INTEGER) AS size, CAST(CASE WHEN l_linenumber < 7 THEN
  dense_rank() OVER (ORDER BY CASE WHEN l_linenumber < 7 THEN l_orderkey * 10 + l_linenumber END NULLS LAST) - 1 END AS INTEGER) AS slot
FROM lineitem, (SELECT count(*) FILTER (l_linenumber < 7) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))""")
def one_hot_sparse_lineitem(spark, sf):
    """Nearly as many values as rows; every seventh line has none."""
    d = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") < 7, F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("v"))
    hot, _ = E.one_hot_sparse(d, "v", "hot")
    return hot.select("l_orderkey", "l_linenumber", F.col("hot.size").alias("size"), F.get("hot.indices", F.lit(0)).alias("slot"))


POOLED = "CASE WHEN l_quantity <= 10 THEN 'other' WHEN l_quantity <= 20 THEN 'second' ELSE CAST(CAST(l_quantity AS INTEGER) AS {text}) END"


@register("one_hot_pooled_lineitem", f"""
WITH c AS (SELECT v, count(*) AS n, sum(count(*)) OVER () AS t FROM (SELECT {POOLED.format(text="VARCHAR")} AS v FROM lineitem) GROUP BY v),
     k AS (SELECT CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code, v AS value, false AS pooled, n FROM c WHERE n >= 0.1 * t)
SELECT * FROM k UNION ALL
SELECT CAST((SELECT count(*) FROM k) AS INTEGER) AS code, 'other' AS value, true AS pooled, CAST(sum(n) AS BIGINT) AS n FROM c WHERE n < 0.1 * t""")
def one_hot_pooled_lineitem(spark, sf):
    """A frequent value called 'other' keeps its own slot beside the pool of rare ones."""
    d = load(spark, sf, "lineitem").select(F.expr(POOLED.format(text="STRING")).alias("v"))
    return E.one_hot_sparse(d, "v", min_fraction=0.1)[1]


# C8, the join form
@register("map_values_join_lineitem", """
SELECT l_orderkey, l_linenumber, o_orderpriority AS priority FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def map_values_join_lineitem(spark, sf):
    d = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    m = load(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))
    return C.map_values_join(d, "l_orderkey", m, "priority", strict=True)


# G9 with a width rule
@register("histogram_auto_price", f"""
WITH b AS (SELECT label, l_extendedprice AS x FROM {LABELLED_LINEITEM_SQL}),
     m AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM b),
     w AS (SELECT lo, hi, ceil((hi - lo) / least(2 * iqr / n ^ (1.0 / 3.0), (hi - lo) / (log2(n) + 1))) AS k FROM m)
SELECT label, CAST(least(floor((x - lo) / ((hi - lo) / k)), k - 1) AS INTEGER) AS bin, count(*) AS n FROM b, w GROUP BY ALL""")
def histogram_auto_price(spark, sf):
    return S.histogram(labelled_lineitem(spark, sf), "l_extendedprice", "auto", by="label").select("label", "bin", "n")


# K17 over many columns: eight groups of eight columns that differ by a small offset.
BASES = ["l_quantity", "l_extendedprice / 1000", "l_discount * 400", "l_tax * 700", "l_linenumber * 9.0", "l_orderkey % 97 * 1.0", "l_partkey % 89 * 1.0", "l_suppkey % 83 * 1.0"]


@register("agglomerate_wide_lineitem", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round({b} + 0.0035, 6) AS agg{g}" for g, b in enumerate(BASES)) + " FROM lineitem")
def agglomerate_wide_lineitem(spark, sf):
    cols = {f"c{g}_{m}": (F.expr(b).cast("double") + m * 0.001) for g, b in enumerate(BASES) for m in range(8)}
    d = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in cols.items()])
    out = K.agglomerate(d, list(cols), len(BASES))
    return out.select("l_orderkey", "l_linenumber", *[F.round(f"agg{g}", 6).alias(f"agg{g}") for g in range(len(BASES))])
