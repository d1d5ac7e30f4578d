"""Grouped label-rate and distribution queries (G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import summarize as S
from tabforge.plans.registry import register
from tabforge.plans.tables import (LABELLED_LINEITEM_SQL, LABELLED_ORDERS_SQL, MASKED_EVENTS_SQL,
                                   labelled_lineitem, labelled_orders, masked_events)


def r4(c):
    return F.round(c, 4)


@register("group_report_segment", f"""
SELECT c_mktsegment, round(avg(label) * 100.0, 4) AS rate_pct, count(label) AS n_label, count(*) AS n_rows,
       round(avg(o_totalprice), 4) AS avg_o_totalprice, round(avg(c_acctbal), 4) AS avg_c_acctbal
FROM {LABELLED_ORDERS_SQL} GROUP BY c_mktsegment""")
def group_report_segment(spark, sf):
    g = S.group_report(labelled_orders(spark, sf), "c_mktsegment", "label", means=["o_totalprice", "c_acctbal"])
    return g.select("c_mktsegment", r4("rate_pct").alias("rate_pct"), "n_label", "n_rows",
                    r4("avg_o_totalprice").alias("avg_o_totalprice"), r4("avg_c_acctbal").alias("avg_c_acctbal"))


@register("group_count_priority", f"""
SELECT o_orderpriority, count(label) AS n FROM {LABELLED_ORDERS_SQL}
GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority""")
def group_count_priority(spark, sf):
    return S.group_count(labelled_orders(spark, sf), "o_orderpriority", "label")


@register("group_rate_linestatus", f"""
SELECT l_linestatus, round(avg(label), 4) AS rate FROM {LABELLED_LINEITEM_SQL}
GROUP BY l_linestatus ORDER BY rate DESC, l_linestatus""")
def group_rate_linestatus(spark, sf):
    return S.group_rate(labelled_lineitem(spark, sf), "l_linestatus", "label").withColumn("rate", r4("rate"))


@register("cross_count_flag_status", """
SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def cross_count_flag_status(spark, sf):
    return S.cross_count(labelled_lineitem(spark, sf), "l_returnflag", "l_linestatus")


@register("cross_count_pivot_flag_status", """
SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F,
       count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag""")
def cross_count_pivot_flag_status(spark, sf):
    out = S.cross_count(labelled_lineitem(spark, sf), "l_returnflag", "l_linestatus", ["F", "O"])
    return out.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("F"), F.coalesce("O", F.lit(0)).alias("O"))


@register("rate_ci_priority", f"""
SELECT o_orderpriority, round(avg(label), 4) AS mean, count(label) AS n,
       round(avg(label) - 1.96 * stddev_samp(label) / sqrt(count(label)), 4) AS lo,
       round(avg(label) + 1.96 * stddev_samp(label) / sqrt(count(label)), 4) AS hi
FROM {LABELLED_ORDERS_SQL} GROUP BY o_orderpriority""")
def rate_ci_priority(spark, sf):
    g = S.rate_ci(labelled_orders(spark, sf), "o_orderpriority", "label")
    return g.select("o_orderpriority", r4("mean").alias("mean"), "n", r4("lo").alias("lo"), r4("hi").alias("hi"))


@register("rate_ci_bootstrap_priority", f"""
WITH h AS (SELECT o_orderpriority, label, i, md5('0#' || o_orderkey || '#' || i) AS d FROM {LABELLED_ORDERS_SQL}, range(13) t(i)),
     u AS (SELECT o_orderpriority, label, i * 8 + j AS rep, ('0x' || substr(d, j * 4 + 1, 4))::INTEGER AS u FROM h, range(8) t(j) WHERE i * 8 + j < 100),
     w AS (SELECT o_orderpriority, label, rep, {" + ".join(f"CAST(u >= {v} AS INTEGER)" for v in S.POISSON_STEPS)} AS w FROM u),
     m AS (SELECT o_orderpriority, rep, sum(w * label) / sum(w) AS m FROM w GROUP BY ALL)
SELECT o_orderpriority, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m GROUP BY ALL""")
def rate_ci_bootstrap_priority(spark, sf):
    g = S.rate_ci_bootstrap(labelled_orders(spark, sf), "o_orderpriority", "label", "o_orderkey", b=100)
    return g.select("o_orderpriority", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@register("facet_rate_segment_priority", f"""
SELECT c_mktsegment, o_orderpriority, round(avg(label), 4) AS rate, count(label) AS n
FROM {LABELLED_ORDERS_SQL} GROUP BY c_mktsegment, o_orderpriority""")
def facet_rate_segment_priority(spark, sf):
    return S.facet_rate(labelled_orders(spark, sf), "c_mktsegment", "o_orderpriority", "label").withColumn(
        "rate", r4("rate"))


PRIORITY_DOMAIN = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]


@register("domain_rate_priority", f"""
SELECT d.ord AS "order", d.o_orderpriority, round(r.rate, 4) AS rate
FROM (SELECT * FROM (VALUES {", ".join(f"({i}, '{v}')" for i, v in enumerate(PRIORITY_DOMAIN))})
      t(ord, o_orderpriority)) d
LEFT JOIN (SELECT o_orderpriority, avg(label) AS rate FROM {LABELLED_ORDERS_SQL} GROUP BY o_orderpriority) r
ON d.o_orderpriority = r.o_orderpriority""")
def domain_rate_priority(spark, sf):
    out = S.domain_rate(labelled_orders(spark, sf), "o_orderpriority", "label", PRIORITY_DOMAIN)
    return out.select(F.col("order").cast("int").alias("order"), "o_orderpriority", r4("rate").alias("rate"))


QTY_EDGES = [0, 10, 20, 30, 40, 50]


@register("binned_rate_quantity", f"""
SELECT CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN '0-10' WHEN l_quantity > 10 AND l_quantity <= 20 THEN '10-20'
            WHEN l_quantity > 20 AND l_quantity <= 30 THEN '20-30' WHEN l_quantity > 30 AND l_quantity <= 40 THEN '30-40'
            WHEN l_quantity > 40 AND l_quantity <= 50 THEN '40-50' END AS bin,
       round(avg(label), 4) AS rate, count(*) AS n
FROM {LABELLED_LINEITEM_SQL} GROUP BY 1""")
def binned_rate_quantity(spark, sf):
    return S.binned_rate(labelled_lineitem(spark, sf), "l_quantity", QTY_EDGES, "label").withColumn("rate", r4("rate"))


@register("histogram_price_by_label", f"""
WITH b AS (SELECT label, l_extendedprice AS x FROM {LABELLED_LINEITEM_SQL}),
     m AS (SELECT min(x) AS lo, max(x) AS hi FROM b)
SELECT label, CAST(least(floor((x - lo) / ((hi - lo) / 17)), 16) AS INTEGER) AS bin,
       round(lo + least(floor((x - lo) / ((hi - lo) / 17)), 16) * ((hi - lo) / 17), 4) AS "left",
       round(lo + (least(floor((x - lo) / ((hi - lo) / 17)), 16) + 1) * ((hi - lo) / 17), 4) AS "right",
       count(*) AS n
FROM b, m GROUP BY ALL""")
def histogram_price_by_label(spark, sf):
    h = S.histogram(labelled_lineitem(spark, sf), "l_extendedprice", 17, by="label")
    return h.select("label", "bin", r4("left").alias("left"), r4("right").alias("right"), "n")


@register("kde_discount_by_label", f"""
WITH b AS (SELECT label, l_discount AS x FROM {LABELLED_LINEITEM_SQL}),
     st AS (SELECT label, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h FROM b GROUP BY label),
     g AS (SELECT i, lo + i * (hi - lo) / 19 AS gx FROM range(20) t(i), (SELECT min(x) AS lo, max(x) AS hi FROM b))
SELECT b.label, CAST(g.i AS INTEGER) AS grid_index, round(g.gx, 4) AS x,
       round(sum(exp(-0.5 * pow((g.gx - b.x) / st.h, 2))) / (any_value(st.n) * any_value(st.h) * sqrt(2 * pi())), 4)
         AS density
FROM b JOIN st ON b.label = st.label, g GROUP BY b.label, g.i, g.gx""")
def kde_discount_by_label(spark, sf):
    k = S.kde(labelled_lineitem(spark, sf), "l_discount", points=20, by="label")
    return k.select("label", "grid_index", r4("x").alias("x"), r4("density").alias("density"))


@register("linear_fit_price_quantity", """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 4) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n
FROM lineitem GROUP BY l_returnflag""")
def linear_fit_price_quantity(spark, sf):
    f = S.linear_fit(labelled_lineitem(spark, sf), "l_quantity", "l_extendedprice", by="l_returnflag")
    return f.select("l_returnflag", r4("slope").alias("slope"), r4("intercept").alias("intercept"),
                    r4("r2").alias("r2"), "n")


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _corr_sql():
    parts = []
    for i in range(len(CORR_COLS)):
        for j in range(i + 1, len(CORR_COLS)):
            a, b = CORR_COLS[i], CORR_COLS[j]
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r, "
                         f"round(abs(corr({a}, {b})), 4) AS abs_r FROM lineitem")
    return "\nUNION ALL\n".join(parts)


@register("corr_matrix_lineitem", _corr_sql())
def corr_matrix_lineitem(spark, sf):
    c = S.corr_matrix(labelled_lineitem(spark, sf), CORR_COLS)
    return c.select("a", "b", r4("r").alias("r"), r4("abs_r").alias("abs_r"))


@register("log_stats_events", f"""
WITH e AS (SELECT event_type, CASE WHEN value IS NULL THEN 'NaN'::DOUBLE ELSE value END AS value,
                  CAST(user_id AS DOUBLE) AS user FROM {MASKED_EVENTS_SQL})
SELECT event_type,
  round(avg(CASE WHEN isnan(value) THEN NULL ELSE value END), 2) AS value_avg,
  round(stddev_pop(CASE WHEN isnan(value) THEN NULL ELSE value END), 2) AS value_std,
  round(min(CASE WHEN isnan(value) THEN 'inf'::DOUBLE ELSE value END), 2) AS value_min,
  round(max(CASE WHEN isnan(value) THEN 'inf'::DOUBLE ELSE value END), 2) AS value_max,
  round(avg(user), 2) AS user_avg, round(stddev_pop(user), 2) AS user_std,
  round(min(user), 2) AS user_min, round(max(user), 2) AS user_max
FROM e GROUP BY event_type""")
def log_stats_events(spark, sf):
    e = masked_events(spark, sf).select(
        "event_type", F.coalesce(F.col("value"), F.lit(float("nan"))).alias("value"),
        F.col("user_id").cast("double").alias("user"))
    return S.log_stats(e, "event_type", ["value", "user"])


FAMILY_SQL = ("(SELECT l_linenumber - 1 + CAST(round(l_discount * 100) AS INTEGER) % 3 + 1 AS family_size, "
              f"label FROM {LABELLED_LINEITEM_SQL})")


@register("group_report_family_size", f"""
SELECT family_size, round(avg(label) * 100.0, 4) AS rate_pct, count(label) AS n_label, count(*) AS n_rows
FROM {FAMILY_SQL} GROUP BY family_size""")
def group_report_family_size(spark, sf):
    from tabforge.functions.columns import sum_plus
    li = labelled_lineitem(spark, sf).select(
        "label", sum_plus([F.col("l_linenumber") - 1, F.round(F.col("l_discount") * 100).cast("int") % 3], 1)
        .alias("family_size"))
    g = S.group_report(li, "family_size", "label")
    return g.select("family_size", r4("rate_pct").alias("rate_pct"), "n_label", "n_rows")
