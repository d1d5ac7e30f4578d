"""Profiling queries (B*) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import profile as P
from tabforge.plans.registry import register
from tabforge.plans.tables import (MASKED_CUSTOMER_SQL, MASKED_EVENTS_SQL, load, masked_customer,
                                   masked_events)

CUSTOMER_COLS = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")]
EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
LINEITEM_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def r4(c):
    return F.round(c, 4)


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


@register("shape_lineitem", "SELECT count(*) AS n_rows, 11 AS n_cols FROM lineitem")
def shape_lineitem(spark, sf):
    return P.shape(load(spark, sf, "lineitem"))


@register("info_customer_masked", _union([
    f"SELECT '{c}' AS column, {i} AS position, '{t}' AS dtype, count({c}) AS non_null FROM {MASKED_CUSTOMER_SQL}"
    for i, (c, t) in enumerate(CUSTOMER_COLS)]))
def info_customer_masked(spark, sf):
    return P.info(masked_customer(spark, sf))


@register("null_counts_events_masked", _union([
    f"SELECT '{c}' AS column, {i} AS position, count(*) FILTER (WHERE {c} IS NULL) AS null_count "
    f"FROM {MASKED_EVENTS_SQL}" for i, c in enumerate(EVENT_COLS)]))
def null_counts_events_masked(spark, sf):
    return P.null_counts(masked_events(spark, sf))


@register("null_profile_customer_masked", "SELECT * FROM (" + _union([
    f"SELECT '{c}' AS column, round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 4) AS null_pct "
    f"FROM {MASKED_CUSTOMER_SQL}" for c, _ in CUSTOMER_COLS]) + ") WHERE null_pct > 0")
def null_profile_customer_masked(spark, sf):
    return P.null_profile(masked_customer(spark, sf)).withColumn("null_pct", r4("null_pct"))


def _np_sql(src, cols, alias):
    return "(SELECT * FROM (" + _union([
        f"SELECT '{c}' AS column, round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 4) AS {alias} "
        f"FROM {src}" for c in cols]) + f") WHERE {alias} > 0)"


@register("null_profile_compare_customer_events",
          f"SELECT coalesce(a.column, b.column) AS column, a.null_pct_1, b.null_pct_2 FROM "
          f"{_np_sql(MASKED_CUSTOMER_SQL, [c for c, _ in CUSTOMER_COLS], 'null_pct_1')} a FULL OUTER JOIN "
          f"{_np_sql(MASKED_EVENTS_SQL, EVENT_COLS, 'null_pct_2')} b ON a.column = b.column")
def null_profile_compare_customer_events(spark, sf):
    out = P.null_profile_compare(masked_customer(spark, sf), masked_events(spark, sf))
    return out.select("column", r4("null_pct_1").alias("null_pct_1"), r4("null_pct_2").alias("null_pct_2"))


ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("nunique_orders", _union([
    f"SELECT '{c}' AS column, {i} AS position, count(DISTINCT {c}) AS n_distinct FROM orders"
    for i, c in enumerate(ORDER_COLS)]))
def nunique_orders(spark, sf):
    return P.nunique(load(spark, sf, "orders"))


PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@register("rows_per_class_part", _union([
    f"SELECT '{c}' AS column, {i} AS position, round(count(*) * 1.0 / count(DISTINCT {c}), 4) AS rows_per_value "
    f"FROM part" for i, c in enumerate(PART_COLS)]))
def rows_per_class_part(spark, sf):
    return P.rows_per_class(load(spark, sf, "part")).withColumn("rows_per_value", r4("rows_per_value"))


@register("describe_lineitem", _union([
    f"SELECT '{c}' AS column, {i} AS position, count({c}) AS count, round(avg({c}), 4) AS mean, "
    f"round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, "
    f"round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, "
    f"round(quantile_cont({c}, 0.75), 4) AS q75 FROM lineitem" for i, c in enumerate(LINEITEM_NUM)]))
def describe_lineitem(spark, sf):
    d = P.describe(load(spark, sf, "lineitem"), LINEITEM_NUM)
    return d.select("column", "position", "count", *[r4(c).alias(c) for c in
                                                      ["mean", "std", "min", "max", "q25", "q50", "q75"]])


@register("unique_orderstatus", "SELECT DISTINCT o_orderstatus FROM orders")
def unique_orderstatus(spark, sf):
    return P.unique(load(spark, sf, "orders"), "o_orderstatus")


@register("value_counts_mktsegment",
          "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL "
          "GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment")
def value_counts_mktsegment(spark, sf):
    return P.value_counts(load(spark, sf, "customer"), "c_mktsegment")


@register("range_stats_customer_masked", _union([
    f"SELECT '{c}' AS column, {i} AS position, round(min({c}), 4) AS min, round(avg({c}), 4) AS mean, "
    f"round(max({c}), 4) AS max FROM {MASKED_CUSTOMER_SQL}" for i, c in enumerate(["c_acctbal", "c_nationkey"])]))
def range_stats_customer_masked(spark, sf):
    d = P.range_stats(masked_customer(spark, sf), ["c_acctbal", "c_nationkey"])
    return d.select("column", "position", r4("min").alias("min"), r4("mean").alias("mean"), r4("max").alias("max"))


@register("head_orders_by_price",
          "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def head_orders_by_price(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@register("tail_orders_by_key", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def tail_orders_by_key(spark, sf):
    return P.tail(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 10, ["o_orderkey"])


@register("value_overlap_custkey", """
SELECT coalesce(a.custkey, b.custkey) AS custkey,
       CASE WHEN a.custkey IS NOT NULL AND b.custkey IS NOT NULL THEN 'both'
            WHEN a.custkey IS NOT NULL THEN 'only_left' ELSE 'only_right' END AS side
FROM (SELECT DISTINCT o_custkey AS custkey FROM orders) a
FULL OUTER JOIN (SELECT DISTINCT c_custkey AS custkey FROM customer) b ON a.custkey = b.custkey""")
def value_overlap_custkey(spark, sf):
    a = load(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"))
    b = load(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))
    return P.value_overlap(a, b, "custkey")


@register("same_nulls_customer_cast", _union([
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS before, "
    f"count(*) FILTER (WHERE {c} IS NULL) AS after, true AS same FROM {MASKED_CUSTOMER_SQL}"
    for c, _ in CUSTOMER_COLS]))
def same_nulls_customer_cast(spark, sf):
    a = masked_customer(spark, sf)
    b = a.withColumn("c_acctbal", F.col("c_acctbal").cast("float")).withColumn("c_nationkey",
                                                                              F.col("c_nationkey").cast("short"))
    return P.assert_same_nulls(a, b)


DOWNCAST_COLS = ["l_linenumber", "l_quantity", "l_partkey", "l_tax"]


@register("downcast_report_lineitem", _union([
    f"SELECT '{c}' AS column, {i} AS position, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    f"(min({c}) >= 0 AND max({c}) <= 255) AS fits FROM lineitem" for i, c in enumerate(DOWNCAST_COLS)]))
def downcast_report_lineitem(spark, sf):
    return P.downcast_report(load(spark, sf, "lineitem"), DOWNCAST_COLS)


@register("matrix_check_lineitem", _union([
    f"SELECT '{c}' AS column, {i} AS position, count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS n_missing, "
    f"round(max({c}), 4) AS max, round(min({c}), 4) AS min, count(DISTINCT {c}) AS n_distinct FROM lineitem"
    for i, c in enumerate(LINEITEM_NUM)]))
def matrix_check_lineitem(spark, sf):
    d = P.matrix_check(load(spark, sf, "lineitem"), LINEITEM_NUM)
    return d.select("column", "position", "n_missing", r4("max").alias("max"), r4("min").alias("min"), "n_distinct")


@register("downcast_lineitem", """
SELECT CAST(l_linenumber AS SMALLINT) AS l_linenumber, CAST(l_quantity AS SMALLINT) AS l_quantity, l_partkey
FROM lineitem""")
def downcast_lineitem(spark, sf):
    li = load(spark, sf, "lineitem").select("l_linenumber", "l_quantity", "l_partkey")
    return P.downcast(li, ["l_linenumber", "l_quantity", "l_partkey"])
