"""Binning and encoding queries (E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import encode as E
from tabforge.plans.registry import register
from tabforge.plans.tables import load


@register("floor_width_bins_lineitem", """
SELECT l_orderkey, l_linenumber,
  CAST(floor(CAST(trunc(l_quantity) AS INTEGER) / 5) AS INTEGER) AS qty_bin5,
  CAST(floor(CAST(trunc(l_quantity) AS INTEGER) / 15) AS INTEGER) + 1 AS qty_bin15,
  CAST(trunc(ln(1 + l_extendedprice) / 0.25) AS INTEGER) + 1 AS logprice_bin,
  CAST(trunc(l_extendedprice / 5000.0) AS INTEGER) AS price_bin
FROM lineitem""")
def floor_width_bins_lineitem(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", E.floor_bin("l_quantity", 5).alias("qty_bin5"),
                     E.floor_bin("l_quantity", 15, 1).alias("qty_bin15"),
                     E.width_bin(F.log1p("l_extendedprice"), 0.25, 1).alias("logprice_bin"),
                     E.width_bin("l_extendedprice", 5000.0).alias("price_bin"))


SIZE_EDGES = [0, 10, 25, 40, 50]


@register("cut_part_size", """
SELECT p_partkey, p_size, CASE WHEN p_size > 0 AND p_size <= 10 THEN '0-10' WHEN p_size > 10 AND p_size <= 25 THEN '10-25'
  WHEN p_size > 25 AND p_size <= 40 THEN '25-40' WHEN p_size > 40 AND p_size <= 50 THEN '40-50' END AS size_bin
FROM part""")
def cut_part_size(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_size")
    return E.cut(p, "p_size", SIZE_EDGES, name="size_bin")


@register("range_edges_cut_retailprice", """
WITH m AS (SELECT CAST(trunc(min(p_retailprice)) AS BIGINT) AS lo, CAST(trunc(max(p_retailprice)) AS BIGINT) AS hi
           FROM part),
     e AS (SELECT lo + 250 * i AS a, lo + 250 * (i + 1) AS b FROM m, range(0, (hi - lo) // 250 + 1) t(i)
           WHERE lo + 250 * (i + 1) < hi + 250)
SELECT concat(CAST(a AS VARCHAR), '-', CAST(b AS VARCHAR)) AS price_bin, count(p.p_partkey) AS n
FROM part p JOIN e ON p.p_retailprice > e.a AND p.p_retailprice <= e.b GROUP BY 1""")
def range_edges_cut_retailprice(spark, sf):
    p = load(spark, sf, "part")
    edges = E.range_edges(p, "p_retailprice", 250)
    b = E.cut(p, "p_retailprice", edges, name="price_bin")
    return b.where(F.col("price_bin").isNotNull()).groupBy("price_bin").agg(F.count("p_partkey").alias("n"))


@register("qcut_extendedprice", """
WITH q AS (SELECT quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1.0]) AS e FROM lineitem)
SELECT CASE WHEN l_extendedprice >= e[1] AND l_extendedprice <= e[2] THEN 1
            WHEN l_extendedprice > e[2] AND l_extendedprice <= e[3] THEN 2
            WHEN l_extendedprice > e[3] AND l_extendedprice <= e[4] THEN 3
            WHEN l_extendedprice > e[4] AND l_extendedprice <= e[5] THEN 4 END AS quartile,
       count(*) AS n, round(avg(l_quantity), 4) AS avg_qty
FROM lineitem, q GROUP BY 1""")
def qcut_extendedprice(spark, sf):
    li = load(spark, sf, "lineitem")
    b = E.qcut(li, "l_extendedprice", 4, name="quartile")
    return b.groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"))


def masked_part(spark, sf):
    p = load(spark, sf, "part")
    return p.withColumn("p_type", F.when(F.col("p_partkey") % 10 == 0, F.lit(None)).otherwise(F.col("p_type")))


MASKED_PART_SQL = ("(SELECT p_partkey, p_name, p_brand, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_type END AS p_type,"
                   " p_size, p_retailprice FROM part)")


@register("cat_codes_part_type", f"""
SELECT p_partkey, p_type, CASE WHEN p_type IS NULL THEN -1
       ELSE CAST(dense_rank() OVER (PARTITION BY p_type IS NULL ORDER BY p_type) - 1 AS INTEGER) END + 1 AS p_type_code
FROM {MASKED_PART_SQL}""")
def cat_codes_part_type(spark, sf):
    return E.cat_codes(masked_part(spark, sf), "p_type", offset=1).select("p_partkey", "p_type", "p_type_code")


@register("cat_codes_part_name_table", """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INTEGER) + 2 AS p_name_code FROM part""")
def cat_codes_part_name_table(spark, sf):
    # Large-domain path: forced with a small inline bound; codes come from the distributed code table.
    p = load(spark, sf, "part").select("p_partkey", "p_name")
    out = E.cat_codes(p, "p_name", offset=2, max_inline=50)
    return out.select("p_partkey", F.col("p_name_code").cast("int").alias("p_name_code"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("dummies_mktsegment", "SELECT c_custkey, " + ", ".join(
    f"CAST(c_mktsegment = '{s}' AS INTEGER) AS seg_{s}" for s in SEGMENTS) + " FROM customer")
def dummies_mktsegment(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return E.get_dummies(c, "c_mktsegment", prefix="seg")


@register("dummies_pooled_quantity", """
WITH b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 2 THEN 'tiny' WHEN l_quantity <= 25 THEN 'mid'
                  ELSE 'big' END AS size FROM lineitem),
     f AS (SELECT size, count(*) / (SELECT count(*) FROM b) AS frac FROM b GROUP BY size),
     p AS (SELECT b.l_orderkey, b.l_linenumber, CASE WHEN f.frac >= 0.1 THEN b.size ELSE 'other' END AS v
           FROM b JOIN f ON b.size = f.size)
SELECT l_orderkey, l_linenumber, CAST(v = 'big' AS INTEGER) AS size_big, CAST(v = 'mid' AS INTEGER) AS size_mid,
       CAST(v = 'other' AS INTEGER) AS size_other FROM p""")
def dummies_pooled_quantity(spark, sf):
    li = load(spark, sf, "lineitem")
    b = li.select("l_orderkey", "l_linenumber",
                  F.when(F.col("l_quantity") <= 2, "tiny").when(F.col("l_quantity") <= 25, "mid")
                  .otherwise("big").alias("size"))
    return E.get_dummies(b, "size", min_fraction=0.1, max_card=20)


@register("ordinal_orderstatus", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS status_code FROM orders""")
def ordinal_orderstatus(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", E.ordinal("o_orderstatus", {"F": 0, "O": 1, "P": 2}).alias("status_code"))
