"""Union / split / key-join queries (F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import combine as J
from tabforge.plans.registry import register
from tabforge.plans.tables import load

# customer split in two "files" by a hash of the key (same in Spark and DuckDB).
def test_side():
    return F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 1) < "4"


TEST_SIDE_SQL = "substring(md5(CAST(c_custkey AS VARCHAR)), 1, 1) < '4'"


def customer_parts(spark, sf):
    c = load(spark, sf, "customer")
    train = c.where(~test_side())
    test = c.where(test_side()).drop("c_acctbal")
    return train, test


@register("union_origin_customer", f"""
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, 'train' AS origin FROM customer WHERE NOT ({TEST_SIDE_SQL})
UNION ALL
SELECT c_custkey, c_name, c_nationkey, NULL AS c_acctbal, c_mktsegment, 'test' AS origin FROM customer
WHERE {TEST_SIDE_SQL}""")
def union_origin_customer(spark, sf):
    train, test = customer_parts(spark, sf)
    return J.union_origin(train, test)


@register("split_origin_customer_test", f"""
SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE {TEST_SIDE_SQL}""")
def split_origin_customer_test(spark, sf):
    train, test = customer_parts(spark, sf)
    both = J.union_origin(train, test)
    return J.split_origin(both, label="c_acctbal")[1]


@register("join_full_orders_customer", """
SELECT c.c_custkey, o.o_orderkey, o.o_totalprice, c.c_mktsegment
FROM (SELECT * FROM orders) o FULL OUTER JOIN customer c ON o.o_custkey = c.c_custkey""")
def join_full_orders_customer(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return J.join_full(o, c, "c_custkey").select("c_custkey", "o_orderkey", "o_totalprice", "c_mktsegment")


@register("join_left_customer_nation", """
SELECT c_custkey, c_nationkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def join_left_customer_nation(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = load(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return J.join_left(c, n, "c_nationkey")


@register("group_assign_orders", """
SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS sum_o_totalprice,
       count(*) OVER (PARTITION BY o_custkey) AS n_orders FROM orders""")
def group_assign_orders(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    g = J.group_assign(o, "o_custkey", "o_totalprice", "sum")
    g = J.group_assign(g, "o_custkey", "o_orderkey", "count", name="n_orders")
    return g.select("o_orderkey", "o_custkey", F.round("sum_o_totalprice", 2).alias("sum_o_totalprice"), "n_orders")


@register("assign_by_key_customer", """
SELECT c.c_custkey, c.c_mktsegment, s.n_orders FROM customer c
LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) s
ON c.c_custkey = s.c_custkey""")
def assign_by_key_customer(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.lit(0).alias("n_orders"))
    s = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return J.assign_by_key(c, s, "c_custkey", ["n_orders"])


@register("join_predictions_labels", """
SELECT l.doc_id, l.quality AS by_label, CAST(d.n_chars > 2000 AS INTEGER) AS by_length,
       CAST(d.lang = 'en' AS INTEGER) AS by_lang
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def join_predictions_labels(spark, sf):
    lab = load(spark, sf, "labels").select("doc_id", F.col("quality").alias("pred"))
    d = load(spark, sf, "documents")
    a = d.select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("pred"))
    b = d.select("doc_id", (F.col("lang") == "en").cast("int").alias("pred"))
    return J.join_predictions({"by_label": lab, "by_length": a, "by_lang": b}, "doc_id")


@register("value_sets_nations", """
SELECT c_nationkey AS nationkey, 'both' AS side FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT c_nationkey, 'only_customer' FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT s_nationkey, 'only_supplier' FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)""")
def value_sets_nations(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"))
    s = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    both, only_c, only_s = J.value_sets(c, s, "nationkey")
    return (both.withColumn("side", F.lit("both"))
                .unionByName(only_c.withColumn("side", F.lit("only_customer")))
                .unionByName(only_s.withColumn("side", F.lit("only_supplier"))))
