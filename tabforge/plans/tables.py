"""Driver tables and the derived inputs the registered queries run on.

The driver's tables hold no NULLs, so inputs that need missing values derive
them from a key, written identically here (Spark) and in the SQL text (DuckDB).
Each ``X_SQL`` string is a DuckDB sub-select equal to the Spark frame ``x``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# customer with c_acctbal missing for every fifth key (B*, I1–I3).
def masked_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.lit(None))
                        .otherwise(F.col("c_acctbal")))


MASKED_CUSTOMER_SQL = """(SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer)"""


# events with value missing for every seventh event (B*, G*).
def masked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.withColumn("value", F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value")))


MASKED_EVENTS_SQL = """(SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props FROM events)"""


# orders with the 0/1 label "fulfilled" and customer attributes (G*, M*).
def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    c = load(spark, sf_dir, "customer")
    return (o.join(c, o.o_custkey == c.c_custkey, "inner")
             .select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus",
                     "c_mktsegment", "c_nationkey", "c_acctbal",
                     (F.col("o_orderstatus") == "F").cast("int").alias("label")))


LABELLED_ORDERS_SQL = """(SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus,
  c_mktsegment, c_nationkey, c_acctbal, CAST(o_orderstatus = 'F' AS INTEGER) AS label
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


# lineitem with the 0/1 label "returned" (G*, K*, N*).
def labelled_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.withColumn("label", (F.col("l_returnflag") == "R").cast("int"))


LABELLED_LINEITEM_SQL = """(SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem)"""
