"""Source / sink queries (A*): driver tables written to and read back from files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import models as L
from tabforge.plans.registry import register
from tabforge.plans.tables import labelled_orders, load
from tabforge.sources import io as A

CUSTOMER_SCHEMA = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


@register("csv_roundtrip_customer", "SELECT * FROM customer")
def csv_roundtrip_customer(spark, sf):
    path = A.scratch_dir(spark, "csv") + "/customer.csv"
    A.write_csv(load(spark, sf, "customer"), path)
    return A.read_table(spark, path, CUSTOMER_SCHEMA)


@register("read_tables_skip_missing", """
SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region""")
def read_tables_skip_missing(spark, sf):
    d = A.scratch_dir(spark, "tables")
    A.write_csv(load(spark, sf, "nation"), f"{d}/nation.csv")
    A.write_csv(load(spark, sf, "region"), f"{d}/region.csv")
    tabs = A.read_tables(spark, d, ["nation", "region", "train"])  # 'train' is absent and skipped
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, t in tabs.items()]
    return parts[0].unionByName(parts[1])


@register("read_dir_tables", """
SELECT 'part' AS name, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def read_dir_tables(spark, sf):
    d = A.scratch_dir(spark, "dir")
    A.write_csv(load(spark, sf, "part"), f"{d}/part.csv")
    A.write_csv(load(spark, sf, "supplier"), f"{d}/supplier.csv")
    A.write_csv(load(spark, sf, "region"), f"{d}/nested/region.csv")  # a sub-folder: not a table
    tabs = A.read_dir(spark, d)
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, t in sorted(tabs.items())]
    return parts[0].unionByName(parts[1])


@register("saved_features_orders", """
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS label, o_totalprice, c_acctbal
FROM orders JOIN customer ON o_custkey = c_custkey""")
def saved_features_orders(spark, sf):
    path = A.scratch_dir(spark, "features")
    A.save_features(labelled_orders(spark, sf), path, "o_orderkey", ["o_totalprice", "c_acctbal"], label="label")
    df, roles = A.load_features(spark, path)
    return df.select(*roles["key"], *roles["label"], *roles["feature"])


@register("saved_model_orders")
def saved_model_orders(spark, sf):
    d = L.with_label(labelled_orders(spark, sf), "label")
    cols = ["o_totalprice", "c_acctbal", "c_nationkey"]
    m = L.assembled(L.logreg(maxIter=10), cols).fit(d)
    path = A.save_model(m, A.scratch_dir(spark, "model"))
    again = A.load_model(path)
    return again.transform(d).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@register("read_xy_lineitem", """
SELECT l_quantity, l_discount, l_tax, CAST(l_returnflag = 'R' AS DOUBLE) AS target FROM lineitem""")
def read_xy_lineitem(spark, sf):
    path = A.scratch_dir(spark, "xy")
    li = load(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax",
                                            (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    li.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)
    return A.read_xy(spark, path, sep=";", target="returned")
