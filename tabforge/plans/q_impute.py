"""Imputation queries (I*): customer balance and segment code filled from neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import encode as E
from tabforge.operators import impute as I
from tabforge.plans.registry import register
from tabforge.plans.tables import MASKED_CUSTOMER_SQL, load, masked_customer


def r4(c):
    return F.round(c, 4)


def customer_features(spark, sf):
    """customer + segment code + order count; balance missing for every 50th key, segment code for every 40th."""
    c = load(spark, sf, "customer")
    n = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    c = E.cat_codes(c, "c_mktsegment", name="seg")
    c = c.join(n, "c_custkey", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)).cast("long"))
    return c.select("c_custkey", "c_nationkey", "seg", "n_orders",
                    F.when(F.col("c_custkey") % 50 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
                    F.when(F.col("c_custkey") % 40 == 0, F.lit(None)).otherwise(F.col("seg")).alias("seg_masked"))


FEATURES_SQL = """(SELECT c.c_custkey, c.c_nationkey AS f1, CAST(dense_rank() OVER (ORDER BY c.c_mktsegment) - 1 AS INTEGER) AS seg,
  coalesce(o.n, 0) AS n_orders,
  CASE WHEN c.c_custkey % 50 = 0 THEN NULL ELSE c.c_acctbal END AS y,
  CASE WHEN c.c_custkey % 40 = 0 THEN NULL ELSE CAST(dense_rank() OVER (ORDER BY c.c_mktsegment) - 1 AS INTEGER) END AS seg_masked
  FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey)"""


@register("impute_mean_customer", f"""
SELECT c_custkey, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM {MASKED_CUSTOMER_SQL})), 4) AS c_acctbal
FROM {MASKED_CUSTOMER_SQL}""")
def impute_mean_customer(spark, sf):
    f = I.impute_mean(masked_customer(spark, sf), ["c_acctbal"])
    return f.select("c_custkey", r4("c_acctbal").alias("c_acctbal"))


KNN_SQL = f"""
WITH b AS {FEATURES_SQL},
     d AS (SELECT * FROM b WHERE y IS NOT NULL), r AS (SELECT * FROM b WHERE y IS NULL),
     p AS (SELECT r.c_custkey, d.y, ((r.f1 - d.f1) ^ 2 + (r.seg - d.seg) ^ 2 + (r.n_orders - d.n_orders) ^ 2) / 3.0 AS dist,
                  row_number() OVER (PARTITION BY r.c_custkey ORDER BY ((r.f1 - d.f1) ^ 2 + (r.seg - d.seg) ^ 2
                                     + (r.n_orders - d.n_orders) ^ 2) / 3.0, d.c_custkey) AS rn FROM r, d),
     e AS (SELECT c_custkey, sum(y / greatest(dist, 1e-6)) / sum(1 / greatest(dist, 1e-6)) AS est FROM p
           WHERE rn <= 5 GROUP BY c_custkey),
     m AS (SELECT min(y) AS lo, max(y) AS hi FROM d)
SELECT b.c_custkey, round(coalesce(b.y, least(greatest(e.est, m.lo), m.hi)), 4) AS c_acctbal,
       b.y IS NULL AS imputed
FROM b LEFT JOIN e ON b.c_custkey = e.c_custkey, m"""


@register("knn_impute_balance", KNN_SQL)
def knn_impute_balance(spark, sf):
    c = customer_features(spark, sf)
    f = I.knn_impute(c, "c_custkey", "c_acctbal", ["c_nationkey", "seg", "n_orders"], k=5)
    j = f.join(c.select("c_custkey", F.col("c_acctbal").isNull().alias("imputed")), "c_custkey")
    return j.select("c_custkey", r4("c_acctbal").alias("c_acctbal"), "imputed")


def _code_sql(mode):
    est = ("CAST(trunc(sum(seg_masked / greatest(dist, 1e-6)) / sum(1 / greatest(dist, 1e-6))) AS BIGINT)"
           if mode == "mean" else "arg_max(seg_masked, (w, -seg_masked))")
    inner = ("SELECT c_custkey, seg_masked, dist FROM p WHERE rn <= 7" if mode == "mean" else
             "SELECT c_custkey, seg_masked, sum(1 / greatest(dist, 1e-6)) AS w FROM p WHERE rn <= 7 "
             "GROUP BY c_custkey, seg_masked")
    return f"""
WITH b AS {FEATURES_SQL},
     d AS (SELECT * FROM b WHERE seg_masked IS NOT NULL), r AS (SELECT * FROM b WHERE seg_masked IS NULL),
     p AS (SELECT r.c_custkey, d.seg_masked, ((r.f1 - d.f1) ^ 2 + (r.n_orders - d.n_orders) ^ 2) / 2.0 AS dist,
                  row_number() OVER (PARTITION BY r.c_custkey ORDER BY ((r.f1 - d.f1) ^ 2 + (r.n_orders - d.n_orders) ^ 2) / 2.0,
                                     d.c_custkey) AS rn FROM r, d),
     e AS (SELECT c_custkey, {est} AS est FROM ({inner}) GROUP BY c_custkey)
SELECT b.c_custkey, CAST(coalesce(b.seg_masked, e.est) AS INTEGER) AS seg_filled FROM b LEFT JOIN e ON b.c_custkey = e.c_custkey"""


@register("knn_impute_segment_code", _code_sql("mean"))
def knn_impute_segment_code(spark, sf):
    c = customer_features(spark, sf)
    f = I.knn_impute(c, "c_custkey", "seg_masked", ["c_nationkey", "n_orders"], k=7, categorical=True, clip=False)
    return f.select("c_custkey", F.col("seg_masked").cast("int").alias("seg_filled"))


@register("knn_impute_segment_vote", _code_sql("vote"))
def knn_impute_segment_vote(spark, sf):
    c = customer_features(spark, sf)
    f = I.knn_impute(c, "c_custkey", "seg_masked", ["c_nationkey", "n_orders"], k=7, vote=True)
    return f.select("c_custkey", F.col("seg_masked").cast("int").alias("seg_filled"))


@register("imputation_report_balance", f"""
SELECT c_custkey, c_acctbal AS imputed FROM ({KNN_SQL}) WHERE imputed""")
def imputation_report_balance(spark, sf):
    c = customer_features(spark, sf)
    f = I.knn_impute(c, "c_custkey", "c_acctbal", ["c_nationkey", "seg", "n_orders"], k=5)
    rep = I.imputation_report(c, f, "c_custkey", "c_acctbal")
    return rep.select("c_custkey", r4("imputed").alias("imputed"))


@register("imputation_range_balance", f"""
SELECT round(min(y), 4) AS min_before, round(avg(y), 4) AS mean_before, round(max(y), 4) AS max_before,
       (SELECT round(min(c_acctbal), 4) FROM ({KNN_SQL})) AS min_after,
       (SELECT round(avg(c_acctbal), 4) FROM ({KNN_SQL})) AS mean_after,
       (SELECT round(max(c_acctbal), 4) FROM ({KNN_SQL})) AS max_after
FROM {FEATURES_SQL}""")
def imputation_range_balance(spark, sf):
    c = customer_features(spark, sf)
    f = I.knn_impute(c, "c_custkey", "c_acctbal", ["c_nationkey", "seg", "n_orders"], k=5)
    r = I.imputation_range(c, f, "c_acctbal")
    return r.select(*[r4(x).alias(x) for x in r.columns])


@register("no_nulls_after_impute", """
SELECT 'c_acctbal' AS column, CAST(0 AS BIGINT) AS nulls""")
def no_nulls_after_impute(spark, sf):
    c = customer_features(spark, sf)
    f = I.knn_impute(c, "c_custkey", "c_acctbal", ["c_nationkey", "seg", "n_orders"], k=5)
    return I.assert_no_nulls(f, ["c_acctbal"])


@register("knn_impute_nation_code", f"""
WITH b AS {FEATURES_SQL},
     c AS (SELECT c_custkey, seg, n_orders, CASE WHEN c_custkey % 30 = 0 THEN NULL ELSE f1 END AS nation FROM b),
     d AS (SELECT * FROM c WHERE nation IS NOT NULL), r AS (SELECT * FROM c WHERE nation IS NULL),
     p AS (SELECT r.c_custkey, d.nation, ((r.seg - d.seg) ^ 2 + (r.n_orders - d.n_orders) ^ 2) / 2.0 AS dist,
                  row_number() OVER (PARTITION BY r.c_custkey ORDER BY ((r.seg - d.seg) ^ 2 + (r.n_orders - d.n_orders) ^ 2) / 2.0,
                                     d.c_custkey) AS rn FROM r, d),
     e AS (SELECT c_custkey, least(greatest(sum(nation / greatest(dist, 1e-6)) / sum(1 / greatest(dist, 1e-6)),
                  (SELECT min(nation) FROM d)), (SELECT max(nation) FROM d)) AS est FROM p WHERE rn <= 100 GROUP BY c_custkey)
SELECT c.c_custkey, CAST(coalesce(c.nation, CAST(trunc(e.est) AS BIGINT)) AS INTEGER) AS nation_filled
FROM c LEFT JOIN e ON c.c_custkey = e.c_custkey""")
def knn_impute_nation_code(spark, sf):
    # A many-valued code filled from 100 neighbours over the remaining columns only (balance excluded).
    c = customer_features(spark, sf).withColumn(
        "nation", F.when(F.col("c_custkey") % 30 == 0, F.lit(None)).otherwise(F.col("c_nationkey")))
    f = I.knn_impute(c, "c_custkey", "nation", ["seg", "n_orders"], k=100, categorical=True)
    return f.select("c_custkey", F.col("nation").cast("int").alias("nation_filled"))


# --- I2 over 22 features, those from orders NULL for customers without any -------------------------------
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1", "2", "3", "4", "5"]
STATUSES = ["F", "O", "P"]
WIDE = ([f"seg{i}" for i in range(5)] + [f"reg{i}" for i in range(5)] + ["nation", "n_orders"]
        + [f"prio{p}" for p in PRIORITIES] + [f"st{s}" for s in STATUSES] + ["min_price", "max_price"])


def wide_customer(spark, sf):
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders"),
        *[F.count_if(F.substring("o_orderpriority", 1, 1) == p).alias(f"prio{p}") for p in PRIORITIES],
        *[F.count_if(F.col("o_orderstatus") == s).alias(f"st{s}") for s in STATUSES],
        (F.min("o_totalprice") / 100000).alias("min_price"), (F.max("o_totalprice") / 100000).alias("max_price"))
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = load(spark, sf, "customer").join(n, "c_nationkey", "left").join(o, "c_custkey", "left")
    return c.select(
        "c_custkey", *[(F.col("c_mktsegment") == s).cast("int").alias(f"seg{i}") for i, s in enumerate(SEGMENTS)],
        *[(F.col("n_regionkey") == i).cast("int").alias(f"reg{i}") for i in range(5)], (F.col("c_nationkey") / 25.0).alias("nation"),
        *WIDE[11:], F.when(F.col("c_custkey") % 20 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"))


_DIFFS = [f"(r.{f} - d.{f})" for f in WIDE]
_WIDE_DIST = (f"({' + '.join(f'coalesce({x} * {x}, 0)' for x in _DIFFS)}) / "
              f"nullif({' + '.join(f'CAST({x} IS NOT NULL AS INTEGER)' for x in _DIFFS)}, 0)")


@register("knn_impute_balance_wide", f"""
WITH o AS (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n_orders,
       {", ".join(f"CAST(count(*) FILTER (substr(o_orderpriority, 1, 1) = '{p}') AS DOUBLE) AS prio{p}" for p in PRIORITIES)},
       {", ".join(f"CAST(count(*) FILTER (o_orderstatus = '{s}') AS DOUBLE) AS st{s}" for s in STATUSES)},
       min(o_totalprice) / 100000 AS min_price, max(o_totalprice) / 100000 AS max_price FROM orders GROUP BY o_custkey),
     b AS (SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE c_acctbal END AS y,
       {", ".join(f"CAST(c_mktsegment = '{s}' AS DOUBLE) AS seg{i}" for i, s in enumerate(SEGMENTS))},
       {", ".join(f"CAST(n_regionkey = {i} AS DOUBLE) AS reg{i}" for i in range(5))}, c_nationkey / CAST(25 AS DOUBLE) AS nation, o.* EXCLUDE (o_custkey)
       FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN o ON o_custkey = c_custkey),
     p AS (SELECT r.c_custkey, d.y, {_WIDE_DIST} AS dist, d.c_custkey AS dk FROM b r, b d WHERE r.y IS NULL AND d.y IS NOT NULL),
     t AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY dist, dk) AS rn FROM p WHERE dist IS NOT NULL),
     e AS (SELECT c_custkey, sum(y / greatest(dist, 1e-6)) / sum(1 / greatest(dist, 1e-6)) AS est FROM t WHERE rn <= 100 GROUP BY c_custkey),
     m AS (SELECT min(y) AS lo, max(y) AS hi FROM b)
SELECT b.c_custkey, round(coalesce(b.y, least(greatest(e.est, m.lo), m.hi)), 4) AS c_acctbal, b.y IS NULL AS imputed
FROM b LEFT JOIN e ON b.c_custkey = e.c_custkey, m""")
def knn_impute_balance_wide(spark, sf):
    c = wide_customer(spark, sf)
    f = I.knn_impute(c, "c_custkey", "c_acctbal", WIDE, k=100)
    j = f.join(c.select("c_custkey", F.col("c_acctbal").isNull().alias("imputed")), "c_custkey")
    return j.select("c_custkey", r4("c_acctbal").alias("c_acctbal"), "imputed")


# --- I2 over 22 features of orders: many rows, few-valued features, ties everywhere ----------------------------------------
MONTHS = ["01", "03", "05", "07", "08", "10", "12"]
FLAGS = ["A", "N", "R"]
ORDER_FEATURES = (["n_lines", "quantity", "discount", "tax"] + [f"month{i}" for i in range(7)] + [f"flag{f}" for f in FLAGS] + ["open", "lines_late"]
                  + [f"prio{p}" for p in PRIORITIES] + ["balance"])


def order_features(spark, sf):
    """Counts and whole-number sums per order (equal in any order of addition); tax is NULL for orders of one line."""
    n = F.count("*")
    li = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        n.alias("n_lines"), (F.sum("l_quantity") / 50).alias("quantity"), (F.sum(F.round(F.col("l_discount") * 100).cast("int")) / 10).alias("discount"),
        F.when(n > 1, F.sum(F.round(F.col("l_tax") * 100).cast("int")) / 8).alias("tax"),
        *[F.count_if(F.date_format("l_shipdate", "MM") == m).alias(f"month{i}") for i, m in enumerate(MONTHS)],
        *[F.count_if(F.col("l_returnflag") == f).alias(f"flag{f}") for f in FLAGS],
        F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count_if(F.col("l_linenumber") > 3).alias("lines_late"))
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") / 5000).alias("balance"))
    # Shuffled: as a hash table on the driver the customers are many times their size in files.
    o = load(spark, sf, "orders").join(c.hint("merge"), "o_custkey", "left").join(li.hint("merge"), "o_orderkey", "left")
    return o.select("o_orderkey", *ORDER_FEATURES[:16], *[(F.substring("o_orderpriority", 1, 1) == p).cast("int").alias(f"prio{p}") for p in PRIORITIES], "balance",
                    F.when(F.col("o_orderkey") % 20 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("o_totalprice"))


_ORDER_DIFFS = [f"(r.{f} - d.{f})" for f in ORDER_FEATURES]
_ORDER_DIST = (f"({' + '.join(f'coalesce({x} * {x}, 0)' for x in _ORDER_DIFFS)}) / "
               f"nullif({' + '.join(f'CAST({x} IS NOT NULL AS INTEGER)' for x in _ORDER_DIFFS)}, 0)")


@register("knn_impute_price_orders", f"""
WITH l AS (SELECT l_orderkey AS o_orderkey, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) / 50 AS quantity,
       sum(CAST(round(l_discount * 100) AS INTEGER)) / CAST(10 AS DOUBLE) AS discount,
       CASE WHEN count(*) > 1 THEN sum(CAST(round(l_tax * 100) AS INTEGER)) / CAST(8 AS DOUBLE) END AS tax,
       {", ".join(f"CAST(count(*) FILTER (strftime(l_shipdate, '%m') = '{m}') AS DOUBLE) AS month{i}" for i, m in enumerate(MONTHS))},
       {", ".join(f"CAST(count(*) FILTER (l_returnflag = '{f}') AS DOUBLE) AS flag{f}" for f in FLAGS)},
       CAST(count(*) FILTER (l_linestatus = 'O') AS DOUBLE) AS "open", CAST(count(*) FILTER (l_linenumber > 3) AS DOUBLE) AS lines_late
       FROM lineitem GROUP BY l_orderkey),
     b AS (SELECT o.o_orderkey, CASE WHEN o.o_orderkey % 20 = 0 THEN NULL ELSE o_totalprice END AS y, l.* EXCLUDE (o_orderkey),
       {", ".join(f"CAST(substr(o_orderpriority, 1, 1) = '{p}' AS DOUBLE) AS prio{p}" for p in PRIORITIES)}, c_acctbal / 5000 AS balance
       FROM orders o LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l.o_orderkey = o.o_orderkey),
     p AS (SELECT r.o_orderkey, d.y, {_ORDER_DIST} AS dist, d.o_orderkey AS dk FROM b r, b d WHERE r.y IS NULL AND d.y IS NOT NULL),
     t AS (SELECT * FROM p WHERE dist IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY dist, dk) <= 25),
     e AS (SELECT o_orderkey, sum(y / greatest(dist, 1e-6)) / sum(1 / greatest(dist, 1e-6)) AS est FROM t GROUP BY o_orderkey),
     m AS (SELECT min(y) AS lo, max(y) AS hi FROM b)
SELECT b.o_orderkey, round(coalesce(b.y, least(greatest(e.est, m.lo), m.hi)), 3) AS o_totalprice FROM b LEFT JOIN e ON b.o_orderkey = e.o_orderkey, m""")
def knn_impute_price_orders(spark, sf):
    f = I.knn_impute(order_features(spark, sf), "o_orderkey", "o_totalprice", ORDER_FEATURES, k=25)
    return f.select("o_orderkey", F.round("o_totalprice", 3).alias("o_totalprice"))
