"""Ordering, top-k and series queries (H*): series = events of one user ordered by (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.operators import sequence as H
from tabforge.plans.registry import register
from tabforge.plans.tables import load

SERIES_SQL = """(SELECT user_id, event_id, event_type, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events)"""


def events(spark, sf):
    return load(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")


def root_values(spark, sf):
    # sqrt(value) is irrational almost everywhere, so smoothed values never sit exactly on a
    # 4-decimal rounding tie and both engines round alike.
    return events(spark, sf).withColumn("value", F.sqrt("value"))


@register("ranked_brand_revenue", """
SELECT p_brand, round(sum(p_retailprice), 2) AS revenue FROM part GROUP BY p_brand ORDER BY revenue DESC""")
def ranked_brand_revenue(spark, sf):
    g = load(spark, sf, "part").groupBy("p_brand").agg(F.round(F.sum("p_retailprice"), 2).alias("revenue"))
    return H.ranked(g, "revenue")


@register("top_k_parts_per_brand", """
SELECT p_brand, p_partkey, p_retailprice, rank FROM (
  SELECT p_brand, p_partkey, p_retailprice,
         row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
WHERE rank <= 3""")
def top_k_parts_per_brand(spark, sf):
    p = load(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice")
    return H.top_k(p, "p_brand", "p_retailprice", 3, tie=["p_partkey"]).withColumn("rank", F.col("rank").cast("long"))


def _ewm_sql(f):
    return f"""
WITH RECURSIVE s AS (SELECT * FROM {SERIES_SQL}),
r AS (SELECT user_id, event_id, t, sqrt(value) AS smooth FROM s WHERE t = 1
      UNION ALL
      SELECT s.user_id, s.event_id, s.t, {f} * sqrt(s.value) + {1 - f} * r.smooth FROM s JOIN r
      ON s.user_id = r.user_id AND s.t = r.t + 1)
SELECT user_id, event_id, t, round(smooth, 4) AS smooth FROM r"""


@register("ewm_events_value", _ewm_sql(0.05))
def ewm_events_value(spark, sf):
    e = H.ewm(root_values(spark, sf), "user_id", ["ts", "event_id"], "value", f=0.05)
    return e.select("user_id", "event_id", "t", F.round("smooth", 4).alias("smooth"))


@register("ewm_events_value_fast", _ewm_sql(0.5))
def ewm_events_value_fast(spark, sf):
    # f = 0.5 gives blocks of 58 rows, so longer series cross block boundaries.
    e = H.ewm(root_values(spark, sf), "user_id", ["ts", "event_id"], "value", f=0.5)
    return e.select("user_id", "event_id", "t", F.round("smooth", 4).alias("smooth"))


@register("diverge_cut_events", f"""
WITH s AS (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS best FROM {SERIES_SQL}),
     c AS (SELECT user_id, min(t) AS stop FROM s WHERE value > 5 * best GROUP BY user_id)
SELECT s.user_id, s.event_id, s.t, s.value, s.best FROM s LEFT JOIN c ON s.user_id = c.user_id
WHERE c.stop IS NULL OR s.t <= c.stop""")
def diverge_cut_events(spark, sf):
    d = H.diverge_cut(events(spark, sf), "user_id", ["ts", "event_id"], "value", factor=5.0)
    return d.select("user_id", "event_id", "t", "value", "best")


@register("running_min_blocked_events", f"""
SELECT user_id, event_id, t, min(value) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS best
FROM {SERIES_SQL}""")
def running_min_blocked_events(spark, sf):
    # Small blocks force the two-level (block window + block prefix) plan.
    d = H.series_position(events(spark, sf), "user_id", ["ts", "event_id"], name="t")
    return H.running_agg(d, "user_id", "t", "value", "min", "best", block=8).select("user_id", "event_id", "t", "best")


@register("trim_events", f"""
SELECT user_id, event_id, t FROM (SELECT *, max(t) OVER (PARTITION BY user_id) AS n FROM {SERIES_SQL})
WHERE t > 10 AND t <= n - 5""")
def trim_events(spark, sf):
    return H.trim(events(spark, sf), "user_id", ["ts", "event_id"], 10, 5).select("user_id", "event_id", "t")


# A third of the events without user: NULL is a series of its own.
NULL_USER_SQL = """(SELECT *, row_number() OVER (PARTITION BY u ORDER BY ts, event_id) AS t, count(*) OVER (PARTITION BY u) AS n
FROM (SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS u, event_id, ts, value FROM events))"""


def null_user_events(spark, sf):
    return events(spark, sf).withColumn("u", F.when(F.col("event_id") % 3 != 0, F.col("user_id")))


@register("trim_events_null_user", f"SELECT u, event_id, t FROM {NULL_USER_SQL} WHERE t > 3 AND t <= n - 2")
def trim_events_null_user(spark, sf):
    return H.trim(null_user_events(spark, sf), "u", ["ts", "event_id"], 3, 2).select("u", "event_id", "t")


@register("running_min_null_user", f"""
SELECT u, event_id, t, min(value) OVER (PARTITION BY u ORDER BY t ROWS UNBOUNDED PRECEDING) AS best FROM {NULL_USER_SQL}""")
def running_min_null_user(spark, sf):
    d = H.series_position(null_user_events(spark, sf), "u", ["ts", "event_id"], name="t")
    return H.running_agg(d, "u", "t", "value", "min", "best", block=8).select("u", "event_id", "t", "best")


@register("best_run_events", """
WITH last AS (SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS event_type
              FROM events GROUP BY user_id)
SELECT user_id, value, event_type FROM last ORDER BY value, user_id LIMIT 1""")
def best_run_events(spark, sf):
    e = events(spark, sf)
    return H.best_run(e, "user_id", "ts", "value", extra=["event_type"], tie=["event_id"]).select("user_id", "value", "event_type")
