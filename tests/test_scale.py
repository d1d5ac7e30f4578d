"""Steps that must not gather a table in one task or repeat its scans."""

import numpy as np
from pyspark.sql import functions as F

from tabforge.plans import ranking


def test_quantiles_of_few_values_never_rank_the_whole_table(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("all rows of a value would go to one task")
    monkeypatch.setattr(ranking, "rank_quantiles", refused)
    rows = [(7.0, float(i % 3), float(i % 2000) / 4, -0.0 if i % 2 else float("nan")) for i in range(20_000)]
    df = spark.createDataFrame(rows, "same double, few double, many double, holes double")
    probs = [0.0, 0.25, 1 / 3, 0.5, 0.75, 1.0]
    got = {(r["column"], r["p"]): r["value"] for r in ranking.exact_quantiles(df, df.columns, probs, accuracy=200, max_collect=40).collect()}
    for i, c in enumerate(df.columns):
        known = [r[i] for r in rows if r[i] == r[i]]
        for p in probs:
            assert abs(got[(c, p)] - np.quantile(known, p)) < 1e-9, (c, p)


def test_row_numbers_of_few_groups_are_not_shuffled_twice(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("g"), "id")
    out = ranking.exact_row_number(df, ["id"], partition_by=["g"])
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["g"], r["id"]): r["rn"] for r in out.collect()} == {(i % 2, i): i // 2 + 1 for i in range(300)}


def test_votes_are_not_shuffled_by_model(spark):
    """Rows of one model would all meet in one task."""
    from tabforge.operators import models as L
    probs = spark.range(200).select(F.col("id").alias("key"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"), (F.col("id") / 200).alias("p"))
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.6)], "model string, score double").groupBy("model").agg(F.avg("score").alias("score"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        v = L.soft_vote(probs, scores)
        assert "SortMergeJoin" not in v._jdf.queryExecution().executedPlan().toString() and v.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_round_of_boosting_applies_one_tree(spark, monkeypatch):
    from tabforge.operators import models as L
    calls, member = [], L._member
    monkeypatch.setattr(L, "_member", lambda *a: calls.append(1) or member(*a))
    rows = [(i, float(i % 17), float(i % 5), int((i * 7) % 11 > 4)) for i in range(400)]
    ens = L.adaboost(spark.createDataFrame(rows, "k int, a double, b double, y int"), ["a", "b"], "y", "k", depth=2, rounds=5)
    assert len(ens.members) == 5 and len(calls) == 5


def test_grid_scores_the_folds_without_their_joins(spark):
    """Every fit reads rows that were written once, and the best of equal settings is the first."""
    from pyspark.sql import DataFrame

    from tabforge.operators import models as L
    rows = [(float(i % 4), int(i % 4 > 1), i % 3) for i in range(240)]
    df = spark.createDataFrame(rows, "a double, y int, fold int").join(spark.range(3).withColumnRenamed("id", "fold"), "fold")
    seen, fit = [], L.Pipeline.fit

    def spied(self, data: DataFrame, *more):
        seen.append(data._jdf.queryExecution().optimizedPlan().toString())
        return fit(self, data, *more)
    L.Pipeline.fit = spied
    try:
        table, best = L.grid_search(df, L.tree(seed=0), {"maxDepth": [1, 3], "impurity": ["gini"]}, ["a"], "y", "fold")
    finally:
        L.Pipeline.fit = fit
    assert [r["score"] for r in table.collect()] == [1.0, 1.0] and best.stages[-1].depth == 1
    assert len(seen) == 7 and not any("Join" in p.replace("JoinedRow", "") for p in seen)


def test_features_of_parent_combinations(spark):
    from tabforge.operators import features as FT
    rows = [(i, i % 3 if i % 7 else None, "xy"[i % 2], float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, a int, b string, v double")
    kw = dict(numeric=["v"], depth=2, deep_primitives=["mean", "max"])
    whole = FT.dfs(df, "k", ["a", "b"], **kw).drop("k", "v").distinct()
    few = FT.dfs(df, "k", ["a", "b"], combinations=True, **kw)
    assert few.columns == whole.columns and few.count() == 8
    assert sorted(map(str, few.collect())) == sorted(map(str, whole.collect()))


def test_neighbours_of_other_groups_share_one_tree(spark):
    from tabforge.operators.neighbors import knn
    rows = [(i, float(i * 7 % 23), float(i * 5 % 11) if i % 13 else None, i % 3, i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, a double, b double, g int, y int")
    got = knn(df, df.withColumnRenamed("k", "d"), ["a", "b"], 5, "k", "d", "y", metric="manhattan", leaf_rows=30, block_rows=20, apart="g")
    apart = {(r["k"], r["rank"]): (r["d"], r["dist"]) for r in got.collect()}
    for g in range(3):
        one = knn(df.where(F.col("g") == g), df.where(F.col("g") != g).withColumnRenamed("k", "d"), ["a", "b"], 5, "k", "d", "y", metric="manhattan")
        for r in one.collect():
            assert apart.pop((r["k"], r["rank"])) == (r["d"], r["dist"])
    assert not apart


def test_flow_fits_rows_that_are_written_once(spark, tmp_path):
    """Neither model joins the customers or the estimates again with each of its scans."""
    from tabforge.operators import models as L
    from tabforge.plans.q_flow import classification_flow_orders
    customer = [(i, i % 4, float(i * 37 % 101), "ABC"[i % 3]) for i in range(20)]
    spark.createDataFrame(customer, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(i, i % 20, "FO"[i * 7 % 5 > 2], float(i * 991 % 90_000), f"{1 + i % 5}-X") for i in range(300)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    seen, fit = [], L.Pipeline.fit

    def spied(self, data, *more):
        seen.append(data._jdf.queryExecution().optimizedPlan().toString())
        return fit(self, data, *more)
    L.Pipeline.fit = spied
    try:
        got = classification_flow_orders(spark, str(tmp_path)).collect()
    finally:
        L.Pipeline.fit = fit
    assert len(got) == 60 and {r["label"] for r in got} <= {0, 1}
    assert len(seen) == 2 and not any("Join" in p.replace("JoinedRow", "") for p in seen)
