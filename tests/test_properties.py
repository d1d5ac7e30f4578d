"""Property tests: exact distributed operators against brute force on small data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import sequence as H
from tabforge.operators import validate as V
from tabforge.operators.neighbors import knn
from tabforge.operators.symbolic import pareto_front
from tabforge.plans.ranking import exact_quantiles, exact_row_number, rank_quantiles


def test_exact_row_number_matches_sort_and_ignores_layout(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, g string, v int")
    for parts in (1, 7):
        r = exact_row_number(df.repartition(parts), ["v", "k"], partition_by=["g"], name="rn")
        got = {(x["k"]): x["rn"] for x in r.collect()}
        for g in "ab":
            exp = sorted((v, k) for k, gg, v in rows if gg == g)
            for i, (v, k) in enumerate(exp, start=1):
                assert got[k] == i


def test_exact_quantiles_ties_and_fallback(spark):
    rng = random.Random(2)
    vals = [float(rng.choice([1, 2, 2, 3, 5, 8])) for _ in range(3000)] + [rng.random() for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    exp = {p: float(np.quantile(vals, p)) for p in probs}
    for kw in ({}, {"max_collect": 50}, {"max_collect": 50, "max_levels": 0}):
        got = {r["p"]: r["value"] for r in exact_quantiles(df, ["x"], probs, **kw).collect()}
        assert all(abs(got[p] - exp[p]) < 1e-12 for p in probs), kw
    got = {r["p"]: r["value"] for r in rank_quantiles(df, ["x"], probs).collect()}
    assert all(abs(got[p] - exp[p]) < 1e-12 for p in probs)


def test_split_exact_disjoint_complete(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    s = V.split(df, "k", 0.8, seed=3)
    c = {r["part"]: r["n"] for r in s.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert c["test"] == math.ceil((1 - 0.8) * 1003) and c["train"] + c["test"] == 1003
    assert s.select("k").distinct().count() == 1003


def test_stratified_fold_balance(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, int(rng.random() < 0.3)) for i in range(777)], "k int, y int")
    f = V.stratified_folds(df, "y", "k", 9, shuffle_seed=11)
    sizes = f.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        ns = [r["count"] for r in sizes if r["y"] == y]
        assert max(ns) - min(ns) <= 1


def test_auc_rank_rule_and_monotone_invariance(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.4), float(rng.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    a1 = V.auc(df, "y", "s").first()[0]
    a2 = V.auc(df.withColumn("s", F.exp(F.col("s") / 10)), "y", "s").first()[0]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(a1 - brute) < 1e-12 and abs(a2 - brute) < 1e-12


def test_running_min_blocked_equals_window(spark):
    rng = random.Random(6)
    rows = [(g, t, rng.random()) for g in range(3) for t in range(1, 60 + g * 40)]
    df = spark.createDataFrame(rows, "g int, t int, v double")
    got = {(r["g"], r["t"]): r["m"] for r in H.running_agg(df, "g", "t", "v", "min", "m", block=7).collect()}
    for g in range(3):
        cur = math.inf
        for (gg, t, v) in [x for x in rows if x[0] == g]:
            cur = min(cur, v)
            assert got[(g, t)] == cur


def test_ewm_blocks_match_recurrence(spark):
    rng = random.Random(7)
    rows = [("a", t, rng.uniform(0, 10)) for t in range(300)]
    df = spark.createDataFrame(rows, "s string, t int, v double")
    got = [r["smooth"] for r in H.ewm(df, "s", ["t"], "v", f=0.6).orderBy("t").collect()]
    cur = None
    for (s, t, v), g in zip(rows, got):
        cur = v if cur is None else 0.6 * v + 0.4 * cur
        assert abs(g - cur) < 1e-9 * max(1.0, abs(cur))


def test_knn_matches_brute_force(spark):
    rng = np.random.RandomState(8)
    d = rng.randint(0, 6, size=(300, 2)).astype(float)
    q = rng.uniform(0, 6, size=(40, 2))
    donors = spark.createDataFrame([(i, float(i % 7), *map(float, x)) for i, x in enumerate(d)], "dk long, y double, a double, b double")
    queries = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(q)], "qk long, a double, b double")
    for metric in ("mean_sq", "manhattan", "euclidean"):
        nb = knn(queries, donors, ["a", "b"], 5, "qk", "dk", "y", metric=metric)
        got = {}
        for r in nb.collect():
            got.setdefault(r["qk"], []).append((r["rank"], r["dk"]))
        for i, x in enumerate(q):
            diff = d - x
            dist = {"mean_sq": (diff ** 2).mean(1), "manhattan": np.abs(diff).sum(1),
                    "euclidean": np.sqrt((diff ** 2).sum(1))}[metric]
            exp = sorted(range(len(d)), key=lambda j: (dist[j], j))[:5]
            assert [k for _, k in sorted(got[i])] == exp, (metric, i)


def test_pareto_front_matches_brute_force(spark):
    rng = random.Random(9)
    pts = [(i, rng.randint(0, 20), round(rng.random(), 2)) for i in range(200)]
    df = spark.createDataFrame(pts, "id int, acc int, ce double")
    got = {r["id"] for r in pareto_front(df, "acc", "ce").collect()}
    exp = {i for i, a, c in pts if not any((a2 >= a and c2 <= c and (a2 > a or c2 < c)) for _, a2, c2 in pts)}
    assert got == exp


def test_ordered_prefix_distributed_path_equals_window(spark):
    rng = random.Random(10)
    rows = [(i, rng.randint(-50, 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, v int")
    for excl in (False, True):
        small = H.ordered_prefix(df, [F.desc("k")], "v", "sum", "s", exclusive=excl)
        big = H.ordered_prefix(df, [F.desc("k")], "v", "sum", "s", exclusive=excl, small=5)
        a = {r["k"]: r["s"] for r in small.collect()}
        b = {r["k"]: r["s"] for r in big.collect()}
        assert a == b
        acc = None
        for k, v in sorted(rows, reverse=True):
            incl = (acc or 0) + v
            assert a[k] == (acc if excl else incl)
            acc = incl


def test_knn_many_rounds_with_checkpoints(spark):
    rng = np.random.RandomState(12)
    d = rng.uniform(0, 10, size=(120, 2))
    q = rng.uniform(0, 10, size=(15, 2))
    donors = spark.createDataFrame([(i, 0.0, *map(float, x)) for i, x in enumerate(d)], "dk long, y double, a double, b double")
    queries = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(q)], "qk long, a double, b double")
    nb = knn(queries, donors, ["a", "b"], 6, "qk", "dk", "y", metric="euclidean", leaf_rows=40)
    got = {}
    for r in nb.collect():
        got.setdefault(r["qk"], []).append((r["rank"], r["dk"]))
    for i, x in enumerate(q):
        dist = np.sqrt(((d - x) ** 2).sum(1))
        exp = sorted(range(len(d)), key=lambda j: (dist[j], j))[:6]
        assert [k for _, k in sorted(got[i])] == exp


def test_dfs_modes(spark):
    from tabforge.operators.features import dfs
    rng = random.Random(13)
    rows = [(i, rng.choice("xyz"), rng.choice(["a", "b", "c", "d"]), float(rng.randint(0, 9))) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, p string, c string, v double")
    got = {r["p"]: r for r in dfs(df, "k", ["p"], numeric=["v"], categorical=["c"]).collect()}
    for p in "xyz":
        counts = {}
        for _, pp, c, _ in rows:
            if pp == p:
                counts[c] = counts.get(c, 0) + 1
        assert got[p]["p__mode__c"] == min(counts, key=lambda c: (-counts[c], c)) and got[p]["p__num_unique__c"] == len(counts)


def test_dfs_depth_three(spark):
    """Against pandas, which attaches every level to the base rows; NULL parents, children and single rows."""
    import pandas as pd
    from tabforge.operators.features import define_features, dfs
    rng = random.Random(14)
    rows = [(i, rng.choice(["x", "y", "z", None]), rng.choice("abcd"), rng.choice([1, 2, 3]), rng.choice([None, 1.5, 2.0, 7.25, float(i)])) for i in range(150)]
    rows += [(150, "single", "a", 1, 3.0), (151, "none", "b", 2, None)]
    df = spark.createDataFrame(rows, "k int, p string, c string, e int, v double")
    parents, prims = ["p", "c", "e"], ["sum", "mean", "max", "min", "std", "skew"]
    features = define_features(parents, ["v"], ["c"], depth=3, deep_primitives=["mean", "std", "skew"])
    out = dfs(df, "k", parents, numeric=["v"], categorical=["c"], depth=3, deep_primitives=["mean", "std", "skew"])
    assert out.columns == [*df.columns, *(f.name for f in features)] and len(set(out.columns)) == len(out.columns)
    assert {f.depth for f in features} == {1, 2, 3} and prims == [f.primitive for f in features if f.parent == "e" and f.child == "v"]
    wide = pd.DataFrame(rows, columns=df.columns)
    wide["rows"] = 1
    for f in features:
        child = f.child if isinstance(f.child, str) else f.child.name
        g = wide[[f.parent, child]].dropna(subset=[f.parent]).groupby(f.parent)[child]
        if f.primitive == "mode":
            made = g.apply(lambda s: s.value_counts().sort_index().sort_values(ascending=False, kind="stable").index[0] if s.notna().any() else None)
        else:
            made = {"count": g.sum, "sum": lambda: g.sum(min_count=1), "num_unique": g.nunique}.get(f.primitive, getattr(g, f.primitive, None))()
        wide[f.name] = wide[f.parent].map(made)
    got = {r["k"]: r for r in out.collect()}
    for r in wide.to_dict("records"):
        for f in features:
            x, y = r[f.name], got[r["k"]][f.name]
            if f.primitive in ("std", "skew") and x == x and x is not None and abs(x) < 1e-9:
                assert y is None or abs(y) < 1e-6, f.name
            elif x is None or x != x:
                assert y is None, (f.name, r, y)
            else:
                assert x == y if isinstance(x, str) else y is not None and abs(x - y) <= 1e-6 * max(1, abs(x)), (f.name, x, y)


def test_group_assign_splits_a_hot_key(spark):
    from pyspark.sql import functions as F
    from tabforge.operators.combine import group_assign
    df = spark.range(0, 60000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("g"), F.col("id").alias("v"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = group_assign(df.repartition(8), "g", "v", "max", "top")
        wrong = out.where(F.when(F.col("g") == 0, F.col("top") != 59997).otherwise(F.col("top") != F.col("v")))
        assert wrong.count() == 0
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_pareto_rank_has_no_cap_and_matches_brute_force(spark):
    import inspect

    from tabforge.operators.symbolic import pareto_rank
    assert list(inspect.signature(pareto_rank).parameters) == ["df", "key", "maximize", "minimize"]
    rows = [(i, float(i * 7 % 5), float(i * 3 % 4)) for i in range(18)]
    df = spark.createDataFrame(rows, "id int, acc double, ce double")
    rest, expected, rank = rows, {}, 0
    while rest:
        rank += 1
        front = [r for r in rest if not any(a[1] >= r[1] and a[2] <= r[2] and a[1:] != r[1:] for a in rest)]
        expected |= {r[0]: rank for r in front}
        rest = [r for r in rest if r not in front]
    assert {r["id"]: r["front"] for r in pareto_rank(df, "id", "acc", "ce").collect()} == expected and rank > 3
    with pytest.raises(ValueError):
        pareto_rank(spark.createDataFrame([(1, None, 1.0)], "id int, acc double, ce double"), "id", "acc", "ce")
