"""Operators of wide, skewed or degenerate input against plain Python."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.functions import columns as C
from tabforge.operators import encode as E
from tabforge.operators import preprocess as K
from tabforge.operators import summarize as S
from tabforge.operators import symbolic as N
from tabforge.operators import validate as V


def test_split_without_sorting(spark, monkeypatch):
    monkeypatch.setattr(V, "BRACKET_ROWS", 100)
    df = spark.range(5000).withColumnRenamed("id", "k")
    order = sorted(range(5000), key=lambda k: (hashlib.md5(f"3#{k}".encode()).hexdigest(), k))
    for frac in (0.0, 0.0002, 0.37, 0.9998, 1.0):
        got = {r["k"] for r in V.sample_exact(df, "k", frac, seed=3).collect()}
        assert got == set(order[:round(frac * 5000)])
    plan = V.sample_exact(df, "k", 0.37, seed=3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    holes = spark.createDataFrame([(1,), (None,), (2,), (None,)], "k long")
    for call in (lambda: V.split(holes, "k", 0.5), lambda: V.sample_exact(holes, "k", 0.5), lambda: V.stratified_folds(holes.withColumn("y", F.lit(1)), "y", "k", 2)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(ValueError):
        V.sample_exact(df.withColumn("k", F.lit(7)), "k", 0.5)
    assert V.sample_exact(df.where("k < 0"), "k", 0.5).count() == 0


def fronts(points):
    rank = {}
    for x, v in sorted(set(points), key=lambda p: (-p[0], p[1])):
        rank[(x, v)] = 1 + max((r for (a, b), r in rank.items() if a >= x and b <= v), default=0)
    return rank


@pytest.mark.parametrize("block", [200_000, 37])
def test_fronts_in_one_sort(spark, block):
    rng = random.Random(2)
    points = [(float(rng.randint(0, 15)), float(rng.randint(0, 15))) for _ in range(300)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, up double, down double").repartition(5)
    want = fronts(points)
    got = N.pareto_rank(df, "id", "up", "down", block_rows=block).collect()
    assert len(got) == 300 and all(r["front"] == want[(r["up"], r["down"])] for r in got)
    assert N.pareto_rank(df.where("id < 0"), "id", "up", "down").count() == 0


def test_a_thousand_fronts(spark):
    df = spark.range(1500).select(F.col("id").cast("int").alias("id"), (-F.col("id")).alias("up"), F.col("id").cast("double").alias("down"))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fronts", "fronts")
    got = N.pareto_rank(df, "id", "up", "down", block_rows=400).collect()
    spark.sparkContext.setJobGroup("other", "other")
    assert all(r["front"] == r["id"] + 1 for r in got) and len(jobs.getJobIdsForGroup("fronts")) < 60
    with pytest.raises(ValueError):
        N.pareto_rank(df.withColumn("down", F.lit(float("nan"))), "id", "up", "down")


def test_head_search():
    heads, rng = [], random.Random(1)
    for _ in range(200):
        v = rng.random()
        f = bisect_right(heads, v)
        assert N._front_numbers(np.array([v]), heads)[0] == f + 1 and heads == sorted(heads)


def ward(d, k):
    """The textbook way: merge the closest two of all clusters until k are left."""
    groups, d = [[i] for i in range(len(d))], {(i, j): d[i, j] for i in range(len(d)) for j in range(i + 1, len(d))}
    groups = dict(enumerate(groups))
    while len(groups) > k:
        a, b = min(d, key=lambda p: (d[p], p))
        na, nb, dab = len(groups[a]), len(groups[b]), d[(a, b)]
        new = {c: ((na + len(g)) * d[tuple(sorted((a, c)))] + (nb + len(g)) * d[tuple(sorted((b, c)))] - len(g) * dab) / (na + nb + len(g))
               for c, g in groups.items() if c not in (a, b)}
        groups[a] += groups.pop(b)
        d = {p: v for p, v in d.items() if a not in p and b not in p} | {tuple(sorted((a, c))): v for c, v in new.items()}
    return sorted(sorted(g) for g in groups.values())


def test_agglomerate_against_the_textbook(spark):
    rng = np.random.RandomState(4)
    x = rng.rand(60, 14)
    x[rng.rand(*x.shape) < 0.1] = np.nan
    x[:, 13] = np.nan
    cols = [f"c{i}" for i in range(14)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"{c} double" for c in cols))
    d = K.column_distances(df, cols)
    diff = x[:, :, None] - x[:, None, :]
    assert np.allclose(d, np.nansum(diff ** 2, 0))
    for k in (1, 4, 9):
        groups = ward(np.nansum(diff ** 2, 0), k)
        out = K.agglomerate(df, cols, k).collect()
        for r, row in zip(out, x):
            for g, m in enumerate(groups):
                known = [row[i] for i in m if not np.isnan(row[i])]
                assert r[f"agg{g}"] is None if not known else abs(r[f"agg{g}"] - np.mean(known)) < 1e-9


def test_agglomerate_638_columns(spark):
    p = 638
    df = spark.range(40).select("id", *[F.expr(f"cast(id * {i % 11 + 1} % 17 as double) + {i} * 1e-6").alias(f"c{i}") for i in range(p)])
    merges = K.ward_merges(K.column_distances(df, [f"c{i}" for i in range(p)]))
    heights = [m[0] for m in merges]
    assert len(merges) == p - 1 and heights[p - 12] < 1e-3 < heights[p - 11]  # eleven groups of equal columns


def test_anova_counts_what_is_known(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), (None, 9.0)], "y string, x double")
    r = K.anova_f(df, ["x"], "y").first()
    assert r["f"] is None and (r["df_between"], r["df_within"]) == (1, 0)
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", 4.0), ("b", 6.0)], "y string, x double")
    r = K.anova_f(df, ["x"], "y").first()
    assert abs(r["f"] - 9.8) < 1e-9 and r["df_within"] == 2
    assert K.anova_f(df.where("y = 'a'"), ["x"], "y").first()["f"] is None and K.anova_f(df.where("x > 9"), ["x"], "y").first()["f"] is None
    assert [r["keep"] for r in K.select_fwe(df.withColumn("c", F.lit(1.0)), ["c"], "y").collect()] == [False]


def test_one_hot_of_any_number_of_values(spark):
    df = spark.range(100_000).withColumn("v", F.when(F.col("id") % 10 > 0, F.format_string("v%06d", "id")))
    hot, table = E.one_hot_sparse(df, "v", "hot", vector=True)
    assert table.count() == 90_000
    for r in hot.where("id % 9973 = 0").collect():
        place = r["id"] - r["id"] // 10 - 1
        assert r["hot"].size == 90_000 and list(r["hot"].indices) == ([place] if r["v"] else []) and list(r["hot"].values) == [1.0] * bool(r["v"])
    plain, _ = E.one_hot_sparse(df, "v", "hot")
    assert plain.where("v is not null and hot.values[0] <> 1").count() == 0 and plain.where("v is null and size(hot.indices) > 0").count() == 0
    few = spark.createDataFrame([("other",)] * 5 + [("x",)] * 4 + [("rare",), (None,)], "v string")
    hot, table = E.one_hot_sparse(few, "v", "hot", min_fraction=0.2)
    assert sorted(map(tuple, table.collect())) == [(0, "other", False, 5), (1, "x", False, 4), (2, "other", True, 1)]
    assert Counter(tuple(r["hot"]["indices"]) for r in hot.collect()) == {(0,): 5, (1,): 4, (2,): 1, (): 1}
    pooled = E.get_dummies(few, "v", min_fraction=0.2)
    assert pooled.columns == ["v_other", "v_other_", "v_x"] and pooled.agg(F.sum("v_other"), F.sum("v_other_")).first() == (5, 1)


def test_codes_have_one_type(spark):
    df = spark.range(30).withColumn("v", F.col("id").cast("string"))
    few, many = E.cat_codes(df, "v"), E.cat_codes(df, "v", max_inline=5)
    assert few.dtypes == [(c, t) for c, t in many.select(*few.columns).dtypes] and few.exceptAll(many.select(*few.columns)).count() == 0


def test_maps_as_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "zz")], "id int, k string")
    m = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "key string, value int")
    literal = df.withColumn("v", C.map_values("k", {"a": 10, "b": 20, "c": 30}))
    assert C.map_values_join(df, "k", m, "v").dtypes == literal.dtypes
    assert sorted(map(tuple, C.map_values_join(df, "k", m, "v").collect())) == sorted(map(tuple, literal.collect()))
    assert {r["k"] for r in C.map_values_join(df, "k", m, "k", default=0).collect()} == {10, 20, 0}
    assert C.map_values_join(df.where("id < 4"), "k", m, "v", strict=True).where("v is null").count() == 1
    with pytest.raises(Exception, match="unknown key: zz"):
        C.map_values_join(df, "k", m, "v", strict=True).collect()
    with pytest.raises(ValueError):
        C.map_values_join(df, "k", m.unionByName(m), "v")


def test_bootstrap_against_plain_python(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None, "single"] if i else ["single"]), rng.choice([0.0, 1.0, None])) for i in range(80)]
    rows = [r for r in rows if r[1] != "single"] + [(900, "single", 1.0)]
    b = 21
    want = {}
    for g in {r[1] for r in rows}:
        means = []
        for rep in range(b):
            s = w = 0.0
            for i, k, y in rows:
                if k == g and y is not None:
                    u = int(hashlib.md5(f"5#{i}#{rep // 8}".encode()).hexdigest()[4 * (rep % 8):][:4], 16)
                    n = sum(u >= c for c in S.POISSON_STEPS)
                    s, w = s + n * y, w + n
            if w:
                means.append(s / w)
        want[g] = (np.quantile(means, 0.025), np.quantile(means, 0.975))
    df = spark.createDataFrame(rows, "id int, g string, y double").repartition(3)
    got = {r["g"]: (r["lo"], r["hi"]) for r in S.rate_ci_bootstrap(df, "g", "y", "id", b=b, seed=5).collect()}
    assert set(got) == set(want) and all(np.allclose(got[g], want[g]) for g in want)
    plan = S.rate_ci_bootstrap(df, "g", "y", "id", b=b)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("MapInArrow")  # rows are only unpacked behind the tasks' sums


def test_bins_by_rule(spark):
    rng = np.random.RandomState(2)
    for x in (rng.normal(size=500), np.r_[np.zeros(300), rng.rand(50)], np.ones(5), np.arange(3.0)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        for rule in ("auto", "fd", "sturges"):
            if np.subtract(*np.percentile(x, [75, 25])) == 0:  # newer libraries widen such bins in another way
                assert S.auto_bins(df, "x", rule) == len(np.histogram_bin_edges(x, "sturges")) - 1
                continue
            assert S.auto_bins(df, "x", rule) == len(np.histogram_bin_edges(x, rule)) - 1, (rule, len(x))
    assert S.auto_bins(df.where("x > 99"), "x") == 0 and S.histogram(df.where("x > 99"), "x", "auto").count() == 0


def test_search_goes_on_past_what_cannot_be_fitted(spark):
    from pyspark.ml import feature as MF
    from pyspark.ml.classification import NaiveBayes

    from tabforge.operators import models as L
    from tabforge.operators import search as R
    df = spark.range(60).select("id", (F.col("id") % 2 - 0.5).alias("x"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 3).cast("int").alias("fold"))
    space = R.Space([R.Step("maxabs", R._same(MF.MaxAbsScaler))], [R.Step("counts", R._same(lambda: NaiveBayes())),  # refuses negative values
                    R.Step("tree", R._same(lambda **p: L.tree(**p)), {"maxDepth": R.Whole(1, 2)})], 1)
    table, best, chosen = R.search(df, space, ["x"], "label", "fold", n=6, seed=3)
    rows = table.collect()
    assert {r["failure"] is None for r in rows} == {True, False} and all((r["mean"] is None) == (r["failure"] is not None) for r in rows)
    assert "tree" in str(chosen) and best.transform(L.with_label(df, "label")).where("prediction <> label").count() == 0
    assert len({str(c) for c in R.draw(R.default_space(), 40, 1)}) == 40 and [*map(str, R.draw(space, 6, 3))] == [r["pipeline"] for r in rows]


def test_default_space_fits(spark):
    """Each kind of step works on plain data, alone with a tree or, for models, on the raw features."""
    from tabforge.operators import models as L
    from tabforge.operators import search as R
    df = L.with_label(spark.range(80).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 2).alias("y")), "y")
    space, rng = R.default_space(), random.Random(0)
    given = lambda s: (s, {k: kind.draw(rng) for k, kind in s.params.items()})
    for t in space.transformers:
        R.Candidate((given(t), (space.models[1], {"maxDepth": 2}))).pipeline(["a", "b"]).fit(df)
    R.Candidate((given(space.models[0]),)).pipeline(["a", "b"]).fit(df)


def test_models_of_unusual_labels(spark):
    from tabforge.operators import models as L
    df = spark.createDataFrame([(i, float(i % 3), "xyz"[i % 3]) for i in range(60)], "k int, a double, y string")
    m = L.adaboost(df, ["a"], "y", "k", depth=1, rounds=8)
    assert L.adaboost_predict(m, df, ["a"], "k").join(df, "k").where("prediction <> y").count() == 0
    one = L.adaboost(df.withColumn("y", F.lit("x")), ["a"], "y", "k", depth=1, rounds=3)
    assert L.adaboost_predict(one, df, ["a"], "k").select("prediction").distinct().collect() == [("x",)]
    probs = spark.createDataFrame([(1, "m", 0.9), (1, "n", 0.2)], "key int, model string, p double")
    with pytest.raises(ValueError):
        L.soft_vote(probs, spark.createDataFrame([("m", 0.8)], "model string, score double"))


def test_groups_without_spread(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("b", 1.0), ("c", 1.0), ("c", 3.0)], "g string, x double")
    got = defaultdict(list)
    for r in C.standardize(df, ["x"], by="g").collect():
        got[r["g"]].append(r["x"])
    assert got["a"] == [None, None] and got["b"] == [None] and sorted(got["c"]) == pytest.approx([-0.5 ** 0.5, 0.5 ** 0.5])
    assert {r["density"] for r in S.kde(df, "x", points=4, by="g").collect() if r["g"] in "ab"} == {None}
    assert S.kde(df.where("x > 9"), "x").count() == 0
    assert V.auc(df.withColumn("y", F.lit(1)), "y", "x").first()["auc"] is None
