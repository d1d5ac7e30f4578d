"""k-NN at many features and with NULLs, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators.impute import knn_impute
from tabforge.operators.neighbors import knn


def frames(spark, d, q):
    cols = [f"f{i}" for i in range(d.shape[1])]

    def rows(m):
        return [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(m)]
    schema = ", ".join(f"{c} double" for c in cols)
    donors = spark.createDataFrame(rows(d), f"dk long, {schema}").withColumn("y", F.col("dk") % 7)
    return donors, spark.createDataFrame(rows(q), f"qk long, {schema}"), cols


def brute(d, x, metric, k):
    diff = d - x
    shared = (~np.isnan(diff)).sum(1)
    term = np.abs(diff) if metric == "manhattan" else diff ** 2
    total = np.nansum(term, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        dist = total / shared if metric == "mean_sq" else total * (d.shape[1] / shared)
    dist = np.sqrt(dist) if metric == "euclidean" else dist
    return sorted(np.flatnonzero(shared).tolist(), key=lambda j: (dist[j], j))[:k]


def neighbours(spark, d, q, metric, k, **more):
    donors, queries, cols = frames(spark, d, q)
    got = {}
    for r in knn(queries, donors, cols, k, "qk", "dk", "y", metric=metric, **more).collect():
        assert r["y"] == r["dk"] % 7
        got.setdefault(r["qk"], []).append((r["rank"], r["dk"]))
    return [[j for _, j in sorted(got.get(i, []))] for i in range(len(q))]


@pytest.mark.parametrize("metric,leaf", [("mean_sq", 4096), ("mean_sq", 30), ("euclidean", 40), ("manhattan", 40)])
def test_many_features_with_nulls(spark, metric, leaf):
    rng = np.random.RandomState(3)
    d, q = rng.randint(0, 5, (250, 22)).astype(float), rng.randint(0, 5, (12, 22)).astype(float)
    d[rng.rand(*d.shape) < 0.1] = np.nan
    d[40:80] = d[40]  # a group of copies
    q[rng.rand(*q.shape) < 0.2] = np.nan
    d[7], q[11] = np.nan, np.nan  # nothing shared with anyone
    want = [brute(d, x, metric, 9) for x in q]
    assert neighbours(spark, d, q, metric, 9, leaf_rows=leaf, block_rows=3) == want
    assert want[11] == []


def test_far_tail_and_few_donors(spark):
    d = np.append(np.linspace(0, 1, 400), 1000.0)[:, None]
    q = np.array([[1.5], [999.0], [-50.0]])
    assert neighbours(spark, d, q, "euclidean", 3, leaf_rows=50, block_rows=2) == [brute(d, x, "euclidean", 3) for x in q]
    assert neighbours(spark, d[:2], q, "euclidean", 3) == [brute(d[:2], x, "euclidean", 3) for x in q]
    assert neighbours(spark, d[:0], q, "euclidean", 3) == [[], [], []]


def test_few_valued_features_and_offsets(spark):
    """Ties everywhere, cells that differ in one feature or only in what is missing, and values far from zero."""
    rng = np.random.RandomState(5)
    d = rng.randint(0, 2, (600, 6)).astype(float)
    d[rng.rand(*d.shape) < 0.3] = np.nan
    q = rng.randint(0, 2, (9, 6)).astype(float)
    assert neighbours(spark, d, q, "mean_sq", 20, leaf_rows=20, block_rows=4) == [brute(d, x, "mean_sq", 20) for x in q]
    d, q = 1e6 + rng.rand(500, 3), 1e6 + rng.rand(8, 3)
    for metric in ("euclidean", "manhattan"):
        assert neighbours(spark, d, q, metric, 4, leaf_rows=16, block_rows=3) == [brute(d, x, metric, 4) for x in q]


def test_cells_far_away_are_not_read(spark, monkeypatch):
    """On clustered data a block reaches a few cells, however many there are."""
    from tabforge.operators import neighbors as N
    pairs = {}
    reach = N._reach
    monkeypatch.setattr(N, "_reach", lambda *a: pairs.setdefault(len(pairs), reach(*a)))
    rng = np.random.RandomState(1)
    for n in (400, 1600):
        d = (rng.randint(0, 100, (n, 1)) * 1000.0) + rng.rand(n, 3)
        q = d[rng.choice(n, 10)] + 0.01
        assert neighbours(spark, d, q, "euclidean", 3, leaf_rows=25, block_rows=1) == [brute(d, x, "euclidean", 3) for x in q]
    assert all(p.count() <= 10 * 4 for p in pairs.values()) and len(pairs) == 2


def test_impute_row_with_null_features(spark):
    df = spark.createDataFrame([(1, 1.0, None, 10.0), (2, 2.0, 5.0, 20.0), (3, None, 5.0, None), (4, None, None, None)],
                               "k long, a double, b double, y double")
    got = {r["k"]: r["y"] for r in knn_impute(df, "k", "y", ["a", "b"], k=1).collect()}
    assert got == {1: 10.0, 2: 20.0, 3: 20.0, 4: None}


def test_copies_bound_the_search_by_rows():
    """Vectors behind k nearer rows are left out; those at the same distance as the k-th row stay."""
    import pyarrow as pa

    from tabforge.operators.neighbors import _nearest
    left = pa.table({"vid": [0, 1], "x": [[0.0], [10.0]], "g": [0, 0], "kth": pa.array([None, None], pa.float64())})
    right = pa.table({"idx": [1, 2, 3, 4], "x": [[1.0], [-1.0], [2.0], [10.0]], "g": [1] * 4, "m": [2, 3, 1, 1]})
    got = _nearest((pa.scalar(5),), left, right, 3, 1, "euclidean", False).to_pylist()
    assert [(r["vid"], r["idx"], r["m"]) for r in got] == [(0, 1, 2), (0, 2, 3), (1, 4, 1), (1, 3, 1), (1, 1, 2)]


def test_imputation_joins_its_input_once(spark, monkeypatch):
    from tabforge.operators import impute as I
    seen, search = [], I.knn

    def spied(queries, donors, *more, **named):
        seen.extend(d._jdf.queryExecution().optimizedPlan().toString() for d in (queries, donors))
        return search(queries, donors, *more, **named)
    monkeypatch.setattr(I, "knn", spied)
    a = spark.createDataFrame([(i, float(i // 4)) for i in range(24)], "k long, a double")
    b = spark.createDataFrame([(i, float(i * 7 % 5) if i % 6 else None) for i in range(24)], "k long, y double")
    got = {r["k"]: r["y"] for r in knn_impute(a.join(b, "k"), "k", "y", ["a"], k=4).collect()}
    assert len(seen) == 2 and not any("Join" in p for p in seen)
    for k in range(0, 24, 6):
        near = sorted((d for d in range(24) if d % 6), key=lambda d: ((d // 4 - k // 4) ** 2, d))[:4]
        w = [1.0 / max((d // 4 - k // 4) ** 2, 1e-6) for d in near]
        assert abs(got[k] - sum(x * (d * 7 % 5) for x, d in zip(w, near)) / sum(w)) < 1e-9


def test_a_query_reaches_what_its_own_bound_names(spark, monkeypatch):
    """Queries far apart in one block reach no more cells than each alone."""
    from tabforge.operators import neighbors as N
    pairs = []
    reach = N._reach

    def spied(*a):
        pairs.append(reach(*a))
        return pairs[-1]
    monkeypatch.setattr(N, "_reach", spied)
    rng = np.random.RandomState(1)
    d = (rng.randint(0, 100, (1600, 1)) * 1000.0) + rng.rand(1600, 3)
    q = d[rng.choice(1600, 10)] + 0.01
    assert neighbours(spark, d, q, "euclidean", 3, leaf_rows=25, block_rows=10) == [brute(d, x, "euclidean", 3) for x in q]
    assert len(pairs) == 1 and pairs[0].count() <= 10 * 4


def test_queries_of_few_features_search_a_tree_of_those(spark, monkeypatch):
    """Vectors without most features are near everyone, and queries without them are near vectors of all cells."""
    from tabforge.operators import neighbors as N
    trees = []
    grow = N._grow
    monkeypatch.setattr(N, "_grow", lambda v, dims, *a: trees.append(dims) or grow(v, dims, *a))
    rng = np.random.RandomState(7)
    d, q = rng.rand(400, 6), rng.rand(24, 6)
    d[::15, 2:], q[::2, 2:] = np.nan, np.nan
    q[0, :2] = np.nan
    assert neighbours(spark, d, q, "mean_sq", 5, leaf_rows=30, block_rows=1000) == [brute(d, x, "mean_sq", 5) for x in q]
    assert trees == [6, 2]
    for metric in ("euclidean", "manhattan"):
        assert neighbours(spark, d, q, metric, 5, leaf_rows=30, block_rows=1000) == [brute(d, x, metric, 5) for x in q]
    assert trees == [6, 2, 6, 6]


@pytest.mark.parametrize("metric", ["mean_sq", "euclidean", "manhattan"])
def test_a_query_meets_the_parts_of_a_cell_that_its_bound_names(monkeypatch, metric):
    import pyarrow as pa

    from tabforge.operators import neighbors as N
    met, rough = [], N._rough
    monkeypatch.setattr(N, "_rough", lambda x, y, m: met.append(len(x) * len(y)) or rough(x, y, m))
    rng = np.random.RandomState(2)
    d = rng.randint(0, 30, (3000, 1)) * 50.0 + rng.rand(3000, 5)
    d[rng.rand(*d.shape) < 0.01] = np.nan
    q = np.nan_to_num(d[rng.choice(3000, 60)]) + 0.1
    left = pa.table({"vid": np.arange(60), "x": [[float(v) for v in r] for r in q], "g": np.zeros(60, np.int64), "kth": pa.array([None] * 60, pa.float64())})
    right = pa.table({"idx": np.arange(3000), "x": [[None if np.isnan(v) else float(v) for v in r] for r in d], "g": np.ones(3000, np.int64), "m": np.ones(3000, np.int64)})
    got = {}
    for r in N._nearest((pa.scalar(5),), left, right, 10, 5, metric, False).to_pylist():
        got.setdefault(r["vid"], []).append(r["idx"])
    assert [got[i] for i in range(60)] == [brute(d, x, metric, 10) for x in q]
    assert sum(met) * 2 < 60 * 3000
