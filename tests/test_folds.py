"""Folds that share their work against one fit per fold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabforge.operators import folds as X
from tabforge.operators import models as L
from tabforge.operators import newton as N


def table(spark):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        y = rng.choice("ab") if i % 5 else "c"
        a, b = float(rng.randint(0, 6) + 2 * (y == "a")), float(rng.randint(0, 4) + 3 * (y == "c"))
        rows.append((i, y, i % 4, a, b))
    rows += [(900, None, 0, 1.0, 1.0), (901, "a", None, 1.0, 1.0), (902, "rare", 2, 9.0, 0.0)]  # its fold's models never saw "rare"
    return spark.createDataFrame(rows, "k int, y string, fold int, a double, b double").repartition(3)


def by_fit(df, predict):
    """{fold: accuracy} with one model per fold, fitted on the other folds."""
    out, known = {}, df.dropna(subset=["y", "fold"])
    for f in range(4):
        test = known.where(F.col("fold") == f)
        rows = predict(known.where(F.col("fold") != f), test).join(test, "k").select((F.col("prediction") == F.col("y")).alias("hit")).collect()
        out[f] = sum(bool(r["hit"]) for r in rows) / test.count()
    return out


def got(scores):
    out = {}
    for r in scores.collect():
        out.setdefault(r["params"], {})[r["fold"]] = r["score"]
    return out


def test_naive_bayes_folds(spark):
    df = table(spark)
    for kind, one in (("bernoulli", lambda tr, te, v: L.bernoulli_nb(tr, te, ["a", "b"], "y", "k", alpha=v, binarize=2.0)),
                      ("multinomial", lambda tr, te, v: L.multinomial_nb(tr, te, ["a", "b"], "y", "k", alpha=v))):
        scores = got(X.naive_bayes_folds(df, ["a", "b"], "y", "fold", kind, [0.5, 40.0], binarize=2.0))
        for v in (0.5, 40.0):
            assert scores[f"alpha={v}"] == pytest.approx(by_fit(df, lambda tr, te: one(tr, te, v)))  # noqa: B023
    with pytest.raises(ValueError):
        X.naive_bayes_folds(df, ["a"], "y", "fold", "bernoulli", [0.0])


def test_lda_folds(spark):
    df = table(spark).where("y is null or y <> 'rare'").withColumn("a", F.col("a") + 1e6)  # far from 0: sums are about the centre
    want = by_fit(df, lambda tr, te: L.lda_predict(L.lda_fit(tr, ["a", "b"], "y"), te, "k"))
    assert got(X.lda_folds(df, ["a", "b"], "y", "fold"))[""] == pytest.approx(want)


def test_knn_grid(spark):
    df = table(spark)
    x = df.dropna(subset=["y", "fold"]).orderBy("k").toPandas()
    scores = got(X.knn_grid(df, ["a", "b"], "y", "k", "fold", [1, 7], p=1))
    for k in (1, 7):
        for w in ("uniform", "distance"):
            for f in range(4):
                test, train, hits = x[x.fold == f], x[x.fold != f], 0
                for _, q in test.iterrows():
                    d = abs(train.a - q.a) + abs(train.b - q.b)
                    near = sorted(zip(d, train.k, train.y))[:k]
                    exact, votes = any(v[0] == 0 for v in near), {}
                    for dist, _, y in near:
                        votes[y] = votes.get(y, 0) + (1 if w == "uniform" else float(dist == 0) if exact else 1 / dist)
                    best = max(votes.values())
                    hits += min(y for y, v in votes.items() if abs(v - best) < 1e-12) == q.y
                # equal sums of weights may differ in their last bit between the two
                assert scores[f"k={k}, weights={w}"][f] == pytest.approx(hits / len(test), abs=0 if w == "uniform" else 0.03)


def test_no_rows_and_one_class(spark):
    df = table(spark)
    none = df.where("k < 0")
    assert X.naive_bayes_folds(none, ["a"], "y", "fold", "bernoulli", [1.0]).count() == 0
    assert X.lda_folds(none, ["a"], "y", "fold").count() == 0 and X.knn_grid(none, ["a"], "y", "k", "fold", [2]).count() == 0
    one = df.where("y = 'a'")
    assert set(got(X.naive_bayes_folds(one, ["a", "b"], "y", "fold", "multinomial", [1.0]))["alpha=1.0"].values()) == {1.0}
    assert set(got(X.lda_folds(one, ["a", "b"], "y", "fold"))[""].values()) == {1.0}


def slope(rows, w, b, kind, c, positive):
    """Gradient of |w|^2 / 2 + C * losses by weights and intercept, row by row."""
    g = [*w, 0.0]
    for x, y in rows:
        s = 1 if y == positive else -1
        m = s * (sum(a * v for a, v in zip(w, x)) + b)
        d = {"logistic": -s / (1 + math.exp(m)), "squared_hinge": -2 * s * max(0.0, 1 - m), "squared": -2 * s * (1 - m)}[kind]
        g = [v + c * d * t for v, t in zip(g, [*x, 1.0])]
    return g


@pytest.mark.parametrize("kind", ["logistic", "squared_hinge", "squared"])
def test_linear_models_are_least(spark, kind):
    df = table(spark).where("y is null or y <> 'rare'").withColumn("flat", F.lit(7.0))
    data, models = N.linear_models(df, ["a", "b", "flat"], "y", "fold", kind, [0.01, 5.0])
    rows = [(r["_f"], r["_x"], r["_y"]) for r in data.collect()]
    assert len(models) == 4 * 2 * 3  # folds, penalties, classes against the rest
    for params, f, k, w, b in models:
        g = slope([(x, y) for h, x, y in rows if h != f], w, b, kind, float(params[2:]), k)
        assert max(map(abs, g)) < 1e-4 and w[2] == 0
    scores = got(N.linear_folds(df, ["a", "b", "flat"], "y", "fold", kind, [0.01, 5.0]))
    for params, by_fold in scores.items():
        for f, score in by_fold.items():
            of = {k: (w, b) for p, h, k, w, b in models if (p, h) == (params, f)}
            hits = [max(sorted(of), key=lambda k: sum(a * v for a, v in zip(of[k][0], x)) + of[k][1]) == y for h, x, y in rows if h == f]  # noqa: B023
            assert score == pytest.approx(sum(hits) / len(hits))


def test_linear_models_of_two_one_and_no_classes(spark):
    df = table(spark).where("y in ('a', 'b')")
    data, models = N.linear_models(df, ["a", "b"], "y", "fold", "logistic", [1.0])
    for _, f, k, w, b in models:
        if k == "a":
            assert not any(w) and b == 0
        else:
            assert max(map(abs, slope([(r["_x"], r["_y"]) for r in data.collect() if r["_f"] != f], w, b, "logistic", 1.0, "b"))) < 1e-5
    assert set(got(N.linear_folds(df.where("y = 'a'"), ["a"], "y", "fold", "logistic", [1.0]))["C=1.0"].values()) == {1.0}
    assert N.linear_folds(df.where("k < 0"), ["a"], "y", "fold", "logistic", [1.0]).count() == 0
    with pytest.raises(ValueError):
        N.linear_folds(df, ["a"], "y", "fold", "logistic", [0.0])


def test_separated_rows_settle(spark):
    df = spark.createDataFrame([(i % 3, float(i), int(i > 50)) for i in range(100)], "fold int, a double, y int")
    for kind in ("logistic", "squared_hinge"):
        assert min(got(N.linear_folds(df, ["a"], "y", "fold", kind, [1000.0]))["C=1000.0"].values()) > 0.95
