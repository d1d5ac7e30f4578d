"""Series operators against a plain loop: repeated rows, NULL values and series, rows with further columns."""

import random

import pytest
from pyspark.sql import functions as F

from tabforge.operators import sequence as H


def rows(seed, n=240):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        row = (rng.choice(["a", "b", None]), rng.randint(0, 60), float(rng.randint(1, 40)), "wide" * 3)
        out += [row] * rng.choice([1, 1, 1, 4])  # exact copies too
    return out


def by_series(data):
    out = {}
    for g, k, x, _ in sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        out.setdefault(g, []).append((k, x))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return rows(5), spark.createDataFrame(rows(5), "g string, k int, x double, more string")


def got(df, *cols):
    return sorted(((r["g"] or "", r["t"], *[r[c] for c in cols]) for r in df.collect()))


def test_positions(table):
    data, df = table
    want = sorted((g or "", i + 1, k) for g, s in by_series(data).items() for i, (k, _) in enumerate(s))
    assert got(H.series_position(df, "g", ["k"]), "k") == want


@pytest.mark.parametrize("f", [0.05, 0.6])  # 0.6: blocks of 44 rows
def test_smoothing(table, f):
    data, df = table
    out = got(H.ewm(df, "g", ["k"], "x", f=f), "k", "smooth", "more")
    want = []
    for g, s in by_series(data).items():
        y = None
        for i, (k, x) in enumerate(s):
            y = x if y is None else f * x + (1 - f) * y
            want.append((g or "", i + 1, k, y))
    assert [r[:3] for r in out] == [r[:3] for r in sorted(want)]
    assert [r[3] for r in out] == pytest.approx([r[3] for r in sorted(want)])
    assert {r[4] for r in out} == {"wide" * 3}


def test_divergence_cut(table):
    data, df = table
    want = []
    for g, s in by_series(data).items():
        best = float("inf")
        for i, (k, x) in enumerate(s):
            best = min(best, x)
            want.append((g or "", i + 1, x, best))
            if x > 5 * best:
                break
    assert got(H.diverge_cut(df, "g", ["k"], "x"), "x", "best") == sorted(want)


def test_trim(table):
    data, df = table
    want = sorted((g or "", i + 1, k) for g, s in by_series(data).items() for i, (k, _) in enumerate(s) if 10 <= i < len(s) - 5)
    assert got(H.trim(df, "g", ["k"], 10, 5), "k") == want
    assert H.trim(df, "g", ["k"], 10 ** 6, 0).count() == 0


def test_empty_table(table):
    _, df = table
    none = df.where("k < 0")
    assert [H.ewm(none, "g", ["k"], "x").count(), H.diverge_cut(none, "g", ["k"], "x").count(), H.trim(none, "g", ["k"]).count()] == [0, 0, 0]


def test_only_keys_are_checkpointed(table):
    _, df = table
    keyed, numbered = H._numbered(df, "g", ["k"], "x")
    assert numbered.columns == ["g", "x", "_k", "_t"] and "more" in keyed.columns
    names = set(df.columns) | {"t", "smooth"}
    assert set(H.ewm(df.withColumn("u", F.lit(1)), "g", ["k"], "x").columns) == names | {"u"}
