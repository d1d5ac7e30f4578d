"""Literal fixtures (FIXTURES.md §2): expected values follow the reference rules."""

import math

import pytest
from pyspark.sql import functions as F

from tabforge.functions import columns as C
from tabforge.operators import encode as E


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {typ}")


def ordered(df, col):
    return [r[col] for r in df.orderBy("i").collect()]


def test_title(spark):
    names = ["Kelly, Mr. James", "Wilkes, Mrs. James (Ellen Needs)", "Oliva y Ocana, Dona. Fermina",
             "Douglas, Mrs. Walter Donald (Mahala Dutton)", "Nobody"]
    df = one_col(spark, names)
    got = df.select("i", C.title("x").alias("t"), C.title("x", with_dona=False).alias("t0"),
                    C.title_group(C.title("x")).alias("g"))
    assert ordered(got, "t") == ["Mr.", "Mrs.", "Dona.", "Mrs.", None]
    assert ordered(got, "t0") == ["Mr.", "Mrs.", None, "Mrs.", None]
    assert ordered(got, "g") == ["Mr", "Mrs", "FemaleRarePos", "Mrs", "nan"]


def test_ticket(spark):
    df = one_col(spark, ["330911", "LINE", "A/5. 3337", "STON/O 2. 3101291", "S.O./P.P. 752", "SC/A.3 2861", "A/5 X"])
    p = C.parse_ticket("x")
    got = df.select("i", p["header"].alias("h"), p["number"].alias("n"))
    assert ordered(got, "h") == [None, "LINE", "A5", "STONO2", "SOPP", "SCA3", None]
    assert ordered(got, "n") == [330911, 0, 3337, 3101291, 752, 2861, None]


def test_cabin(spark):
    df = one_col(spark, [None, "D", "E46", "F E46", "F G63", "B57 B59 B63 B66"])
    p = C.parse_cabin("x")
    got = df.select("i", C.deck_label("x").alias("deck"), p["rooms"].alias("rooms"), C.room_count("x").alias("n"))
    assert ordered(got, "deck") == ["N/A", "D", "E", "EF", "FG", "B"]
    assert ordered(got, "rooms") == [None, None, [46], [46], [63], [57, 59, 63, 66]]
    assert ordered(got, "n") == [None, None, 1, 1, 1, 4]


def test_cabin_simple(spark):
    df = one_col(spark, ["c85", "B57 B59", "E46", None])
    p = C.parse_cabin_simple("x")
    got = df.select("i", p["letter"].alias("l"), p["number"].alias("n"))
    assert ordered(got, "l") == ["C", None, "E", None]
    assert ordered(got, "n") == [85, None, 46, None]


def test_cut_right_closed(spark):
    df = one_col(spark, [1.0, 2.0, 2.0, 3.0, None, 10.0], "double")
    got = df.select("i", E.cut_expr("x", [1, 2, 3, 10]).alias("b"))
    assert ordered(got, "b") == [None, "1-2", "1-2", "2-3", None, "3-10"]


def test_floor_and_width_bins(spark):
    df = one_col(spark, [0.17, 4.9, 5.0, 34.5], "double")
    assert ordered(df.select("i", E.floor_bin("x", 5).alias("b")), "b") == [0, 0, 1, 6]
    df2 = one_col(spark, [2.1102], "double")
    assert ordered(df2.select("i", E.width_bin("x", 0.25, 1).alias("b")), "b") == [9]


def test_cat_codes(spark):
    df = one_col(spark, ["b", "a", None, "b"])
    assert ordered(E.cat_codes(df, "x", name="c"), "c") == [1, 0, -1, 1]


def test_cat_codes_large_domain_path(spark):
    df = one_col(spark, ["b", "a", None, "b", "c"])
    assert ordered(E.cat_codes(df, "x", name="c", max_inline=1), "c") == [1, 0, -1, 1, 2]


def test_map_strict_raises(spark):
    df = one_col(spark, ["C", "Q", "X"])
    with pytest.raises(Exception):
        df.select(C.map_values("x", C.EMBARKED_CODES, strict=True)).collect()
    got = one_col(spark, ["C", "Q", "S"]).select("i", C.map_values("x", C.EMBARKED_CODES, strict=True).alias("c"))
    assert ordered(got, "c") == [0, 1, 2]


def test_family_flags(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 1, 2), (3, 4, 1)], "i int, sibsp int, parch int")
    fam = C.sum_plus(["sibsp", "parch"], 1)
    got = df.select("i", *[v.alias(k) for k, v in C.range_flags(fam, C.FAMILY_FLAGS).items()])
    rows = [tuple(r)[1:] for r in got.orderBy("i").collect()]
    assert rows == [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)]


def test_protected_division_and_correct_count(spark):
    from tabforge.functions.symbolic import to_column
    df = spark.createDataFrame([(4.0, 2.0), (4.0, 0.0)], "l double, r double")
    got = [r[0] for r in df.select(to_column(("pdiv", ("var", "l"), ("var", "r")))).collect()]
    assert got == [2.0, 1.0]
    from tabforge.operators.validate import correct_count
    d = spark.createDataFrame([(1, 0.0)], "y int, s double")
    assert d.agg(correct_count(d, "y", "s")).first()[0] == 1  # 1e-15 + 0.5 > 0.5 → predicted 1


def test_sample_skew_kurtosis(spark):
    from tabforge.operators.features import sample_kurtosis, sample_skew
    df = spark.createDataFrame([(float(v),) if v is not None else (None,) for v in [1, 2, 2, 3, None, 10]], "x double")
    sk, ku = df.agg(sample_skew(F.col("x")), sample_kurtosis(F.col("x"))).first()
    assert abs(sk - 2.028699) < 1e-5 and abs(ku - 4.272147) < 1e-5
    flat = spark.createDataFrame([(0.1,)] * 3 + [(None,)], "x double")
    assert flat.agg(sample_skew(F.col("x"))).first()[0] == 0 and flat.limit(2).agg(sample_skew(F.col("x"))).first()[0] is None


def test_ewm_fixture(spark):
    from tabforge.operators.sequence import ewm
    df = spark.createDataFrame([("r", 1, 1.0), ("r", 2, 2.0), ("r", 3, 2.0)], "run string, step int, loss double")
    got = [r["smooth"] for r in ewm(df, "run", ["step"], "loss", f=0.05).orderBy("t").collect()]
    assert [round(x, 6) for x in got] == [1.0, 1.05, 1.0975]


def test_voting_weight(spark):
    from tabforge.operators.models import soft_vote
    probs = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.0)], "key int, model string, p double")
    scores = spark.createDataFrame([("a", 0.80), ("b", 0.81)], "model string, score double")
    p = soft_vote(probs, scores, power=100).first()["p"]
    w_b = 1.01 ** 100
    assert abs(w_b - 2.704814) < 1e-6
    assert abs(p - 1.0 / (1.0 + w_b)) < 1e-9


def test_describe_goldens_shape(spark):
    from tabforge.operators.profile import describe
    vals = [0.17, 4.9, 5.0, 34.5, 21.0, 27.0, 39.0, 76.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = describe(df, ["x"]).first()
    import statistics
    assert r["count"] == len(vals) and abs(r["mean"] - statistics.mean(vals)) < 1e-9
    assert abs(r["std"] - statistics.stdev(vals)) < 1e-9
    s = sorted(vals)
    def q(p):
        pos = p * (len(s) - 1)
        lo = math.floor(pos)
        return s[lo] + (pos - lo) * (s[min(lo + 1, len(s) - 1)] - s[lo])
    assert abs(r["q25"] - q(0.25)) < 1e-9 and abs(r["q50"] - q(0.5)) < 1e-9 and abs(r["q75"] - q(0.75)) < 1e-9
