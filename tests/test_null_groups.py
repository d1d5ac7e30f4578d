"""Rows whose group key is NULL form a group of their own; fixed ties and shares."""

import pytest
from pyspark.sql import functions as F

from tabforge.operators import models as L
from tabforge.operators import sequence as H
from tabforge.operators import summarize as G
from tabforge.operators import validate as V
from tabforge.plans.ranking import null_safe_join
from tabforge.session import ensure_checkpoint_dir


def frame(spark):
    return spark.createDataFrame([(i, None if i % 3 == 0 else i % 3, float(i % 5)) for i in range(12)], "k long, g int, x double")


def test_null_group_is_kept(spark):
    d = frame(spark)
    assert H.series_position(d, "g", ["k"], name="t").count() == 12
    assert H.trim(d, "g", ["k"], 0, 0).count() == 12
    assert V.stratified_folds(d, "g", "k", k=2).count() == 12
    assert H.ewm(d, "g", ["k"], "x").where(F.col("smooth").isNull()).count() == 0
    assert H.diverge_cut(d.withColumn("x", F.lit(1.0)), "g", ["k"], "x").count() == 12
    assert G.kde(d, "x", points=3, by="g").select("g").distinct().count() == 3


def test_null_safe_join_meets_null(spark):
    a = spark.createDataFrame([(1, None), (2, 5)], "k int, g int")
    b = spark.createDataFrame([(None, "n"), (5, "five")], "g int, v string")
    assert {(r["k"], r["g"], r["v"]) for r in null_safe_join(a, b, ["g"]).collect()} == {(1, None, "n"), (2, 5, "five")}


def test_soft_vote_tie_is_class_zero(spark):
    probs = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.6)], "key int, model string, p double")
    scores = spark.createDataFrame([("a", 0.9)], "model string, score double")
    assert {r["key"]: r["prediction"] for r in L.soft_vote(probs, scores).collect()} == {1: 0, 2: 1}


def test_unknown_selection_model(spark):
    from tabforge.operators import features as FT
    with pytest.raises(ValueError):
        FT.select_from_model(frame(spark).withColumn("y", F.lit(1)), ["x"], "y", "no such model")


def test_checkpoint_folder_needs_sharing():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
