"""Correlation matrix from one pass of cross products, against pandas."""

import numpy as np
import pandas as pd
import pytest

from tabforge.operators.features import drop_collinear
from tabforge.operators.summarize import corr_matrix


def spark_frame(spark, pdf):
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in pdf.to_numpy()]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns))


@pytest.mark.parametrize("share", [0.0, 0.2])
def test_pairwise_complete(spark, share):
    rng = np.random.RandomState(1)
    x = rng.normal(1e6, 1, (150, 12))
    x[:, 3] = 5 - 2 * x[:, 0]
    x[:, 4] = x[:, 1] + rng.normal(0, 0.3, 150)
    x[:, 5] = 0.1  # constant
    x[:, :10][rng.rand(150, 10) < share] = np.nan
    x[:, 6] = np.nan  # never known
    x[2:, 7] = np.nan  # known twice
    x[2:, 8] = np.where(np.isnan(x[2:, 8]), np.nan, 3.0)
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(12)])
    want = pdf.corr(min_periods=2)
    got = {(r["a"], r["b"]): r["r"] for r in corr_matrix(spark_frame(spark, pdf), list(pdf.columns)).collect()}
    assert len(got) == 12 * 11 // 2
    for (a, b), r in got.items():
        both = pdf[[a, b]].dropna()
        if len(both) < 2 or both[a].nunique() < 2 or both[b].nunique() < 2:
            assert r is None, (a, b, r)
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-7), (a, b)


def test_empty_table_and_wide_table(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert [tuple(r) for r in corr_matrix(empty, ["a", "b"]).collect()] == [("a", "b", None, None)]
    rng = np.random.RandomState(2)
    x = rng.normal(size=(60, 120))
    x[:, 100] = -x[:, 7]
    wide = spark_frame(spark, pd.DataFrame(x, columns=[f"c{i}" for i in range(120)]))
    assert drop_collinear(wide, wide.columns, 0.95)[1] == ["c100"]
