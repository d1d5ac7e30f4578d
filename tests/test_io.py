from pyspark.sql import functions as F

from tabforge.sources import io as A


def test_read_tables_skips_missing_and_roles(spark, tmp_path):
    d = str(tmp_path)
    df = spark.createDataFrame([(1, 0.5, 1), (2, 1.5, 0)], "k long, x double, y int")
    A.write_csv(df, f"{d}/train.csv")
    tabs = A.read_tables(spark, d, ["train", "test"], schemas={"train": "k long, x double, y int"})
    assert list(tabs) == ["train"] and tabs["train"].count() == 2
    A.save_features(df, f"{d}/feat", "k", ["x"], label="y")
    back, roles = A.load_features(spark, f"{d}/feat")
    assert roles == {"key": ["k"], "label": ["y"], "feature": ["x"]}
    assert back.agg(F.sum("x")).first()[0] == 2.0


def test_read_dir_skips_subfolders(spark, tmp_path):
    d = str(tmp_path)
    df = spark.createDataFrame([(1,)], "a int")
    A.write_csv(df, f"{d}/one.csv")
    A.write_csv(df, f"{d}/sub/two.csv")
    assert sorted(A.read_dir(spark, d)) == ["one"]
