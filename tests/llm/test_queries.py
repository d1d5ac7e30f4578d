"""The registered queries against their DuckDB SQL, and the pipeline's stages against what each must keep."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tabforge.llm.queries import ORACLES, QUERIES
from test_operators import brute_phrases, brute_suffix, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_one_row_for_each_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for k in range(1, 14):
        assert sum(q.startswith(f"op{k}_") for q in QUERIES) == 1
    for name in ("op3_token_count", "op7_bpe"):
        assert QUERIES[name](spark, SF).count() == n
    a, b = (QUERIES[q](spark, SF).select("doc_id", "n_tokens") for q in ("op3_token_count", "op7_bpe"))
    assert a.exceptAll(b).count() == 0


def test_repeats_and_phrases_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    cols = ["doc_id", "n_bytes", "kept_sha256", "n_removed", "n_spans"]
    same(QUERIES["op2_suffix_dedup"](spark, SF), list(brute_suffix(rows, docs)), cols)
    same(QUERIES["op10_license_scan"](spark, SF), brute_phrases(rows), ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"])


def test_pipeline(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = docs.limit(1)
    docs = docs.unionByName(twice).unionByName(spark.createDataFrame([(None, None, None, None, None)], schema))
    before = docs
    for k, (name, stage) in enumerate(P.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, before, SF).write.parquet(path)
        after = spark.read.parquet(path)
        if k < 4:
            assert after.columns == before.columns and after.dtypes == before.dtypes
        if name == "line_dedup":
            assert after.count() == before.count()
            assert after.where("n_chars <> length(text)").count() == 0
        elif name == "simhash":
            from tabforge.llm.simhash import simhash_dedup
            groups = simhash_dedup(before).select("root").distinct().count()
            assert after.count() == groups
        elif name == "decontamination":
            from tabforge.llm.decontam import contaminated
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert contaminated(after, bench).where("contaminated").count() == 0
            assert after.count() == contaminated(before, bench).where("not contaminated").count()
        elif name == "bpe":
            assert after.count() == before.count()
        before = after
    empty = docs.where("false")
    for k, (_, stage) in enumerate(P.STAGES):
        assert stage(spark, empty, SF).count() == 0
    assert os.path.isdir(tmp_path) and docs.where(F.col("doc_id").isNull()).count() == 1
