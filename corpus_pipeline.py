"""A training corpus from raw documents: five stages, each reading all rows its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` applies them in order and writes each result as Parquet into the shared folder.

Rows are told apart by id and text, so ids may be null or repeated; an empty table gives an empty result; columns beside
those of ``documents`` pass through all stages but the last. ``__id``, ``__hash`` and ``__again`` are working names: a
column of ``docs`` that has one of them is overwritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.bpe import bpe_encode
from tabforge.llm.common import all_equal, settle, small
from tabforge.llm.decontam import contaminated
from tabforge.llm.line_dedup import line_dedup
from tabforge.llm.queries import tokenizer_path
from tabforge.llm.simhash import simhash_dedup
from tabforge.llm.toxicity import score, train
from tabforge.plans.tables import load
from tabforge.session import ensure_checkpoint_dir


def _hashed(docs: DataFrame) -> DataFrame:
    """Rows are told apart by id and text, as ids may be null or repeated."""
    return docs.withColumn("__id", F.col("doc_id")).withColumn("__hash", F.xxhash64("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = train(docs, load(spark, sf_dir, "labels"))
    return score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but for those of the last document that holds them; no document goes."""
    out = line_dedup(docs)
    put = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[put[c].alias(c) if c in put else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays (one row of equal ones)."""
    own = settle(simhash_dedup(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
                 .groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")))
    keep = settle(own.groupBy("root").agg(F.min(F.struct("text_hash", "doc_id", "n")).alias("k"))
                  .select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash"), (F.col("k.n") > 1).alias("__again")))
    hashed = _hashed(docs)
    stay = hashed.join(keep, all_equal(hashed, keep, "__id", "__hash")).select(*[hashed[c] for c in hashed.columns], "__again")
    if keep.where("__again").limit(1).count():  # equal rows of one id: all but one go
        stay = stay.where("not __again").unionByName(stay.where("__again").dropDuplicates(["__id", "__hash"]))
    return stay.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    bad = settle(contaminated(docs, load(spark, sf_dir, "benchmark")).where("contaminated")
                 .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    hashed = _hashed(docs)
    return hashed.join(small(bad, 40), all_equal(hashed, bad, "__id", "__hash"), "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text."""
    return bpe_encode(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

# A learned classifier, XXH64 fingerprints and BPE have no SQL form: the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4()}"
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
