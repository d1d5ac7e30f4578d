"""Toxicity by a factorization machine over hashed terms.

Spark counts the hashed terms of a bounded labelled sample, once per document and by label, and keeps
the most telling ones. The machine learns a weight and a short vector for each; the product of two
vectors is the weight of their pair, so that two terms together can say what neither does alone.
Scoring is one pass over the texts with the small fitted model broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tabforge.llm.common import SEPARATORS, settle, ship, words

ship(__name__)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
KNOWN_WORDS = 1 << 18  # entries of a task's table of words met before; it starts anew beyond that


@dataclass
class FactorizationMachine:
    """``bias + sum w_i + sum_{i<j} <v_i, v_j>`` over the terms i, j of a text, each counted once."""

    terms: np.ndarray  # sorted 64-bit hashes
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Raw scores of texts whose term numbers lie one after the other in ``flat``."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        linear = np.bincount(owner, self.weights[flat], len(sizes))
        pairs = np.zeros(len(sizes))
        for v in self.vectors.T:
            x = v[flat]
            pairs += np.bincount(owner, x, len(sizes)) ** 2 - np.bincount(owner, x * x, len(sizes))
        return self.bias + linear + pairs / 2


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_machine(terms: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, factors: int, epochs: int,
                batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 0) -> FactorizationMachine:
    """Logistic loss, Adam over shuffled batches; the same input always gives the same model."""
    rng = np.random.default_rng(seed)
    n, mean = len(terms), float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    theta = np.zeros((n + 1, factors + 1))
    theta[:n, 1:] = rng.normal(0, 0.01, (n, factors))
    theta[n, 0] = np.log(mean / (1 - mean))
    m, s, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            sizes = np.array([len(rows[i]) for i in part])
            flat = np.concatenate([rows[i] for i in part]).astype(np.int64)
            owner = np.repeat(np.arange(len(part)), sizes)
            sums = np.stack([np.bincount(owner, theta[flat, k], len(part)) for k in range(1, factors + 1)], 1) if factors else np.zeros((len(part), 0))
            v = theta[flat, 1:]
            raw = theta[n, 0] + np.bincount(owner, theta[flat, 0], len(part)) + (
                (sums ** 2).sum(1) - np.bincount(owner, (v * v).sum(1), len(part))) / 2
            err = (sigmoid(raw) - labels[part]) / len(part)
            g = np.zeros_like(theta)
            each = err[owner]
            g[:, 0] = np.bincount(flat, each, n + 1)
            for k in range(factors):
                g[:, k + 1] = np.bincount(flat, each * (sums[owner, k] - v[:, k]), n + 1)
            g[n, 0] = err.sum()
            g[:n] += decay * theta[:n]
            step += 1
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return FactorizationMachine(terms, float(theta[n, 0]), theta[:n, 0].copy(), theta[:n, 1:].copy())


def is_held_out(doc_id):
    """The third of ids that is never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_terms: int = 4096, min_docs: int = 10,
          factors: int = 4, epochs: int = 8) -> FactorizationMachine:
    """Fit on at most ``max_rows`` labelled rows that are not held out, the first by a hash of their id.

    The bound keeps what the driver gets small at any size of the corpus: ``max_rows`` lists of at most
    ``max_terms`` term numbers. Of the terms held by ``min_docs`` rows the ``max_terms`` with the largest
    standardised difference between the labels are kept (ties by hash). Rows with a null id or label teach nothing;
    an id labelled twice counts with its larger label. Without labelled rows the model gives 0.5 to every text.
    """
    known = (labels.where("doc_id is not null and toxic is not null and not " + "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)")
             .groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    text = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    rows = settle(text.select("doc_id", "y", F.array_distinct(F.transform(
        words(F.col("text")), lambda w: F.xxhash64(F.lower(w)))).alias("terms")))
    n, toxic = rows.agg(F.count("*"), F.sum("y")).first()
    if not n:
        return FactorizationMachine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, factors)))
    counts = rows.select("y", F.explode_outer("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("df"), F.sum("y").alias("pos")).where(f"term is not null and df >= {min_docs}")
    expected = F.col("df") * (toxic / n)
    kept = counts.orderBy((F.abs(F.col("pos") - expected) / F.sqrt(expected + 1)).desc(), "term").limit(max_terms)
    kept = settle(kept.select("term"))
    terms = np.sort(np.array([r[0] for r in kept.collect()], np.int64))
    got = (rows.select("doc_id", "y", F.explode_outer("terms").alias("t"))
           .join(F.broadcast(kept), F.col("t") == F.col("term"), "left")
           .groupBy("doc_id", "y").agg(F.collect_list("term").alias("terms"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").select("y", "terms").toPandas())
    lists = [np.searchsorted(terms, np.sort(np.array(t, np.int64))) for t in got["terms"]]
    return fit_machine(terms, lists, got["y"].to_numpy(), factors, epochs)


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` plus ``score, predicted`` (replacing such columns); whole texts, null or empty get the bias alone."""
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast((model.terms, model.bias, model.weights, model.vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        fm, known = FactorizationMachine(*sent.value), {}
        number = {int(t): i for i, t in enumerate(fm.terms.view(np.uint64))}
        for b in batches:
            lists = []
            for t in b.column(b.schema.get_field_index("__text")).to_pylist():
                own = set(TERM.findall((t or "")))
                if len(known) > KNOWN_WORDS:
                    known = {}
                for w in [w for w in own if w not in known]:
                    known[w] = number.get(xxhash.xxh64_intdigest(w.lower().encode("utf-8", "surrogatepass"), 42), -1)
                ids = {known[w] for w in own} if own else set()
                ids.discard(-1)
                lists.append(np.fromiter(sorted(ids), np.int64, len(ids)))
            p = sigmoid(fm.raw(np.concatenate(lists) if lists else np.zeros(0, np.int64), np.array([len(x) for x in lists], np.int64)))
            rest = b.select([c for c in b.schema.names if c != "__text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(p)], [*rest.schema.names, "score"])
    out = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return (docs.withColumn("__text", F.col("text").cast("string")).mapInArrow(run, out)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
