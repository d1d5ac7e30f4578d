"""SimHash near-dedup with pivot distance tables.

Each distinct fingerprint gets a table row of its Hamming distances to fixed reference fingerprints
(pivots). By the triangle inequality two fingerprints within ``max_bits`` differ by at most that in
every coordinate, so a pair is discarded by its largest coordinate difference before the exact
distance is taken. Distances to pivots alone cannot bring pairs together without comparing all of
them, so candidates meet by blocks: fingerprints within ``max_bits`` bits agree on all but
``max_bits`` of ``n_blocks`` blocks of bits, and each choice of the agreeing blocks is a join key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import settle, ship
from tabforge.llm.components import connected_components

ship(__name__)
PIECE = 1 << 16  # shingles whose bits are counted at a time


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits: each is set if more than half of the shingles' hashes have it; 0 without words."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(parts)) - 1:].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at:at + PIECE], ends[at:at + PIECE])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp`` (the fingerprint as a signed long) of every row; whole texts, null as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t or "", shingle) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))],
                                             ["doc_id", "text_hash", "fp"])
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string")
                       ).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _pivots(n: int) -> list[int]:
    """Reference fingerprints: fixed pseudo-random 64-bit values."""
    return np.random.default_rng(64).integers(-(1 << 63), (1 << 63) - 1, n, dtype=np.int64).tolist()


def _masks(max_bits: int, n_blocks: int) -> list[int]:
    """Bits that must agree, for each choice of the blocks that may differ, as signed longs."""
    edge = [64 * i // n_blocks for i in range(n_blocks + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(n_blocks)]
    every = (1 << 64) - 1
    masks = [every ^ sum(c) for c in combinations(block, max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, max_bits: int = 2, n_blocks: int = 6, n_pivots: int = 16) -> DataFrame:
    """``u, v`` (u < v): pairs of the distinct longs ``fp`` that differ in at most ``max_bits`` bits."""
    table = fps.select("fp", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("tinyint")
                                       for p in _pivots(n_pivots)]).alias("d"))
    keyed = settle(table.select("fp", "d", F.posexplode_outer(F.array(*[
        F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(max_bits, n_blocks)])).alias("mask", "part")))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = (F.col("a.mask") == F.col("b.mask")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.fp") < F.col("b.fp"))
    for j in range(n_pivots):
        near &= F.abs(F.col("a.d")[j] - F.col("b.d")[j]) <= max_bits
    near &= F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    return a.join(b, near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()


def simhash_dedup(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id, text_hash, root``.

    Words are runs without blanks, A-Z lower-cased; fewer than ``shingle`` words are one shingle; a text without
    words (null, empty) has fingerprint zero and is linked like any other. ``component_id`` is the smallest id
    reachable over links of at most ``max_bits`` bits; null ids are never that smallest, and a component of null
    ids only has a null id. ``root`` is the component's least fingerprint, ``text_hash`` the xxhash64 of the text.
    Repeated rows give repeated results; an empty table gives an empty one.
    """
    own = settle(fingerprints(docs, shingle))
    roots = connected_components(links(own.select("fp").distinct(), max_bits))
    members = settle(own.join(settle(roots), own["fp"] == roots["node"], "left")
                     .select("doc_id", "text_hash", "fp", F.coalesce("root", "fp").alias("root")))
    first = settle(members.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return members.join(first, "root").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "root")
