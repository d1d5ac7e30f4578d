"""Hard-negative mining with exact integer scores from a residue number system.

Vectors become whole numbers. Modulo each of a few small primes a block of anchors and a block of rows are multiplied
as float32 matrices: with components in [-p/2, p/2] and ``CHUNK`` of them at a time every sum stays below 2**24, where
float32 is exact. The Chinese remainder theorem (in mixed radix form) gives the signed score back from its residues.
Anchors come in blocks of bounded size that are broadcast; every task keeps its best rows for each anchor, and Spark
merges the tasks' lists. One pass over the rows finds the positives of a block of anchors, a second one the
negatives inside the score window of each positive.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import settle, ship
from tabforge.session import ensure_checkpoint_dir

ship(__name__)
CHUNK = 64  # components multiplied at once: CHUNK * (p // 2) ** 2 + p < 2 ** 24 for primes below 1024
LARGEST_PRIME = 1021
TILE = 1 << 21  # scores computed at once
#: Components of the anchors of one block, at most: 16,384 anchors of 64.
BLOCK_ITEMS = 1 << 20


def primes_for(bound: int) -> list[int]:
    """The largest primes up to ``LARGEST_PRIME`` whose product exceeds ``2 * bound``."""
    out, product, n = [], 1, LARGEST_PRIME
    while product <= 2 * bound:
        if all(n % d for d in range(2, int(n ** 0.5) + 1)):
            out.append(n)
            product *= n
        n -= 1
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers modulo ``p`` as float32 in [-p/2, p/2]."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


class Scorer:
    """Exact inner products of rows with a block of anchors (int64 matrices)."""

    def __init__(self, anchors: np.ndarray, primes: list[int]):
        self.primes, self.parts = primes, [residues(anchors, p) for p in primes]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        out, radix = np.zeros((len(rows), len(self.parts[0])), np.int64), 1
        for p, part in zip(self.primes, self.parts):
            mine, total = residues(rows, p), np.zeros(out.shape, np.float32)
            for k in range(0, rows.shape[1], CHUNK):
                c = mine[:, k:k + CHUNK] @ part[:, k:k + CHUNK].T
                total += c - p * np.rint(c / np.float32(p))
            # The next digit in mixed radix, in [-p/2, p/2]: all digits together are the signed score.
            digit = (total.astype(np.int64) - out) % p * pow(radix, -1, p) % p
            out += radix * np.where(digit > p // 2, digit - p, digit)
            radix *= p
        return out


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of equal length; shorter vectors are filled up with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _best(group: np.ndarray, score: np.ndarray, rid: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group by falling score, then rising id."""
    order = np.lexsort((rid, -score, group))
    g = group[order]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < k]


def _search(rows: DataFrame, spec, k: int) -> DataFrame:
    """Each task's first ``k`` rows of every target: ``target, score, rid``.

    ``spec`` is a broadcast block of anchors (matrix, ids, labels) with targets: the number of an anchor and a range of
    scores, for rows of its label if ``same``, else for those of others. Rows with the anchor's own id are left out.
    """
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, primes, ids, labels, anchor, low, high, same = spec.value
        scorer, waiting, n_waiting = Scorer(matrix, primes), [], 0
        kept = [np.zeros(0, np.int64)] * 3  # target, score, id
        floor = np.array(low)  # the least score that may still enter a target's list

        def settle_lists():
            target, score, rid = (np.concatenate(c) for c in zip(kept, *waiting))
            keep = _best(target, score, rid, k)
            kept[:] = target[keep], score[keep], rid[keep]
            waiting.clear()
            count = np.bincount(kept[0], minlength=len(anchor))
            last = np.cumsum(count)[count >= k] - 1
            floor[kept[0][last]] = kept[1][last]

        for frame in frames:
            step = max(1, TILE // max(len(ids), len(anchor)))
            for at in range(0, frame.num_rows, step):
                part = frame.slice(at, step)
                rid, label = (part.column(c).to_numpy() for c in ("rid", "label"))
                scores = scorer.scores(_matrix(part.column("q"), matrix.shape[1]))
                allowed = ((label[:, None] == labels) == same) & (rid[:, None] != ids)
                s = scores[:, anchor]
                i, j = np.nonzero(allowed[:, anchor] & (s >= floor) & (s <= high))
                waiting.append((j, s[i, j], rid[i]))
                n_waiting += len(i)
                if n_waiting > TILE + len(kept[0]):
                    settle_lists()
                    n_waiting = 0
        settle_lists()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in kept], ["target", "score", "rid"])
    return rows.mapInArrow(run, "target long, score long, rid long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("target").orderBy(F.desc("score"), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, scale: int, flip: int, n_labels: int) -> DataFrame:
    """``rid, label, q``: rows that take part, whole-number vectors, and the label moved on where the id is divisible by ``flip``."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    known = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    label = F.col("label").cast("long")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & known)
    if flip:
        label = F.when(F.col("vec_id") % flip == 0, (label + 1) % n_labels).otherwise(label)
    return rows.select(F.col("vec_id").cast("long").alias("rid"), label.alias("label"), F.transform(x, lambda v: F.floor(v * scale)).alias("q"))


def hard_negatives(vectors: DataFrame, every: int = 100, flip: int = 7, n_labels: int = 10, scale: int = 256,
                   n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, embedding, label``. Rows with a null id, label or vector, or with a null or non-finite
    component take no part. A component x becomes ``floor(scale * x)``; a score is the inner product. Anchors are the rows
    whose id is divisible by ``every``; equal anchor rows are one anchor. An anchor's positives are its first
    ``n_positives`` rows of the same label with another id, by falling score, then rising id. The negatives of a positive
    are the first ``n_negatives`` rows of other labels with ``low * positive <= 100 * negative <= high * positive``.
    Every row counts, repeated ones too; shorter vectors are filled up with zeros. Labels of ids divisible by ``flip``
    are moved on by one, modulo ``n_labels`` (0: no flip). No anchors or no rows give an empty result. Scores beyond
    2**61 raise ValueError. Anchors are taken in blocks of at most ``block_items`` components, which never changes the result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, scale, flip, n_labels)
    dims, most = rows.agg(F.max(F.size("q")), F.max(F.greatest(F.abs(F.coalesce(F.array_max("q"), F.lit(0))),
                                                               F.abs(F.coalesce(F.array_min("q"), F.lit(0)))))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    bound = (dims or 0) * (most or 0) ** 2
    if bound >= 1 << 61:
        raise ValueError("scores of these vectors do not fit into 64 bits")
    primes = primes_for(max(1, bound))
    anchors = rows.where(F.col("rid") % every == 0).distinct()
    n_anchors = anchors.count()
    size = max(1, block_items // max(1, dims or 1))
    n_blocks = -(-n_anchors // size)
    anchors = settle(anchors.withColumn("block", F.pmod(F.xxhash64("rid", "label", "q"), F.lit(max(1, n_blocks)))))
    path, found_any = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hard-negatives-{uuid.uuid4()}", False
    for b in range(n_blocks):
        mine = anchors.where(F.col("block") == b).orderBy("rid", "label", "q").toArrow()  # a block of bounded size
        if mine.num_rows == 0:
            continue
        ids, labels = (mine.column(c).to_numpy() for c in ("rid", "label"))
        matrix = _matrix(mine.column("q").combine_chunks(), dims)

        def search(anchor, least, top, same, k):
            return _first(_search(rows, spark.sparkContext.broadcast((matrix, primes, ids, labels, anchor, least, top, same)), k), k)
        widest = np.iinfo(np.int64)
        best = search(np.arange(len(ids)), np.full(len(ids), widest.min), np.full(len(ids), widest.max), True, n_positives).toArrow()
        if best.num_rows == 0:
            continue
        anchor, positive, score = (best.column(c).to_numpy() for c in ("target", "rid", "score"))
        found = search(anchor, -((-low * score) // 100), (high * score) // 100, False, n_negatives)
        targets = spark.createDataFrame(pa.table({"target": np.arange(len(anchor)), "anchor_id": ids[anchor],
                                                  "positive_id": positive, "positive_score": score}))
        (found.join(F.broadcast(targets), "target")
         .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("rid").alias("negative_id"),
                 "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{path}/block={b}"))
        found_any = True
    return spark.read.schema(schema).parquet(f"{path}/*") if found_any else spark.createDataFrame([], schema)
