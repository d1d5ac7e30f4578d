"""Substring dedup in the manner of a suffix array built by distributed prefix doubling.

Positions are ranked by growing prefixes and leave as soon as they are unique. The first rank is by 32
bytes, taken only at sampled positions: of every 100-byte window the position of its least 32-byte
hash, so equal windows sample the same place. Sampled places with the same rank are reranked by all
the bytes their windows cover; places still alike but for the first are covered whole. Where places
agree on 32 bytes but not on all, their windows are ranked one by one at the full 100 bytes. Ranks
are 64-bit fingerprints, two of which must agree for two strings to count as equal. First ranks that
very many places share are dealt out in shares, and the first places of the shares ranked again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import settle, ship, small

ship(__name__)
GRAM = 32  # bytes of the first rank
PIECE = 1 << 20  # window starts handled at a time
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses modulo 2^64
NO_ID = -(1 << 63)
CHUNK, SAMPLE = 4096, 16  # one in SAMPLE chunks of text is searched for hot first ranks
HOT_SHARE, HOT_LEAST = 512, 16  # hot: more than one in HOT_SHARE sampled places, and so many of them,
HOT_PLACES = 1 << 20  # or about so many places, however small a share of all they are
SHARES = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Roller:
    """Hashes of any substrings of a piece, by prefix sums modulo 2^64."""

    def __init__(self, size: int):
        self.up = [_powers(b, size + 1) for b in BASES]
        self.down = [_powers(pow(b, -1, 1 << 64), size + 1) for b in BASES]

    def sums(self, data: np.ndarray, lane: int) -> np.ndarray:
        return np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[lane][:len(data)])))

    def hashes(self, sums: np.ndarray, lane: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the substrings from a to b, lengths included."""
        return _mix((sums[b] - sums[a]) * self.down[lane][a] + (b - a).astype(np.uint64))


def _pieces(n: int, length: int) -> Iterator[tuple[int, int]]:
    """Ranges of bytes whose windows are handled together."""
    for at in range(0, max(0, n - length + 1), PIECE):
        yield at, min(n, at + PIECE + length - 1)


def anchors(data: np.ndarray, roller: Roller, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``gram, context, place``: hashes, and position * 2^16 + first window * 2^8 + last window (counted back from it)."""
    for at, to in _pieces(len(data), length):
        part = data[at:to]
        sums = roller.sums(part, 0)
        index = np.arange(len(part) - GRAM + 1)
        grams = roller.hashes(sums, 0, index, index + GRAM)
        least, width, want = (grams & np.uint64(0xFFFFFFFFFF000000)) | index.astype(np.uint64), 1, length - GRAM + 1
        while width < want:
            step = min(width, want - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        pos = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, pos[1:] != pos[:-1]))
        last = np.append(first[1:], len(pos)) - 1
        pos = pos[first]
        context = roller.hashes(roller.sums(part, 1), 1, first, last + length)
        context = _mix(context ^ ((pos - first).astype(np.uint64) << np.uint64(8)))  # the place counts too
        yield grams[pos].view(np.int64), context.view(np.int64), ((pos + at) << 16) + ((pos - first) << 8) + (pos - last)


def _bytes(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and text.as_buffer().size else np.zeros(0, np.uint8)


def _starts(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pos = places >> 16
    return pos - ((places >> 8) & 255), pos - (places & 255)


def _list(x: pa.Scalar) -> np.ndarray:
    return np.array(x.as_py() or [], np.int64)


def hot_grams(own: DataFrame, length: int) -> DataFrame:
    """``gram, hot``: first ranks that a sample shows to be frequent. They choose how rows are dealt out, not the result."""
    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(CHUNK + length)
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                data, key = _bytes(t), i.as_py()
                for at in range(0, len(data), CHUNK):
                    if hash((key, at)) % SAMPLE == 0:
                        for gram, _, _ in anchors(data[at:at + CHUNK + length - 1], roller, length):
                            yield pa.RecordBatch.from_arrays([pa.array(gram)], ["gram"])
    counts = settle(own.select("id", "text").mapInArrow(some, "gram long").groupBy("gram").count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    counts = counts.where(F.col("count") >= HOT_LEAST)
    hot = (F.col("count") * HOT_SHARE > total) | (F.col("count") * SAMPLE > HOT_PLACES)
    return settle(counts.where(hot).select("gram", F.lit(True).alias("hot")))


def shared_out(df: DataFrame, hot: DataFrame, *place: Column | str) -> DataFrame:
    """Adds ``share``: -1, or for the rows of a hot gram one of SHARES by the hash of ``place``."""
    share = F.when(F.col("hot"), F.pmod(F.xxhash64(*place), F.lit(SHARES)).cast("int")).otherwise(-1)
    return df.join(small(hot, 16), "gram", "left").withColumn("share", share).drop("hot")


def by_id(df: DataFrame, group: tuple[str, ...], at: str, opened: bool = True) -> DataFrame:
    """``id, again, open``: the places ``at`` of rank above 1 and, if ``opened``, of rank 1.

    Ranks are within shares; the first places of the shares of a group, SHARES at most, are ranked among each other.
    """
    first = (F.col("share") >= 0) & (F.col("rank") == 1)
    keys = [F.when(first, F.col(c)).alias(f"key{n}") for n, c in enumerate(group)] + [F.when(~first, F.col("id")).alias("own")]
    sets = df.groupBy(*keys).agg(
        F.collect_set(F.when(~first & (F.col("rank") > 1), F.col(at))).alias("again"),
        F.collect_set(F.when(~first & (F.col("rank") == 1), F.col(at))).alias("open"),
        F.array_sort(F.collect_set(F.when(first, F.struct("id", F.col(at).alias("at"))))).alias("firsts"))
    none = F.array().cast("array<long>")
    ranked = F.transform("firsts", lambda x, n: F.struct(
        x["id"].alias("id"), F.when(n > 0, F.array(x["at"])).otherwise(none).alias("again"),
        F.when(n == 0, F.array(x["at"])).otherwise(none).alias("open")))
    ranked = ranked if opened else F.slice(ranked, 2, SHARES)
    rows = sets.select(F.inline(F.when(F.col("own").isNull(), ranked).otherwise(
        F.array(F.struct(F.col("own").alias("id"), "again", "open")))))
    return rows.groupBy("id").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("again", "open")])


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes left).

    Every byte that lies in a ``length``-byte string which also starts earlier (smaller id, or same document, earlier
    start) goes; strings are judged on the input. Matches never cross documents. A null text is empty; texts under
    ``length`` bytes stay whole. A null id comes before all others. Rows that repeat both id and text are one document
    and get equal results; rows that share only the id follow each other in the order of their text's hash. An empty
    table gives an empty result.
    """
    if not GRAM <= length <= GRAM + 255:
        raise ValueError(f"length must be {GRAM} to {GRAM + 255}")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = own.select("id", F.xxhash64("text").alias("th")).distinct()
    if ids.groupBy("id").count().where("count > 1").limit(1).count():  # ids that name several texts are told apart
        number = settle(ids.orderBy("id", "th").withColumn("seq", F.monotonically_increasing_id()))
        own = own.withColumn("th", F.xxhash64("text")).join(number, ["id", "th"]).select(F.col("seq").alias("id"), "doc_id", "text")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(PIECE + length)
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                for gram, context, place in anchors(_bytes(t), roller, length):
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(context), pa.array(np.full(len(gram), i.as_py())), pa.array(place)],
                                                     ["gram", "context", "id", "place"])
    places = own.select("id", "text").mapInArrow(sample, "gram long, context long, id long, place long")
    hot = hot_grams(own, length)  # dealt out by document and megabyte
    some_hot = hot.limit(1).count() > 0
    places = shared_out(places, hot, "id", F.shiftright("place", 36)) if some_hot else places.withColumn("share", F.lit(-1))
    by_gram, by_context = Window.partitionBy("gram", "share"), Window.partitionBy("gram", "share", "context")
    ranked = (places.withColumn("n", F.count("*").over(by_gram)).where("n > 1 or share >= 0")
              .withColumn("rank", F.dense_rank().over(by_context.orderBy("id", "place")))
              .withColumn("contexts", F.sum((F.col("rank") == 1).cast("int")).over(by_gram))
              .where("rank > 1 or contexts > 1 or share >= 0"))
    # First places of hot grams stay open without counting their contexts, which costs windows but no repeat.
    ranked = settle(by_id(ranked, ("gram", "context"), "place") if some_hot else ranked.groupBy("id").agg(
        F.collect_set(F.when(F.col("rank") > 1, F.col("place"))).alias("again"),
        F.collect_set(F.when(F.col("rank") == 1, F.col("place"))).alias("open")))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(PIECE + length)
        for b in batches:
            for i, t, o in zip(b.column("id"), b.column("text"), b.column("open")):
                data, places = _bytes(t), np.sort(_list(o))
                lo, hi = _starts(places)
                for at, to in _pieces(len(data), length):
                    mine = (lo >= at) & (lo < at + PIECE)
                    if not mine.any():
                        continue
                    first, size, pos = lo[mine] - at, hi[mine] - lo[mine] + 1, (places[mine] >> 16) - at
                    ends = np.cumsum(size)
                    starts = np.repeat(first - ends + size, size) + np.arange(ends[-1])
                    grams = roller.hashes(roller.sums(data[at:to], 0), 0, pos, pos + GRAM)
                    full = roller.hashes(roller.sums(data[at:to], 1), 1, starts, starts + length)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(full.view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams.view(np.int64)), pa.array(np.full(len(first), i.as_py())), pa.array(first + at), pa.array(pos - first), lists],
                        ["gram", "id", "first", "back", "full"])
    # Equal windows have the same place in them, so they meet by the place's first rank. This side of the join and the
    # last one read the same shuffled documents.
    opened = own.join(ranked.where(F.size("open") > 0), "id").select("id", "doc_id", "text", "open")
    late = opened.mapInArrow(windows, "gram long, id long, first long, back long, full array<long>")
    late = shared_out(late, hot, "id", F.shiftright("first", 20)) if some_hot else late.withColumn("share", F.lit(-1))
    late = (late.repartition("gram", "share").select("gram", "share", "id", "first", "back", F.posexplode_outer("full").alias("k", "h"))
            .select("gram", "share", "id", (F.col("back") - F.col("k")).alias("back"), (F.col("first") + F.col("k")).alias("start"), "h")
            .withColumn("rank", F.dense_rank().over(Window.partitionBy("gram", "share", "back", "h").orderBy("id", "start")))
            .where("rank > 1 or share >= 0"))
    late = (by_id(late, ("gram", "back", "h"), "start", opened=False).select("id", F.col("again").alias("late")) if some_hot
            else late.groupBy("id").agg(F.collect_set("start").alias("late")))
    marks = ranked.select("id", "again").join(late, "id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, again, late in zip(*b.columns):
                data = _bytes(t)
                lo, hi = _starts(_list(again))
                one = _list(late)
                step = np.zeros(len(data) + 1, np.int32)
                np.add.at(step, np.concatenate((lo, one)), 1)
                np.add.at(step, np.concatenate((hi, one)) + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = data[~gone].tobytes()
                spans = int((gone & ~np.append(False, gone[:-1])).sum())
                rows.append((i.as_py(), len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(6)], names)
    return (own.join(marks, "id", "left").select("doc_id", "text", "again", "late")
            .mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
