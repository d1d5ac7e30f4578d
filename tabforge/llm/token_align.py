"""Cross-tokenizer alignment over distinct texts.

Documents are shuffled by their full text, so each distinct text is tokenised by both tokenizers and aligned once; what it
adds to the corpus-wide counts of linked token pairs is weighted by its number of copies. Byte offsets where tokens of
both end cut a text into groups, and every token of one tokenizer is linked to those of the other in its group.

Neither tokenizer joins a character that is no white space to a blank or line break behind it, so a text falls into
pieces there (white space and what follows), which are aligned one by one; pieces met before come from a bounded per-task
table. Texts with other white space are aligned whole.

Counts are joined back to the texts without shuffling every pair: the most frequent pairs, a table of bounded size, are
looked up in the tasks; only the pairs beyond it, rare ones, are shuffled to their counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.bpe import _byte_chars, read_spec
from tabforge.llm.common import settle, ship
from tabforge.session import ensure_checkpoint_dir

ship(__name__)
KNOWN_PIECES, KNOWN_CHARS = 1 << 17, 1 << 24  # size of the table of pieces met before; it starts anew beyond that
BATCH_CHARS = 1 << 20  # documents are taken together up to this length
HEAD_PAIRS = 1 << 19  # most frequent pairs that are looked up in the tasks, at most
PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]")


class Aligner:
    """Both tokenizers, the tables of their tokens' bytes, and the pieces met before."""

    def __init__(self, spec_a: bytes, spec_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        self.encode_a, names = _byte_level(spec_a)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=spec_b)
        byte = {c: i for i, c in enumerate(_byte_chars())}
        self.bytes_a = [bytes(byte[c] for c in names.get(i, "") if c in byte) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.long_a, self.long_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.base, self.blank = len(pieces), self.b.piece_to_id("▁")
        # A token as it stands in the groups: a comma follows inside one side, a bar after A's side, a semicolon after B's.
        self.written = [f"{i}{c}" for n, marks in ((len(self.bytes_a), ",|"), (len(pieces), ",;")) for c in marks for i in range(n)]
        self.long_written = np.array([*map(len, self.written)], np.int64)
        # A text may be cut before a blank or line break only if no piece reaches over such a place.
        held = [p.replace("▁", " ") for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.cut = not any(re.search(r"[^ \n][ \n]|\n.|.\n", p, re.S) for p in held)
        self.forget()

    def forget(self) -> None:
        """Pieces met before: their number, and by number what ``align`` says of them."""
        self.number: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str | None] = []
        self.facts = np.zeros((0, 4), np.int64)
        self.start, self.size, self.pool = (np.zeros(0, np.int64) for _ in range(3))  # where its pairs lie

    def _ids_b(self, pieces: list[str]) -> list[list[int]]:
        """The model puts a blank before each text: a piece's own first blank is that one, or the blank is dropped again."""
        out = self.b.encode([p[1:] if p[:1] == " " else p for p in pieces], num_threads=1)
        for k, p in enumerate(pieces):
            if p == " ":
                out[k] = [self.blank]
            elif p[:1] != " ":
                out[k] = out[k][1:] if out[k] and self.bytes_b[out[k][0]] == b" " else []
        return out

    def align(self, pieces: list[str]) -> tuple[np.ndarray, list[str | None], np.ndarray, np.ndarray]:
        """Of every piece ``n_a, n_b, n_groups, n_links``, the groups written out (None where a tokenizer's bytes are not the
        piece's own), the number of its pairs, and all pairs (``a * base + b``, as often as linked) in a row.

        All pieces lie behind each other in arrays of tokens, so offsets where tokens of both end are looked up at once.
        """
        ids_a, ids_b = self.encode_a(pieces), self._ids_b(pieces)
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        good = np.ones(len(pieces), bool)
        for ids, table in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            if b"".join(map(table.__getitem__, chain.from_iterable(ids))) != b"".join(raw) or [*map(len, raw)] != [
                    sum(map(len, map(table.__getitem__, x))) for x in ids]:
                good &= [b"".join(map(table.__getitem__, x)) == r for x, r in zip(ids, raw)]
        flat, owner = [], []
        for ids in (ids_a, ids_b):
            ids = [x if g else [] for x, g in zip(ids, good)] if not good.all() else ids
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())))
            owner.append(np.repeat(np.arange(len(ids)), sizes))
        a, b = flat
        ends_a, ends_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        mark = np.zeros(int(ends_a[-1]) + 1 if len(a) else 1, bool)
        mark[ends_a] = True
        cuts = ends_b[mark[ends_b]]
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        first_b = np.cumsum(in_b) - in_b
        times = in_b[group_a]  # an A token meets every B token of its group
        where = np.cumsum(times) - times
        mate = np.repeat(first_b[group_a] - where, times) + np.arange(int(times.sum()))
        pairs = np.repeat(a, times) * self.base + b[mate]
        n = len(pieces)
        group_owner = owner[1][np.append(group_b[1:] != group_b[:-1], True)] if len(b) else np.zeros(0, np.int64)
        links = np.bincount(owner[0], weights=times, minlength=n).astype(np.int64)
        facts = np.stack([*(np.bincount(o, minlength=n) for o in (owner[0], owner[1], group_owner)), links], 1)
        # Written out: A's tokens of a group, then B's.
        last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (group_a, group_b))
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = a + last_a * len(self.bytes_a)
        code[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = b + 2 * len(self.bytes_a) + last_b * self.base
        text = "".join(map(self.written.__getitem__, code.tolist()))
        stops = np.append(0, np.cumsum(self.long_written[code]))[np.cumsum(facts[:, 0] + facts[:, 1])].tolist()
        groups = [text[i:max(i, j - 1)] if g else None for i, j, g in zip([0, *stops], stops, good.tolist())]
        return facts, groups, links, pairs

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.number]
        if len(self.number) + len(new) > KNOWN_PIECES or self.chars > KNOWN_CHARS:
            self.forget()
            new = list(pieces)
        if not new:
            return
        facts, groups, size, pairs = self.align(new)
        self.chars += sum(map(len, new))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.facts = np.concatenate((self.facts, facts))
        self.groups += groups
        self.size, self.pool = np.concatenate((self.size, size)), np.concatenate((self.pool, pairs))
        self.start = np.cumsum(self.size) - self.size

    def pieces(self, text: str) -> list[str]:
        """``text`` with a blank before it, cut up. Null and empty texts have none."""
        if not text:
            return []
        return PIECE.findall(" " + text) if self.cut and not OTHER_SPACE.search(text) else [" " + text]

    def texts(self, texts: list[str | None]) -> Iterator[tuple]:
        """Portions of the texts in order: ``n_a, n_b, n_groups, n_links`` of each, its groups, its number of distinct pairs,
        and the pairs of all with how often each is linked."""
        group, chars = [], 0
        for k, t in enumerate(texts):
            group.append(self.pieces(t or ""))
            chars += len(t or "")
            if chars >= BATCH_CHARS or k + 1 == len(texts):
                self.learn(set().union(*group))
                yield self._portion(group)
                group, chars = [], 0

    def _portion(self, group: list[list[str]]) -> tuple:
        n = len(group)
        ats = [[*map(self.number.__getitem__, pieces)] for pieces in group]
        groups = []
        for i, at in enumerate(ats):
            written = [*map(self.groups.__getitem__, at)]
            if None in written:
                ats[i], written = [], []
            groups.append(";".join(written))
        at = np.fromiter(chain.from_iterable(ats), np.int64)
        doc = np.repeat(np.arange(n), [*map(len, ats)])
        facts = np.zeros((n, 4), np.int64)
        np.add.at(facts, doc, self.facts[at])
        size = self.size[at]
        ends = np.cumsum(size)
        pairs = self.pool[np.repeat(self.start[at] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        span = len(self.bytes_a) * self.base
        keys, often = np.unique(np.repeat(doc, size) * span + pairs, return_counts=True)
        return facts, groups, np.bincount(keys // span, minlength=n), keys % span, often


# Fixed value: how byte-level tokenizer files of this kind part a text before merging.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_level(spec: bytes):
    """A function from texts to ids, and the vocabulary by id, of a byte-level tokenizer file.

    Where the file's merges are in the order of the ids they make, its vocabulary is a table of merge ranks, which a
    smaller and faster library takes. Any other file goes to the library of the file's format.
    """
    file = json.loads(spec)
    vocab, merges, pre = file["model"]["vocab"], file["model"]["merges"], file["pre_tokenizer"]
    names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
    plain = (file.get("normalizer") is None and pre["type"] == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
             and not file["model"].get("dropout") and made == list(range(256, 256 + len(made))))
    if plain:
        import tiktoken
        byte = {c: i for i, c in enumerate(_byte_chars())}
        special = {t["content"] for t in file["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        one = tiktoken.Encoding("byte level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [*map(one, texts)], names
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(spec.decode())
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)], names


MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """One row per distinct text: ``key`` (its SHA-256), ``copies``, the measures, ``groups_sha256``, and ``pairs`` with
    ``often`` (distinct linked pairs as ``a * vocabulary of B + b``, and how often each is linked). With ``keep_groups``
    also ``groups``, the aligned ids. Null texts count as empty; a text whose tokens are not its own bytes has none."""
    sc = docs.sparkSession.sparkContext
    spec = sc.broadcast((read_spec(path_a), read_spec(path_b)))
    schema = ("key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "pairs array<long>, often array<int>" + ", groups string" * keep_groups)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*spec.value)
        names = [f.split(" ")[0] for f in schema.split(", ")]
        for frame in frames:
            texts, at = frame.column(0).to_pylist(), 0
            for facts, groups, many, pairs, often in aligner.texts(texts):  # portions, as long texts have many pairs
                mine = texts[at:at + len(groups)]
                keys = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in mine]
                sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                ends = pa.array(np.append(0, np.cumsum(many)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(c, t)) for c, t in ((pairs, pa.int64()), (often, pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), frame.column(1).slice(at, len(mine)), *(pa.array(facts[:, i]) for i in range(4)),
                     pa.array(sha, pa.string()), *lists, *([pa.array(groups, pa.string())] if keep_groups else [])], names)
                at += len(mine)
    distinct = docs.groupBy(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    return distinct.mapInArrow(run, schema)


def pair_counts(texts: DataFrame, base: int) -> DataFrame:
    """``pair, count, best``: documents that hold the pair linked, and whether no pair of its A id has more."""
    counts = settle(texts.select(F.explode("pairs").alias("pair"), "copies").groupBy("pair").agg(F.sum("copies").alias("count")))
    a = F.expr(f"pair div {base}")
    top = settle(counts.groupBy(a.alias("a")).agg(F.max("count").alias("top")))  # a row per token of A's vocabulary
    return counts.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "count", (F.col("count") == F.col("top")).cast("int").alias("best"))


def token_alignment(docs: DataFrame, path_a: str, path_b: str, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row per row of ``docs``.

    Texts are encoded whole, with a blank before them, by the byte-level tokenizer at ``path_a`` and the piece model at
    ``path_b`` (which puts the blank itself), special strings as plain text. Two tokens are linked if their byte
    ranges lie in one group. A pair's count is the number of rows of ``docs`` that hold it linked; ``count_sum`` adds
    it up over a row's links, ``n_best`` are the links whose count is the highest of their A id. ``groups_sha256``
    digests the groups (``a1,a2|b1;a3|b2``). Null and empty texts, and texts whose tokens' bytes are not their own,
    have zeros and ''. Ids may be null or repeated; other columns are ignored; an empty table gives an empty result.
    ``head_pairs`` bounds the table of frequent pairs kept in the tasks and never changes the result.
    """
    import sentencepiece
    spark = docs.sparkSession
    base = sentencepiece.SentencePieceProcessor(model_proto=read_spec(path_b)).vocab_size()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/aligned-{uuid.uuid4()}"
    aligned_texts(docs, path_a, path_b).write.option("compression", "zstd").parquet(path)
    texts = spark.read.parquet(path)
    counts = settle(pair_counts(texts, base))
    # The least power of two that at most ``head_pairs`` pairs reach.
    levels = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("level")).agg(F.count("*").alias("n")).collect()  # at most 63
    level, held = max([r["level"] for r in levels], default=0) + 1, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        held += r["n"]
        if held > head_pairs:
            break
        level = r["level"]
    least = 1 << level
    head = counts.where(F.col("count") >= least).orderBy("pair").toArrow()
    head = spark.sparkContext.broadcast(tuple(head.column(c).to_numpy() for c in ("pair", "count", "best")))

    def look_up(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = head.value
        for frame in frames:
            lists = frame.column("pairs")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            pairs, often = lists.flatten().to_numpy(), frame.column("often").flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(frame.num_rows), sizes)
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = [np.zeros(frame.num_rows, np.int64) for _ in range(2)]
            for total, value in zip(sums, (count, best)):
                np.add.at(total, row[hit], often[hit] * value[at[hit]])
            left = np.cumsum(np.append(0, np.bincount(row[~hit], minlength=frame.num_rows)))
            rare = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~hit], t)) for x, t in ((pairs, pa.int64()), (often, pa.int32()))]
            yield pa.RecordBatch.from_arrays([frame.column("key"), *map(pa.array, sums), *rare], ["key", "count_sum", "n_best", "pairs", "often"])
    common = settle(texts.select("key", "pairs", "often").mapInArrow(
        look_up, "key binary, count_sum long, n_best long, pairs array<long>, often array<int>"))
    rare = settle(common.where(F.size("pairs") > 0).select("key", F.explode(F.arrays_zip("pairs", "often")).alias("p"))
                  .select("key", F.col("p.pairs").alias("pair"), F.col("p.often").alias("often")))
    rare = (rare.join(counts.where(F.col("count") < least), "pair").groupBy("key")
            .agg(F.sum(F.col("often") * F.col("count")).alias("rare_sum"), F.sum(F.col("often") * F.col("best")).alias("rare_best")))
    add = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).cast("long")
    measures = settle(texts.select("key", *MEASURES, "groups_sha256").join(common.select("key", "count_sum", "n_best"), "key")
                      .join(rare, "key", "left").select("key", *MEASURES, add("n_best", "rare_best").alias("n_best"),
                                                        add("count_sum", "rare_sum").alias("count_sum"), "groups_sha256"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)).alias("key"))
    return own.join(measures, "key").select("doc_id", *MEASURES, "n_best", "count_sum", "groups_sha256")
