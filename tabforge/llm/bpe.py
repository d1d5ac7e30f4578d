"""BPE encoding and decoding in batched numpy merge rounds.

The distinct words of many documents lie in one flat array of symbol ids. Each round looks all
neighbouring pairs up by binary search over the sorted pair keys, takes every word's pair of lowest
rank, merges all its places at once and drops words that have no pair left. Words met before come from
a bounded per-task table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import ship

ship(__name__)

# Fixed values. White space as the normaliser's pattern takes it; code points that are not yet letters or numbers to
# the split pattern; capitals that have a small letter only in newer Unicode tables than Python's (first, last, distance).
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
UNASSIGNED = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A"
    r"\U00011DB0-\U00011DDB\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686"
    r"\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA"
    r"\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168"
    r"\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE"
    r"\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F")
NEW_CAPITALS = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1),
                (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20),
                (0x16EA0, 0x16EB8, 0x1B)]
LOWER = {c: c + d for a, b, d in NEW_CAPITALS for c in range(a, b + 1)} | {ord("Σ"): ord("σ")}
HAS_LOWER = regex.compile("[" + "".join(map(chr, LOWER)) + "]")
LETTER, NUMBER = rf"[\p{{L}}--[{UNASSIGNED}]]", rf"[\p{{N}}--[{UNASSIGNED}]]"
PIECES = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{LETTER}+|{NUMBER}|[^{SPACE}{LETTER}{NUMBER}]+")
# Below U+0530 the same pattern, its classes spelt out for the faster standard library.
_LOW = [chr(c) for c in range(0x530)]
_L, _N = ("".join(c for c in _LOW if unicodedata.category(c)[0] == k) for k in "LN")
LOW_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\t-\r \x85\xA0{_L}{_N}]+")
HIGH = re.compile("[^\\x00-\u052F]")
NO_RANK = np.int64(1 << 40)
KNOWN_WORDS = 1 << 18  # entries of the table of words met before; it starts anew beyond that
BATCH_CHARS = 1 << 20  # documents are taken together up to this length


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A tokenizer file of lower-cased words with an end-of-word suffix and byte symbols."""

    def __init__(self, spec: str | bytes):
        model = (spec := json.loads(spec))["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.base = np.int64(max(self.tokens) + 1)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        # All places of a pair may be merged in one round only if what it makes never ranks before it.
        born = np.full(self.base, -1, np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]
        self.ordered = bool((np.maximum(born[left], born[right]) < np.arange(len(made))).all())
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.names = [self.tokens.get(i, "") for i in range(int(self.base))]
        self.decimals = [str(i) for i in range(int(self.base))]
        self.forget()

    def forget(self) -> None:
        """Words met before: their number, and by number where their ids lie in the pool."""
        self.number: dict[str, int] = {}
        self.start, self.size, self.pool = (np.zeros(0, np.int64) for _ in range(3))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after the other, and each word's number of them."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids, ends = self.inner[data], np.cumsum(sizes)
        ids[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(raw)), sizes)
        done_ids, done_word = [], []
        while len(ids):
            key = ids[:-1] * self.base + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], NO_RANK)
            rank, at = np.append(rank, NO_RANK), np.append(at, 0)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            low = np.repeat(least, size)
            over = low == NO_RANK
            done_ids.append(ids[over])
            done_word.append(word[over])
            hit = (rank == low) & ~over
            if self.ordered:  # in a row of equal symbols every second place, from the left
                index = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), index, 0))
                hit &= (index - run) % 2 == 0
            else:  # leftmost place of each word
                index = np.where(hit, np.arange(len(hit)), len(hit))
                hit &= np.arange(len(hit)) == np.repeat(np.minimum.reduceat(index, first), size)
            ids = np.where(hit, self.made[at], ids)
            stay = ~over & ~np.append(False, hit[:-1])
            ids, word = ids[stay], word[stay]
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(raw))

    def pieces(self, text: str) -> list[str]:
        """Words of a normalised text; special strings stand for themselves."""
        if self.split and any(s in text for s in self.special):
            out = []
            for part in self.split.split(text):
                out += [part] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        # Lower-casing goes character by character, so a capital sigma never becomes a final one.
        # Words don't depend on how much white space parts them, so it needn't be folded.
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if HAS_LOWER.search(text):
                text = text.translate(LOWER)
        text = text.lower()
        return (PIECES if HIGH.search(text) else LOW_PIECES).findall(text)

    def learn(self, words: set[str]) -> None:
        """Add words to the tables of those met before."""
        new = {w for w in words if w not in self.number}
        if len(self.number) + len(new) > KNOWN_WORDS:
            self.forget()
            new = words
        plain, marks = [w for w in new if w not in self.special], [w for w in new if w in self.special]
        ids, size = self.merge(plain) if plain else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.number.update(zip(plain + marks, range(len(self.number), len(self.number) + len(new))))
        self.size = np.concatenate((self.size, size, np.ones(len(marks), np.int64)))
        self.pool = np.concatenate((self.pool, ids, np.array([self.special[w] for w in marks], np.int64)))
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))

    def batches(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Each text's ids, in order."""
        group, chars = [], 0
        for k, t in enumerate(texts):
            group.append(self.pieces(t or ""))
            chars += len(t or "")
            if chars >= BATCH_CHARS or k + 1 == len(texts):
                self.learn(set().union(*group))
                sizes = np.fromiter(map(len, group), np.int64, len(group))
                at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(group)), np.int64, int(sizes.sum()))
                size = self.size[at]
                ends = np.cumsum(size)
                ids = self.pool[np.repeat(self.start[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
                yield from np.split(ids, np.append(0, ends)[np.cumsum(sizes)[:-1]])
                group, chars = [], 0

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [ids.tolist() for ids in self.batches(texts)]


def read_spec(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def bpe_encode(docs: DataFrame, tokenizer_path: str, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row, in any order.

    ``ids_sha256`` digests the decimal ids joined by one space, ``decoded_sha256`` the decoded text; with
    ``keep_text`` the columns ``ids`` (array) and ``decoded`` follow. Whole texts are encoded without adding special
    tokens; null is empty and gives no ids and an empty decoded text. Ids may be null or repeated; an empty table
    gives an empty result. The tokenizer file is read on the driver and sent once to each executor (a few MB).
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_text

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(spec.value)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for frame in frames:
            rows: list[tuple] = []
            for ids in map(np.ndarray.tolist, bpe.batches(frame.column(1).to_pylist())):
                text = bpe.decode(ids)
                rows.append((len(ids), sha(" ".join(map(bpe.decimals.__getitem__, ids))), sha(text)) + (ids, text) * keep_text)
            cols = list(zip(*rows)) or [()] * (3 + 2 * keep_text)
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], [f.split(" ")[0] for f in schema.split(", ")])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
