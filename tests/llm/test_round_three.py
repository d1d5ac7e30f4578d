"""Document fingerprints, cross-tokenizer alignment and hard negatives against brute force."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabforge.llm import hard_negatives as H
from tabforge.llm import token_align as T
from tabforge.llm.merkle import fingerprint_edits, with_next
from tabforge.llm.queries import tokenizer_path


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def corpus():
    rng = random.Random(11)
    vocab = ["thation", "Éto", "ke", "Run", "ß", "the", "42", "naïve", "x=1;", "語の", "🙂", "<|endoftext|>", "</s>", "<0x41>", "don't"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    out = [None, "", " ", "   \n\t ", "a", "a ", " a", "one\n\ntwo\n \nthree", "x" * 300, "語" * 200, "ab▁c d", "nul\x00 and\x01 mark \x01\x02 here",
           "tab\there  two  blanks \n\n  end \n", " nbsp \x1c.", "ﬁ é ́x", say(4000) + "\n" + say(3000), "<s> </s> <unk>"]
    out += ["\n".join(say(rng.randint(0, 40)) + rng.choice([".", "", " ", "!\n"]) for _ in range(rng.randint(1, 9))) for _ in range(25)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0x7F), rng.randint(0xA0, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(80)) for _ in range(20)]
    return out + [out[15], out[20], out[20], out[20] + " "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t) for i, t in enumerate(corpus())] + [(None, "no id"), (None, None)]
    extra = "text_hash string, key string, next_text string, edited string, o_root string, b int, g int, pair long, n_a long, copies long"
    full = [r + ("k",) * 5 + (1,) * 5 for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, " + extra).repartition(5).cache()


def listed(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# Document fingerprints -----------------------------------------------------------------------------
@pytest.mark.parametrize("n_buckets", [1, 7, None])
def test_next(docs, n_buckets):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.where("doc_id is not null").collect()))
    want = [(i, t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows)]
    assert listed(with_next(docs.where("doc_id is not null"), n_buckets), "doc_id", "text", "next_text") == sorted(want, key=str)
    got = with_next(docs, n_buckets).collect()  # null ids come first: each text is the next one of exactly one row
    assert Counter(r["text"] for r in got) == Counter(r["next_text"] for r in got)
    assert {r["next_text"] for r in got if r["doc_id"] == rows[-1][0]} <= {"no id", ""}


def test_next_of_ties_and_few_rows(spark, docs):
    one = spark.createDataFrame([(5, "alone")], "doc_id long, text string")
    assert listed(with_next(one), "doc_id", "text", "next_text") == [(5, "alone", "alone")]
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "c"), (2, None)]
    got = with_next(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert Counter(r["text"] for r in got) == Counter(r["next_text"] for r in got) == Counter(["a", "b", "b", "c", ""])
    assert {r["next_text"] for r in got if r["doc_id"] == 2} & {"a", "b"}
    assert fingerprint_edits(docs.where("false")).count() == 0


def test_fingerprints(docs):
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.where("doc_id is not null").collect())
    got = {r["doc_id"]: r for r in fingerprint_edits(docs.where("doc_id is not null")).collect()}
    assert len(got) == len(rows)
    roots = {}
    for k, (i, t) in enumerate(rows):
        n, r = rows[(k + 1) % len(rows)][1], got[i]
        q = len(t) // 4
        edited = t[:len(t) - q] + n[:q]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        roots.setdefault(t, set()).add(r["fingerprint"])
        roots.setdefault(edited, set()).add(r["edited_fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["near_edited"] == 1) >= (t == edited) and (r["near_next"] == 1) >= (t == n)
        if t == edited:
            assert r["edit_from"] is None
        else:  # the first differing phrase starts where both texts are still equal, and holds the first difference
            at = next((j for j, (x, y) in enumerate(zip(t, edited)) if x != y), min(len(t), len(edited)))
            assert r["edit_from"] <= at and t[:r["edit_from"]] == edited[:r["edit_from"]]
        assert (t == "" or n == "") <= (r["near_next"] == float(t == n))
    assert all(len(v) == 1 for v in roots.values())
    assert len({next(iter(v)) for v in roots.values()}) == len(roots)
    long = got[15 * 3]
    assert 0.6 < long["near_edited"] < 0.9 and long["near_next"] < 0.5


def test_edit_is_located(spark):
    rng = random.Random(3)
    lines = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 5) for _ in range(30)) for _ in range(60)]
    text = "\n".join(lines)
    rows = [(k, text) for k in range(0, 4)] + [(9, "zz " * 3000)]
    got = {r["doc_id"]: r for r in fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cut = len(text) - len(text) // 4
    assert cut - 200 < got[3]["edit_from"] <= cut and 0.5 < got[3]["near_edited"] < 0.95 and got[3]["near_next"] < 0.1
    assert got[0]["near_next"] == 1 and got[0]["fingerprint"] == got[1]["fingerprint"]


# Cross-tokenizer alignment -------------------------------------------------------------------------
A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def aligned(text, a, b, chars):
    """Groups of one text as lists of ids, straight from the definition; none if the bytes differ."""
    if not text:
        return []
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, num_threads=1)
    ta = [bytes(chars[c] for c in a.id_to_token(i)) for i in ia]
    tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    raw = (" " + text).encode()
    if b"".join(ta) != raw or b"".join(tb) != raw:
        return []
    ends = [[sum(map(len, t[:k + 1])) for k in range(len(t))] if len(t) < 500 else None for t in (ta, tb)]
    for k, t in enumerate((ta, tb)):
        if ends[k] is None:
            ends[k], s = [], 0
            for x in t:
                s += len(x)
                ends[k].append(s)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out, last = [], 0
    where = [Counter(), Counter()]
    ids = [{}, {}]
    import bisect
    for side, tokens in ((0, ia), (1, ib)):
        for e, i in zip(ends[side], tokens):
            ids[side].setdefault(bisect.bisect_left(cuts, e), []).append(i)
    assert where and last == 0
    for g in range(len(cuts)):
        out.append((ids[0][g], ids[1][g]))
    return out


def expected(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    from tabforge.llm.bpe import _byte_chars
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    chars = {c: i for i, c in enumerate(_byte_chars())}
    groups = [aligned(t, a, b, chars) for _, t in rows]
    links = [Counter((x, y) for xs, ys in g for x in xs for y in ys) for g in groups]
    count = Counter(p for c in links for p in c)
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (i, _), g, c in zip(rows, groups, links):
        written = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()),
                    sum(n for p, n in c.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in c.items()), sha(written) if g else ""))
    return out


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("head", [0, 200, T.HEAD_PAIRS])
def test_alignment(docs, head):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = expected(rows)
    assert listed(T.token_alignment(docs, A, B, head_pairs=head), *ALIGNED) == sorted(want, key=str)
    assert any(w[1] for w in want) and sum(1 for w in want if not w[1]) > 3


def test_alignment_on_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert listed(T.token_alignment(d, A, B), *ALIGNED) == sorted(expected(rows), key=str)


def test_alignment_of_nothing(spark, docs, monkeypatch):
    assert T.token_alignment(docs.where("false"), A, B).count() == 0
    got = T.token_alignment(docs.where("coalesce(text, '') = ''"), A, B)
    assert {tuple(r)[1:] for r in got.collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_aligned_groups_come_out(docs):
    got = T.aligned_texts(docs, A, B, keep_groups=True)
    assert got.where("n_a > 0 and groups_sha256 <> sha2(groups, 256)").count() == 0
    assert got.where("n_groups > 0 and size(split(groups, ';')) <> n_groups").count() == 0
    assert got.where("aggregate(transform(often, x -> cast(x as long)), 0L, (s, x) -> s + x) <> n_links").count() == 0


# Hard negatives ------------------------------------------------------------------------------------
MINED = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(rows, every=100):
    usable = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for i, label, v in dict.fromkeys(r for r in usable if r[0] % every == 0):
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in usable if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            ps = -s
            rest = [x for x in scored if x[2] != label and 30 * ps <= -100 * x[0] <= 90 * ps][:10]
            out += [(i, j, k + 1, x[1], ps, -x[0]) for k, x in enumerate(rest)]
    return sorted(out, key=str)


def vectors(n, dims=20, size=1.0, seed=1):
    rng = random.Random(seed)
    import struct
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    rows = [(i, [f32(rng.gauss(0, size)) for _ in range(dims)], rng.randrange(10)) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.5] * dims, None), (None, [0.5] * dims, 2), (n + 2, [float("nan")] * dims, 3), (n + 3, [1.0, None], 3),
             (n + 4, [float("inf")] + [0.0] * (dims - 1), 3), (n + 5, [], 4), (n + 6, [2.0, 1.0], 5), (100, rows[100][1], rows[100][2])]
    rows += [(n + 10 + k, rows[200][1], rows[200][2]) for k in range(60)]  # copies of an anchor: ties by id
    rows += [(n + 100 + k, rows[200][1], (rows[200][2] + 1) % 10) for k in range(60)]
    return rows


V = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("dims,size,block", [(20, 1.0, H.BLOCK_ITEMS), (130, 0.1, 260), (5, 3000.0, 5)])
def test_hard_negatives(spark, dims, size, block):
    rows = vectors(400, dims, size)
    df = spark.createDataFrame(rows, V).withColumn("rid", F.lit("x")).withColumn("q", F.lit(1)).withColumn("block", F.lit(2)).repartition(6)
    got = listed(H.hard_negatives(df, block_items=block), *MINED)
    assert got == mined(rows) and len(got) > 50


def test_hard_negatives_of_little(spark):
    df = spark.createDataFrame(vectors(210), V)
    assert H.hard_negatives(df.where("false")).count() == 0
    assert H.hard_negatives(df.where("vec_id % 100 <> 0")).count() == 0
    assert H.hard_negatives(df.where("vec_id = 100")).count() == 0
    assert H.hard_negatives(df.where("vec_id is null or label is null or embedding is null")).count() == 0
    with pytest.raises(ValueError):
        H.hard_negatives(spark.createDataFrame([(0, [1e9], 1), (1, [1e9], 1)], V))


def test_exact_residues():
    import numpy as np
    rng = np.random.default_rng(0)
    for top, dims in ((3, 1), (500, 64), (100000, 200), (90_000_000, 64)):
        a, b = (rng.integers(-top, top + 1, (n, dims)) for n in (7, 9))
        a[0], b[0], b[1] = top, top, -top
        primes = H.primes_for(dims * top * top)
        assert (H.Scorer(b, primes).scores(a) == a @ b.T).all()
