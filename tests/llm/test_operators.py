"""Every operator on small fixtures against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.llm.bpe import WordBpe, bpe_encode, read_spec
from tabforge.llm.components import connected_components
from tabforge.llm.decontam import contaminated
from tabforge.llm.exact_dedup import exact_dedup
from tabforge.llm.license_scan import license_scan
from tabforge.llm.line_dedup import line_dedup
from tabforge.llm.pii import PATTERNS, pseudonymise
from tabforge.llm.queries import tokenizer_path
from tabforge.llm.simhash import fingerprint, links, simhash_dedup
from tabforge.llm.suffix_dedup import remove_repeats
from tabforge.llm.token_count import DTYPE, END_ID, count_tokens, write_token_files
from tabforge.llm.toxicity import fit_machine, score, train

EXTRA = ["id", "th", "pos", "h1", "n", "keep", "text_hash", "score", "predicted", "kept_text", "n_lines", "kinds", "fp", "name"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def texts():
    rng = random.Random(5)
    vocab = [f"{a}{b}" for a in ("wa", "Éto", "ke", "Run", "ß") for b in ("", "li", "Mo", "né", "7")]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, line = say(40), "A line that Many documents hold, " + say(5)
    out = [None, "", "   \n\t ", "a", "Same text here", "Same  text\nhere", "x" * 300, "ab" * 400, say(3000)]
    out += [say(rng.randint(1, 120)) + ". " + (shared if k % 3 == 0 else "") + "\n" + ("  " + line.upper() if k % 4 == 0 else line) +
            "\n" + say(rng.randint(0, 30)) for k in range(14)]
    out += [out[-1], out[-1], out[8], out[9] + " tail"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(None, "no id " + texts()[9]), (None, None), rows[10], rows[10], (3, "other text of a repeated id")]
    full = [(i, t, "en", "s", len(t or "")) + tuple(EXTRA) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def same(got, expected, cols):
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key) == sorted(expected, key=key)


def test_decontamination(spark, docs, rows, empty):
    t = texts()
    items = [(1, " ".join(t[9].split()[:25])), (2, "Wa li"), (3, None), (4, "..."), (None, " ".join(t[11].split()[:12])),
             (5, " ".join(t[9].split()[:25]).upper()), (5, "nowhere to be found at all in any of these texts my friend")]
    wins = defaultdict(set)
    for i, x in items:
        w = words(x)
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            wins[tuple(w[j:j + k])].add(i)
    expected = []
    for i, x in rows:
        w, hit, found = words(x), set(), set()
        for k in {len(v) for v in wins}:
            for j in range(len(w) - k + 1):
                if tuple(w[j:j + k]) in wins:
                    hit |= set(range(j, j + k))
                    found |= wins[tuple(w[j:j + k])] - {None}
        expected.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    same(contaminated(docs, bench), expected, cols)
    assert any(e[2] for e in expected) and not all(e[2] for e in expected)
    same(contaminated(docs, bench.where("false")), [(i, len(words(x)), 0, 0, sha(""), False) for i, x in rows], cols)
    assert contaminated(empty, bench).count() == 0


def test_long_windows_are_not_broadcast(spark, monkeypatch):
    from tabforge.llm import decontam
    hinted, small = [], decontam.small

    def spy(df, *args, **kw):
        out = small(df, *args, **kw)
        if "win" in df.columns:
            hinted.append("Hint" in out._jdf.queryExecution().analyzed().toString())
        return out
    monkeypatch.setattr(decontam, "small", spy)
    for size, broadcast in ((300000, False), (3, True)):  # windows of 9 MB, and of 100 bytes
        text = " ".join("语" * size + c for c in "éèêëíìîïóòôö")
        docs = spark.createDataFrame([(1, "see " + text), (2, "clean")], "doc_id long, text string")
        got = decontam.contaminated(docs, spark.createDataFrame([(1, text)], "item_id long, text string"))
        assert {(r["doc_id"], r["n_hit"], r["n_items"]) for r in got.collect()} == {(1, 12, 1), (2, 0, 0)}
        assert hinted == [broadcast] * 2
        hinted.clear()


def test_suffix_dedup(docs, rows, empty):
    # Rows of one id and text are one document; the null id comes first.
    order = sorted({(i, x or "") for i, x in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    by_id = defaultdict(list)
    for i, x in order:
        by_id[i].append(x)
    got = {(r["doc_id"], r["n_bytes"], r["kept_sha256"], r["n_removed"], r["n_spans"]) for r in remove_repeats(docs).collect()}
    assert remove_repeats(docs).count() == len(rows)
    assert got == brute_suffix([(i, x) for i, x in order if len(by_id[i]) == 1 or True], docs)
    assert remove_repeats(empty).count() == 0


def test_suffix_dedup_splits_hot_grams(spark, monkeypatch):
    from tabforge.llm import suffix_dedup
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = say(400)
    rows = [(i, say(90) + passage + say(90) + ("x" * (150 + i % 7) if i % 3 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 10)
    hot = suffix_dedup.hot_grams(docs.select(F.col("doc_id").alias("id"), "text"), 100)
    assert hot.count() > 3
    one = hot.select("gram").first()[0]
    dealt = suffix_dedup.shared_out(spark.range(4000).select(F.lit(one).alias("gram"), "id", F.lit(7).alias("place")), hot, "id", "place")
    assert dealt.groupBy("share").count().agg(F.max("count")).first()[0] < 60
    got = {(r["doc_id"], r["n_bytes"], r["kept_sha256"], r["n_removed"], r["n_spans"]) for r in remove_repeats(docs).collect()}
    assert got == brute_suffix(rows, docs) and sum(g[3] for g in got) > 59 * 400


def brute_suffix(order, docs):
    hashes = {(r["doc_id"], r["text"]): r["th"] for r in docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()}
    order = sorted(order, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r]))
    seen, out = set(), set()
    for i, x in order:
        b = x.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k:k + 100] in seen:
                gone[k:k + 100] = b"\1" * 100
            seen.add(b[k:k + 100])
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.add((i, len(b), sha(bytes(c for c, g in zip(b, gone) if not g)), sum(gone), spans))
    return out


def test_token_files(spark, docs, rows, tmp_path):
    path = str(tmp_path / "tokens")
    write_token_files(docs, tokenizer_path(), path)
    bpe = WordBpe(read_spec(tokenizer_path()))
    expected = sorted(map(len, bpe.encode([x for _, x in rows])))
    for limit in (256 << 20, 64):  # whole files, and files read in records
        got = count_tokens(spark, path, block_tokens=50, max_file_bytes=limit).collect()
        assert sorted(r["n_tokens"] for r in got) == expected
    flat = str(tmp_path / "flat")
    (tmp_path / "flat").mkdir()
    np.array([END_ID, 5, 6, END_ID, END_ID, 7], DTYPE).tofile(flat + "/a.bin")
    np.array([], DTYPE).tofile(flat + "/b.bin")
    for block in (1, 2, 3, 100):
        got = sorted((r["doc_no"], r["first_token"], r["n_tokens"]) for r in count_tokens(spark, flat, block_tokens=block).collect())
        assert got == [(0, 0, 0), (1, 1, 2), (2, 4, 0), (3, 5, 1)]


def test_pseudonyms(spark, docs, empty):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    values = ["4111 1111 1111 1111", "4111111111111112", "1999-02-28", "1999-02-30", "28.02.1999", "12/31/2001", "123-45-6789",
              "666-45-6789", "10.0.0.255", "10.0.0.256", "+1 (988) 555-2485", "ann.lee+7@mail.example.com", "a@b.co"]
    kinds = ["card", "", "date", "", "date", "date", "ssn", "", "ip", "", "phone", "email", "email"]
    df = spark.createDataFrame([(i, f"see {v}, {v} end") for i, v in enumerate(values)] + [(90, None), (91, ""), (92, "no. 12")],
                               "doc_id long, text string")
    out = {r["doc_id"]: r for r in pseudonymise(df, "k").collect()}
    for i, (v, kind) in enumerate(zip(values, kinds)):
        r, new = out[i], re.fullmatch(r"see (.*), (.*) end", out[i]["text"])
        assert r["kinds"] == kind and r["n_found"] == 2 * bool(kind) and new[1] == new[2]
        assert (new[1] != v) == bool(kind)
        if kind:
            assert re.fullmatch(PATTERNS[kind], new[1])
            assert [c if not c.isalnum() else "" for c in new[1]] == [c if not c.isalnum() else "" for c in v] or kind == "ip"
        if kind == "card":
            assert luhn(re.sub(r"\D", "", new[1]))
    assert out[90]["text"] is None and out[91]["text"] == "" and out[92]["text"] == "no. 12"
    # One to one: every date of some years keeps to different dates.
    days = spark.sql("select id as doc_id, cast(date_add(date'1900-01-01', cast(id * 97 as int)) as string) as text from range(700)")
    assert pseudonymise(days, "k").agg(F.count_distinct("text")).first()[0] == 700
    assert [r["text"] for r in pseudonymise(days, "k").orderBy("doc_id").limit(9).collect()] != [
        r["text"] for r in pseudonymise(days, "other").orderBy("doc_id").limit(9).collect()]
    assert pseudonymise(docs, "k").count() == docs.count() and pseudonymise(empty, "k").count() == 0


def test_no_two_dates_share_a_pseudonym(spark):
    """All days of three years in four forms: as many pseudonyms as different strings, each in the form of its own."""
    df = spark.sql("select explode(array(date_format(d, 'yyyy-MM-dd'), date_format(d, 'dd.MM.yyyy'), date_format(d, 'dd/MM/yyyy'), "
                   "date_format(d, 'MM/dd/yyyy'))) as text from (select date_add(date'1990-01-01', cast(id as int)) as d from range(1096))").distinct()
    got = pseudonymise(df.withColumn("doc_id", F.lit(1)).withColumn("old", F.col("text")), "k").collect()
    assert len({r["text"] for r in got}) == len({r["old"] for r in got}) == len(got)
    assert all(re.sub(r"\d", "0", r["text"]) == re.sub(r"\d", "0", r["old"]) and r["kinds"] == "date" for r in got)
    for r in got:
        if "/" in r["old"]:
            assert (int(r["old"][3:5]) > 12) == (int(r["text"][3:5]) > 12)


def test_feistel_against_plain_python(spark):
    """The cipher written again: halves of the digits, keyed digests of the other half added in turn."""
    from tabforge.llm import pii

    def prf(i, v):
        return int(hashlib.sha256(f"k|phone|{i}|{v}".encode()).hexdigest()[:15], 16)

    def plain(digits):
        n, h = len(digits), len(digits) // 2
        x, y, a, b = int(digits[:h]), int(digits[h:]), 10 ** h, 10 ** (n - h)
        for i in range(1, pii.ROUNDS + 1):
            x = (x + prf(2 * i, y)) % a
            y = (y + prf(2 * i + 1, x)) % b
        return f"{x:0{h}d}{y:0{n - h}d}"
    rng = random.Random(4)
    rows = [("".join(rng.choice("0123456789") for _ in range(rng.randint(2, 18))),) for _ in range(60)]
    got = spark.createDataFrame(rows, "d string").select("d", pii._permute_digits(F.col("d"), F.lit("k"), "phone").alias("p")).collect()
    assert all(r["p"] == plain(r["d"]) for r in got)
    four = spark.range(10000).select(pii._permute_digits(F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("k"), "phone").alias("p"))
    assert four.distinct().count() == 10000


def test_pseudonyms_beside_other_digits(spark):
    card = r"(?:4111[ -]?1111[ -]?1111[ -]?1111)"
    cases = [("4111111111111111 12/27", "card"), ("4111 1111 1111 1111 123", "card"), ("qty 2 4111 1111 1111 1111", "card"),
             ("4111-1111-1111-1111 555-123-4567", "card,phone"), ("7 4111 1111 1111 1111 10.0.0.7 x", "card,ip"),
             ("12 2024-01-15 4111 1111 1111 1111  5", "card,date"), ("4111 1111 1111 1111 77@mail.example.com", "card,email"),
             ("2024-01-15T10:30:00Z", "date"), ("at 28.02.1999T1", "date"), ("2024-01-15Tea", ""), ("x4111111111111111", ""),
             ("4111111111111112 3", ""), ("1 " * 3000 + "4111 1111 1111 1111 3", "card"), ("12 4111111111111111 4111 1111 1111 1111", "card")]
    df = spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pseudonymise(df, "k").collect()}
    for i, (t, kinds) in enumerate(cases):
        new = out[i]["text"]
        # A list of ones may hold stretches that are valid by chance; the card beside it must change all the same.
        assert out[i]["kinds"] == kinds and not (kinds and (re.search(card, new) or "2024-01-15" in new)), (t, new)
        assert (new != t) == bool(kinds) and re.sub("[0-9A-Za-z]", "", new) == re.sub("[0-9A-Za-z]", "", t)
    assert out[0]["text"][16:] == " 12/27" and out[1]["text"][19:] == " 123" and out[2]["text"][:6] == "qty 2 "
    assert out[7]["text"][10:] == "T10:30:00Z" and out[3]["n_found"] == 2
    first, second = re.fullmatch(r"12 (\d{16}) ((?:\d{4} ?){4})", out[13]["text"]).groups()
    assert first == second.replace(" ", "") and out[13]["n_found"] == 2  # linked


def test_pseudonyms_of_telephones(spark):
    cases = [("+44 20 7946 0958", "44", "phone"), ("+33 1 42 68 53 00", "33", "phone"), ("+49 30 123456", "49", "phone"),
             ("+442079460958", "44", "phone"), ("+358 9 1234567", "358", "phone"), ("+49 (30) 123456", "49", "phone"),
             ("+7 (495) 123-45-67", "7", "phone"), ("+52 555 123 4567", "52", "phone"), ("+1 (988) 555-2485", "1", "phone"),
             ("555-123-4567", "", "phone"), ("5551234567", "", ""), ("+44 20 79", "", ""), ("+44x20 7946 0958", "", "")]
    beside = [("+49 30 123456 4111 1111 1111 1111", "card,phone"), ("+49 30 123456 2024-01-15", "date,phone"),
              ("+44 20 7946 0958 555-123-4567", "phone"), ("+49 30 123456 77@mail.example.com", "email,phone"), ("+4111111111111111", "card")]
    rows = [(i, f"call {t}, or {t}.") for i, (t, _, _) in enumerate(cases)] + [(50 + i, t) for i, (t, _) in enumerate(beside)]
    out = {r["doc_id"]: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, (t, code, kind) in enumerate(cases):
        new = re.fullmatch(r"call (.*), or (.*)\.", out[i]["text"])
        assert new[1] == new[2] and out[i]["kinds"] == kind and out[i]["n_found"] == 2 * bool(kind), t
        assert (new[1] != t) == bool(kind) and re.sub(r"\d", "0", new[1]) == re.sub(r"\d", "0", t)
        assert re.sub(r"\D", "", new[1]).startswith(code) and (not kind or re.fullmatch(PATTERNS[kind], new[1]))
    digits = [re.sub(r"\D", "", out[i]["text"]) for i in (0, 3)]
    assert digits[0] == digits[1]  # one number in two forms stays linked
    assert [out[50 + i]["kinds"] for i in range(len(beside))] == [k for _, k in beside]
    assert out[52]["n_found"] == 2 and all(r["text"] != t for i, t in rows for r in [out[i]] if r["kinds"])


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for i, x in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", x or "")].append((-len(x or ""), i is None, i or 0))
    expected = []
    for s, g in groups.items():
        best = min(g)
        expected += [(None if k[1] else k[2], None if best[1] else best[2], len(g), sha(s)) for k in g]
    for block in (7, 2048):
        got = exact_dedup(docs, block_bytes=block)
        same(got, expected, ["doc_id", "keep_id", "group_size", "text_sha256"])
        assert got.where("kept").count() == len(groups)
        assert got.where("kept and not doc_id <=> keep_id").count() == 0
    assert exact_dedup(empty).count() == 0


def test_line_dedup(docs, rows, empty):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, x in rows:
        for one in (x or "").split("\n"):
            holders[key(one)].add(-1 if i is None else i)
    expected = []
    for i, x in rows:
        lines = (x or "").split("\n")
        drop = [len(key(v)) >= 20 and len(holders[key(v)]) >= 3 and max(holders[key(v)]) != (-1 if i is None else i) for v in lines]
        expected.append((i, len(lines), sum(drop), "\n".join(v for v, d in zip(lines, drop) if not d)))
    for batches, fan_in in ((1, 2), (5, 2), (4, 3)):
        got = line_dedup(docs, n_batches=batches, fan_in=fan_in)
        same(got, expected, ["doc_id", "n_lines", "n_dropped", "kept_text"])
    assert set(docs.columns) | {"n_dropped"} == set(got.columns)
    assert any(e[2] for e in expected) and line_dedup(empty).count() == 0


def test_simhash(spark, docs, rows, empty):
    import xxhash

    def slow(t):
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    assert all(fingerprint(x or "") == slow(x) for _, x in rows)
    assert simhash_dedup(docs).where(F.col("fingerprint") != "0").count() == len(rows)
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = {0, (1 << 64) - 1, *seeds}
    for s in seeds:
        for _ in range(12):
            s ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(s)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    near = {(a, b) for k, a in enumerate(fps) for b in fps[k + 1:] if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 2}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = links(df)
    assert {(r["u"], r["v"]) for r in found.collect()} == near and near
    root = brute_components(near)
    assert {r["node"]: r["root"] for r in connected_components(found).collect()} == root
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(50, 50), (60, 61), (61, 60)], "u long, v long")
    assert {r["node"]: r["root"] for r in connected_components(chain).collect()} == {k: 0 for k in range(41)} | {60: 60, 61: 60}
    assert connected_components(chain.where("false")).count() == 0 and simhash_dedup(empty).count() == 0
    own = [(i, slow(x)) for i, x in rows]
    pairs = {(a, b) for _, a in own for _, b in own if a < b and bin(a ^ b).count("1") <= 2}
    root = brute_components(pairs)
    first = defaultdict(list)
    for i, f in own:
        first[root.get(f, f)] += [i] if i is not None else []
    same(simhash_dedup(docs), [(i, f"{f:016x}", min(first[root.get(f, f)], default=None)) for i, f in own],
         ["doc_id", "fingerprint", "component_id"])


def brute_components(pairs):
    root = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def test_license_scan(spark, docs, rows, empty):
    more = [(100, "Licensed under the Apache License, Version 2.0. apache   LICENSE"), (101, "Released under the MIT License."),
            (102, "we say: Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and "
                  "associated documentation files to deal in the Software without restriction at all"),
            (103, "Licensed under CC BY-NC 4.0."), (104, "This work is licensed under the GNU General Public License, version 3."),
            (105, "the version of charge"), (106, "mit\nlicense")]
    wide = docs.select("doc_id", "text", "id", "th").unionByName(
        spark.createDataFrame([(i, x, "a", "b") for i, x in more], "doc_id long, text string, id string, th string"))
    got = license_scan(wide)
    same(got, brute_phrases(rows + more), ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"])
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got.where("doc_id >= 100").collect()}
    assert labels == {100: ("apache,apache-2.0", 1.0), 101: ("mit", 1.0), 102: ("mit", labels[102][1]), 103: ("cc-by,cc-by-nc-4.0", 1.0),
                      104: ("gpl,gpl-3.0", 1.0), 105: ("", 0.0), 106: ("mit", 1.0)}
    assert 0.8 <= labels[102][1] <= 1 and license_scan(empty).count() == 0


def brute_phrases(rows):
    phrases = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}
    expected = []
    for i, x in rows:
        w = words(x)
        at = [(k, v) for p, v in phrases.items() for k in range(len(w)) if tuple(w[k:k + len(p)]) == p]
        starts = [k for k, _ in at]
        expected.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({v for _, v in at}))))
    return expected


def test_license_scan_takes_the_closest(spark):
    cc, gnu = "This is licensed under a Creative Commons Attribution{} 4.0 International License, see", (
        "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published "
        "by the Free Software Foundation")
    cases = [(cc.format(""), "cc-by-4.0"), (cc.format("-NonCommercial-NoDerivatives"), "cc-by-nc-nd-4.0"), (cc.format("-ShareAlike"), "cc-by-sa-4.0"),
             (gnu.format("program", ""), "gpl"), (gnu.format("library", "Lesser "), "lgpl"), (gnu.format("program", "Affero "), "agpl"),
             ("Licensed under CC BY-NC-ND 4.0.", "cc-by,cc-by-nc-nd-4.0"), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
             (cc.format("") + " and " + cc.format("-NonCommercial"), "cc-by-4.0,cc-by-nc-4.0"),
             ("licensed under a big Creative Commons of any Attribution so 4.0 so so International License", "")]
    df = spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan(df).collect()} == {i: x for i, (_, x) in enumerate(cases)}


def test_bpe(docs, rows, empty):
    from tokenizers import Tokenizer
    lib, own = Tokenizer.from_file(tokenizer_path()), WordBpe(read_spec(tokenizer_path()))
    rng = random.Random(1)
    parts = ["a", "aa", "Σ", "ΟΔΟΣ'Σ", "İ", "ß", "é", "  ", "\xa0", "\x1c", "\x85", "'s", "'S", "don't", "'LL", "12", "½", "Ⅷ", "Ⓐ", "😀", "!!!",
             "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "​", "漢字", "\n", "zzzz", "hello world", "K", "ﬁ", "\U00010d50", "Ɤ"]
    many = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [x or "" for _, x in rows] + ["a" * 3000]
    expected = lib.encode_batch(many, add_special_tokens=False)
    got = own.encode(many)
    assert got == [e.ids for e in expected]
    assert all(own.decode(g) == lib.decode(g, skip_special_tokens=False) for g in got)
    enc = [(i, lib.encode(x or "", add_special_tokens=False).ids) for i, x in rows]
    same(bpe_encode(docs, tokenizer_path(), keep_text=True),
         [(i, len(e), sha(" ".join(map(str, e))), sha(lib.decode(e, skip_special_tokens=False)), e) for i, e in enc],
         ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
    assert bpe_encode(empty, tokenizer_path()).count() == 0
    own.ordered = False  # the careful path gives the same
    assert own.merge(["aaaaa", "hello", "zzzzzz"])[0].tolist() == WordBpe(read_spec(tokenizer_path())).merge(["aaaaa", "hello", "zzzzzz"])[0].tolist()


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    noise = [f"w{k}" for k in range(60)]
    data = []
    for k in range(900):
        bad = k % 5 == 0
        w = [rng.choice(noise) for _ in range(20)] + (["fool", "them"] if bad else [rng.choice(["fool", "them"])])
        rng.shuffle(w)
        data.append((k, " ".join(w), int(bad)))
    df = spark.createDataFrame(data + [(5000, None, 0), (5001, "", 0), (None, "fool them", 1)], "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    model = train(df.select("doc_id", "text"), labels, epochs=60)
    out = score(df.withColumn("score", F.lit("x")), model)
    assert out.count() == 903 and out.where("score is null or score < 0 or score > 1").count() == 0
    held = out.where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").agg(
        F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert held > 0.97  # either word alone says nothing: only the pair does
    # The pair weights do it: the same fit without factors can't tell 1, 1 from the rest as well.
    rows = [np.array(x) for x in ([0], [1], [0, 1], [])] * 50
    fm = fit_machine(np.arange(2), rows, np.array([1, 1, 0, 0] * 50, float), 2, 200)
    raw = fm.raw(np.array([0, 1, 0, 1]), np.array([1, 1, 2, 0]))
    assert raw[0] > 0 and raw[1] > 0 and raw[2] < 0 and raw[3] < 0
    none = train(df.select("doc_id", "text"), labels.where("false"))
    assert {r["score"] for r in score(docs, none).collect()} == {0.5} and score(empty, model).count() == 0
