"""The whole pipeline against plain Python over the same documents."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline as P
from tabforge.llm.queries import tokenizer_path
from tabforge.llm.toxicity import train

SF = "/root/testdata/sf0.001"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fm = train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    def toxic(t):
        found = {xxhash.xxh64_intdigest(w.lower(), 42) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())}
        own = [k for k, h in enumerate(fm.terms.view(np.uint64).tolist()) if h in found]
        raw = fm.bias + sum(fm.weights[k] for k in own) + sum(fm.vectors[a] @ fm.vectors[b] for a, b in combinations(own, 2))
        return 1 / (1 + np.exp(-raw)) >= 0.7
    text = {i: t for i, t in text.items() if not toxic(t)}

    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in text.items():
        for x in t.split("\n"):
            holders[key(x)].add(i)
    gone = lambda i, x: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i
    text = {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in text.items()}

    prints = {}
    for i, t in text.items():
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in text}
    for _ in range(10):  # repeated passes over all links
        for a, b in combinations(sorted(text), 2):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[a] = root[b] = min(root[a], root[b])
    text = {i: t for i, t in text.items() if root[i] == i}

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    grams = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"] or "")
        grams |= {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(g) for g in grams}
    dirty = lambda w: any(tuple(w[k:k + n]) in grams for n in sizes for k in range(len(w) - n + 1))
    text = {i: t for i, t in text.items() if not dirty(words(t))}

    lib, sha = Tokenizer.from_file(tokenizer_path()), lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = set()
    for i, t in text.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        expected.add((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in P.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert len(got) == len(set(got)) and set(got) == expected
