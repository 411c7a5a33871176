import collections
import hashlib
import random

import numpy as np

from framelode.llm import suffix_dedup as sd


def brute(rows, length=400):
    texts = {d: (t or "").encode() for d, t in rows}
    seen = collections.Counter(t[s : s + length] for t in texts.values() for s in range(len(t) - length + 1))
    out = []
    for d, t in sorted(texts.items()):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(bool(gone[i]) and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def run(docs):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.data)).hexdigest()) for r in sd.suffix_dedup(docs).collect())


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, sd.op5_suffix_dedup(spark, sf).collect())) == brute(rows)


def test_cut_edited_and_periodic_texts(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(2500)) for _ in range(5)]
    rows = []
    for i in range(120):
        kind = rng.random()
        if kind < 0.15:
            text = "a" * rng.randint(0, 900)
        elif kind < 0.3:
            text = "ab" * rng.randint(0, 400) + "é" * rng.randint(0, 300)
        else:
            text = ""
            for _ in range(rng.randint(1, 3)):
                at = rng.randint(0, 1900)
                text += rng.choice(base)[at : at + rng.randint(300, 600)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 40)))
            at = rng.randint(0, len(text) - 1)
            text = text[:at] + "#" + text[at + 1 :] if rng.random() < 0.4 else text
        rows.append((i, text))
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_edge_rows(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(150_000))
    rows = [(1, None), (2, ""), (3, "x" * 399), (4, long), (5, long[:70_000] + "!" + long[70_000:])]
    docs = spark.createDataFrame([(*r, 1, "s") for r in [*rows, (4, long), (None, long)]], "doc_id long, text string, n int, kind string")
    assert run(docs) == brute(rows)
    assert sd.suffix_dedup(docs.limit(0)).collect() == []


def test_refinement_finds_common_prefixes():
    sequences = [[5, 1, 2], [5, 1, 3], [5, 1, 2], [6], [5], [5, 1, 2, 4]]
    first = np.array([s[0] for s in sequences], np.uint64)
    labels = np.array([x for s in sequences for x in s[1:]], np.uint32)
    block, prefix = sd.refine(first, np.array([len(s) for s in sequences]), labels)
    assert prefix.tolist() == [3, 2, 3, 0, 1, 3]
    whole = [i for i, s in enumerate(sequences) if prefix[i] >= len(s)]
    assert {i for i in whole if block[i] == block[0]} == {0, 2}


def test_a_short_and_a_long_repeated_text_under_one_id(spark):
    text = "".join(f"v{i} " for i in range(900))
    docs = spark.createDataFrame([(3, "a b"), (2, text), (3, text), (1, text[:3000])], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in sd.suffix_dedup(docs).collect()}
    assert got[3] == (3, 0) and got[2] == (len(text), 3000) and got[1] == (3000, 3000)
