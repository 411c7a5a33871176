import hashlib
import random
import re

from framelode.llm.substring_dedup import op1_substring_dedup, substring_dedup

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    seen, out = set(), []
    for d, t in sorted(rows):
        words = WORDS.findall((t or "").encode())
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append((d, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def run(docs, window=20):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.text.encode()) for r in substring_dedup(docs, window).collect())


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, gone, hashlib.sha256(kept).hexdigest()) for d, n, gone, kept in brute(rows)]
    assert sorted(map(tuple, op1_substring_dedup(spark, sf).collect())) == want
    assert any(gone for _, _, gone, _ in want)


def test_random_texts_and_windows(spark):
    rng = random.Random(3)
    for window in (2, 5, 7, 20):
        rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(80)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert run(docs, window) == brute(rows, window)


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \x0b\t"), (4, long), (5, "x " + long), (6, "é ß " * 25)]
    docs = spark.createDataFrame([(*r, "s", 7) for r in [*rows, (4, long), (None, long)]], "doc_id long, text string, n_words string, at int")
    assert run(docs) == brute(rows)
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in substring_dedup(docs).collect()}
    assert spans[5] == [(1, 30001)] and spans[4] == [] and spans[1] == []
    assert substring_dedup(docs.limit(0)).collect() == []
    # of rows with one id the smallest text stands
    two = spark.createDataFrame([(1, "b"), (1, "a")], "doc_id long, text string")
    assert run(two) == [(1, 1, 0, b"a")]


def test_blocks_of_a_longer_text_under_the_same_id_lie_beyond_the_smaller_one(spark):
    text = " ".join(f"v{i}" for i in range(400))
    rows = [(1, "a b"), (2, text)]
    two = spark.createDataFrame([*rows, (1, text)], "doc_id long, text string")
    assert run(two.coalesce(1)) == brute(rows)
