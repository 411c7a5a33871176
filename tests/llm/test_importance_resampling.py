import hashlib
import math
import re
import zlib

import numpy as np

from framelode.llm import importance_resampling as ir

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=2):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=25, min_words=20, buckets=10_000, longest=2):
    s, t = [0] * buckets, [0] * buckets
    read = []
    for i, text in docs:
        w, f = features(text, longest)
        b = [zlib.crc32(x.encode()) % buckets for x in f]
        read.append((i, len(w), b))
        for x in b:
            s[x] += 1
    for text in target:
        for x in features(text, longest)[1]:
            t[zlib.crc32(x.encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log((t[x] + 1) * (sum(s) + buckets) / ((s[x] + 1) * (sum(t) + buckets)))) for x in range(buckets)]
    out = []
    for i, n, b in read:
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0], x[2]))
    draw = percent * len(able) // 100
    ranked = [(x[0], *x[2:], k + 1 if k < draw else None) for k, x in enumerate(able)]
    return sorted(((x[0], *x[2:], None) for x in out if x[1] < min_words), key=repr), sorted(ranked, key=repr)


def check(spark, docs, target, **more):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, buckets string").repartition(3)
    aim = spark.createDataFrame([(t, 2) for t in target], "text string, rank int")
    got = [tuple(r) for r in ir.resample(df, aim, **more).collect()]
    low, ranked = brute(docs, target, **more)
    assert sorted(got, key=repr) == sorted([*low, *ranked], key=repr)
    return got


def words(rng, n):
    return " ".join(f"W{int(x)}" for x in rng.zipf(1.4, n) % 300)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    docs = [(i, words(rng, int(rng.integers(1, 80)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "...!"), (403, "één Éé ß 123-abc"), (404, words(rng, 30_000)), (None, words(rng, 40)), (None, None)]
    got = check(spark, docs, [words(rng, 200), None, "", "w1 w2 w3"])
    assert sum(r[4] is not None for r in got) > 40
    check(spark, docs, ["w1 w1 w1 w2"], percent=60, min_words=2, buckets=97, longest=3)


def test_ties_and_copies_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(ir, "RUN", 4)
    rng = np.random.default_rng(2)
    text = words(rng, 30)
    docs = [(7, text)] * 50 + [(7, text + " extra")] * 3 + [(i, words(rng, 25)) for i in range(60)] + [(8, text), (8, text)]
    got = check(spark, docs, [text], percent=70)
    ranks = sorted(r[4] for r in got if r[4] is not None)
    assert ranks == list(range(1, 70 * len(docs) // 100 + 1))
    check(spark, docs, [text], percent=100)
    check(spark, docs, [], percent=0)


def test_empty_tables(spark):
    assert check(spark, [], ["w1 w2"]) == []
    got = {r[0]: r for r in check(spark, [(1, None), (2, "a b")], [])}
    assert got[1][1:3] == (0, 0) and got[2][1] == 3 and got[2][2] < 0 and got[1][4] is got[2][4] is None


def test_only_as_many_rows_in_a_score_as_ids(spark):
    # scores lie in a range that the size of the corpus doesn't widen: the histogram stays small
    rng = np.random.default_rng(3)
    docs = [(i, words(rng, 25)) for i in range(500)]
    got = check(spark, docs, [words(rng, 100)])
    assert max(r[3] for r in got) - min(r[3] for r in got) < 40_000
