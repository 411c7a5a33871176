import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from framelode.llm import lm_scoring as lm

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute(rows, train):
    seq = [[b"\0S", *WORDS.findall((t or "").encode().translate(LOWER)), b"\0E"] for _, t in rows]
    seen = collections.Counter()
    for (d, _), s in zip(rows, seq, strict=True):
        if train(d):
            seen.update(tuple(s[i - k + 1 : i + 1]) for i in range(1, len(s)) for k in (1, 2, 3) if i - k + 1 >= 0)
    n, v, texts = sum(c for k, c in seen.items() if len(k) == 1), sum(len(k) == 1 for k in seen), sum(train(d) for d, _ in rows)
    out = []
    for (d, _), s in zip(rows, seq, strict=True):
        score = base = known = 0
        for i in range(1, len(s)):
            c = seen[(s[i],)]
            known += c > 0
            base += math.log10((c + 1) / (n + v + 1))
            p = (c - lm.DISCOUNT) / n if c else lm.DISCOUNT * v / n
            p = (seen[tuple(s[i - 1 : i + 1])] + lm.STRENGTHS[0] * p) / ((texts if i == 1 else seen[(s[i - 1],)]) + lm.STRENGTHS[0])
            if i > 1:
                p = (seen[tuple(s[i - 2 : i + 1])] + lm.STRENGTHS[1] * p) / (seen[tuple(s[i - 2 : i])] + lm.STRENGTHS[1])
            score += math.log10(p)
        out.append((d, len(s) - 1, known, n, base, score))
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, lambda d: zlib.crc32(str(d).encode()) % 7 != 2)
    got = {r.doc_id: r for r in lm.op4_lm_scoring(spark, sf).collect()}
    for d, n, known, total, base, score in want:
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(d).encode()) % 7 == 2)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "x"), (None, "a a a", "x"), (3, " \t\n", None), (4, "b " * 30000, "x")], "doc_id long, text string, score string")
    got = sorted(lm.lm_scores(docs, F.lit(True)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_tokens) for r in got] == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 30001), (None, 4)]
    assert all(math.isfinite(r.score) and r.n_known == r.n_tokens for r in got)
    none = lm.lm_scores(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)
    assert lm.lm_scores(docs.limit(0), F.lit(True)).collect() == []


def test_distribution_sums_to_one(spark):
    words = ["a", "b", "c"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a b c", "b b a", "c a"])], "doc_id long, text string")
    # the next token after "a b", over all known ones, the end and one unknown
    tries = [f"a b {w}" for w in [*words, "zz"]]
    probes = spark.createDataFrame([(100 + i, t) for i, t in enumerate([*tries, "a b"])], "doc_id long, text string")
    out = {r.doc_id: r.score for r in lm.lm_scores(docs.union(probes), F.col("doc_id") < 100).collect()}
    ends = lambda t: 10 ** out[100 + t]
    # p(text) = p(a b w) p(end | b w); take the ends apart by brute force
    want = {d: s for d, *_, s in brute([(r.doc_id, r.text) for r in docs.union(probes).collect()], lambda d: d < 100)}
    assert all(abs(out[d] - want[d]) < 1e-9 for d in out) and ends(0) > 0


def test_many_shards_and_runs_of_long_texts(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice((3, 40, 700))))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, lambda d: d % 3 > 0)
    for run in (1, 7, 512):
        monkeypatch.setattr(lm, "RUN", run)
        got = {r.doc_id: r.score for r in lm.lm_scores(docs, F.col("doc_id") % 3 > 0, shard_bytes=2000).collect()}
        assert all(abs(got[d] - score) < 1e-6 for d, *_, score in want)


def test_states_and_failure_arcs(spark):
    column = pa.array(["a b c", "a b d", "z"])
    shard = lm.Shard(column, 3, 1)
    seen = shard.counts(np.array([True, True, False]))
    total, kinds = 8, 5
    model = lm.Automaton(shard, seen, total, kinds, 2, lm.STRENGTHS, lm.DISCOUNT)
    token = {w: n for w, n in zip("abcd", (shard.which[0][i] for i in (1, 2, 3, 8)), strict=True)}
    state = np.array([1])
    depth = []
    for w in "abc":
        state, score = model.step(state, np.array([token[w]]))
        depth.append((model.fail[state[0]], score[0]))
    # after "a b c" the state is (b, c), which fails to (c), which fails to the empty history
    assert model.fail[depth[-1][0]] == 0 and depth[-1][0] != 0
    chain = model.fail_weight[state[0]] + model.fail_weight[model.fail[state[0]]]
    state, score = model.step(state, np.array([-1]))
    assert state[0] == 0 and abs(score[0] - chain - model.unknown) < 1e-12


def test_a_token_never_shares_its_key_with_a_longer_gram():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 200_000).astype(np.uint64)
    single, longer = lm.dealt(codes, 7, True), lm.dealt(codes, 7, False)
    assert not np.isin(single, longer).any() and ((single >> lm.BITS) == (longer >> lm.BITS)).all()
    keys, which = lm.numbered(np.r_[single[:1000], single[:500]])
    assert (keys == np.unique(single[:1000])).all() and (keys[which] == np.r_[single[:1000], single[:500]]).all()
    assert [len(x) for x in lm.numbered(np.zeros(0, np.uint64))] == [0, 0]


def test_larger_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {r[0]: r[1:] for r in brute(rows, lambda d: zlib.crc32(str(d).encode()) % 7 != 2)}
    for r in lm.op4_lm_scoring(spark, sf).collect():
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-7, abs_tol=1e-6)
