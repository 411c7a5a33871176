import math

import numpy as np
import pytest

from framelode.llm import hard_negatives as hn
from framelode.llm import topk_search as tk
from framelode.llm import vectorblocks as vb
from framelode.llm.queries import ORACLES, QUERIES
from tests import oracle

SF = "/root/testdata/sf0.01"


def usable(rows):
    """id -> (smallest vector, label) as integers, of the rows that take part."""
    out = {}
    for i, v, *label in rows:
        if i is not None and v is not None and None not in label and None not in v and all(map(math.isfinite, v)):
            out[i] = min(out.get(i, (list(v), *label)), (list(v), *label))
    return {i: ([math.floor(256 * x) for x in v], *label) for i, (v, *label) in out.items()}


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def brute_topk(rows, every, k):
    v = {i: x[0] for i, x in usable(rows).items()}
    out = set()
    for q in v:
        if q % every == 0:
            order = sorted((-product(v[q], v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(order[:k])}
    return out


def brute_negatives(rows, every, p, n, percent):
    v = usable(rows)
    out = set()
    for a in v:
        if a % every == 0:
            score = {c: product(v[a][0], v[c][0]) for c in v if c != a and len(v[c][0]) == len(v[a][0])}
            liked = sorted((-s, c) for c, s in score.items() if v[c][1] == v[a][1])[:p]
            for high, c in ((-s, c) for s, c in liked):
                hard = sorted((-s, o) for o, s in score.items() if v[o][1] != v[a][1] and percent * high <= 100 * s <= 100 * high)[:n]
                out |= {(a, c, r + 1, o, high, -s) for r, (s, o) in enumerate(hard)}
    return out


def made(seed, n, dim, spread=0.3):
    """Vectors around a few centres, a third of them copies of one, some equal up to their ids."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = [(i, [float(x) for x in centres[i % 6] + spread * rng.normal(size=dim)], int(rng.integers(0, 4))) for i in range(n)]
    hot = rows[0][1]
    return [(i, hot if i % 3 == 1 else v, lab) for i, v, lab in rows]


def topk(df, **more):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in tk.topk_search(df, **more).collect()}


def mined(df, **more):
    return {(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in hn.hard_negatives(df, **more).collect()}


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_topk_search", "op13_importance_resampling"])
def test_equal_to_sql(spark, name):
    oracle.check(spark, SF, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("dim", [1, 5, 16, 70])
def test_topk_equals_brute_force_with_many_blocks(spark, monkeypatch, dim):
    monkeypatch.setattr(vb, "BLOCK_VALUES", 40 * dim)
    monkeypatch.setattr(vb, "ASK", 7)
    monkeypatch.setattr(vb, "OFFER", 23)
    monkeypatch.setattr(tk, "SEEDS", 16)
    rows = made(dim, 400, dim)
    df = spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<double>").repartition(5)
    assert topk(df, every=4, k=3) == brute_topk([r[:2] for r in rows], 4, 3)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    a, b = np.floor(256 * rng.normal(size=(50, 64)) + 300 * rng.normal(size=(50, 1))), np.floor(256 * rng.normal(size=(800, 64)) + 300 * rng.normal(size=(800, 1)))
    exact = vb.products(a, b)
    last = None
    for s in tk.levels(64):
        bound = tk.statistics(a, s) @ tk.statistics(b, s).T
        assert (bound >= exact - 1e-6).all()
        assert last is None or (bound <= last + 1e-6 * np.abs(last)).all()
        last = bound
    kth = np.partition(exact, -5, axis=1)[:, -5].astype(float)
    q, _ = tk.survivors([tk.statistics(a, s) for s in tk.levels(64)], [tk.statistics(b, s) for s in tk.levels(64)], kth, np.ones(exact.shape, bool))
    assert 5 * len(a) <= len(q) < 0.5 * exact.size


def test_negatives_equal_brute_force_with_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vb, "BLOCK_VALUES", 30 * 12)
    monkeypatch.setattr(vb, "ASK", 5)
    monkeypatch.setattr(vb, "OFFER", 13)
    monkeypatch.setattr(hn, "WAVE", 1)
    rows = made(5, 450, 12)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    want = brute_negatives(rows, 9, 3, 2, 80)
    assert len(want) > 50
    assert mined(df, every=9, n_positives=3, n_negatives=2) == want


def test_lists_outside_the_windows_are_skipped(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in 3 * np.eye(8)[i % 8] + 0.01 * rng.normal(size=8)], i % 3) for i in range(1600)]
    listed, lists = hn.inverted_lists(vb.integer_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", hn.F.col("label")))
    assert listed.count() == 1600
    m = np.floor(256 * np.array([r[1] for r in rows[:8]]))
    clusters, lower, upper = lists.bounds(m)
    members = {}
    for r in listed.collect():
        members.setdefault(r.cluster, []).append(np.floor(256 * np.array(r.embedding)))
    for j, c in enumerate(clusters):
        s = m @ np.array(members[c]).T
        assert (s <= upper[:, [j]]).all() and (s >= lower[:, [j]]).all()
    own = m @ m[0] >= 0.8 * (m[0] @ m[0])
    assert (upper[0] < 0.8 * (m[0] @ m[0])).mean() > 0.5 and own.sum() == 1


def test_percent_of_negative_scores():
    assert hn.lowest(np.array([100, 101, 0, -10, 1, -1]), 80).tolist() == [80, 81, 0, -8, 1, 0]


def test_edge_rows(spark):
    v = [1.0, -2.0, 3.0]
    rows = [(0, v, 1), (2, None, 1), (4, [1.0, None, 3.0], 1), (6, [1.0, math.nan, 3.0], 1), (8, [1.0, math.inf, 3.0], 1), (10, v, 1), (12, v, None), (14, v, 2), (14, v, 2), (16, [0.5, 0.5, 0.5], 2), (16, v, 2), (18, v[:2], 1), (20, v[:2], 2), (22, [], 1), (24, [], 3), (None, v, 1), (26, [0.9, -1.9, 2.9], 3), (28, [1e-9, 1e-9, 1e-9], 1)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, label int, rank int, block string")
    assert mined(df, every=2) == brute_negatives(rows, 2, 5, 5, 80)
    whole = [r[:2] for r in rows]
    assert topk(df, every=2) == brute_topk(whole, 2, 5)
    # the same table with other ids leaves no query, an empty one no row
    assert topk(df, every=1000) == {x for x in brute_topk(whole, 1000, 5)}
    assert topk(df.limit(0)) == set() and mined(df.limit(0)) == set()


def test_large_components(spark):
    rows = [(i, [float(2**19 - i), float(-i), 1e-3], i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert topk(df, every=3) == brute_topk([r[:2] for r in rows], 3, 5)
    assert mined(df, every=3) == brute_negatives(rows, 3, 5, 5, 80)
    with pytest.raises(Exception, match="56 bits"):
        tk.topk_search(spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>")).collect()
