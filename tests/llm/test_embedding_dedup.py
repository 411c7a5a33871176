import math

import numpy as np

from framelode.llm import embedding_dedup as ed
from framelode.llm import lattice


def brute(rows, cosine=0.9):
    """(n_links, component) of each id; vectors that can't be compared link with nothing."""
    fine = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and all(map(math.isfinite, v)) and any(v)}
    ids = sorted(fine)
    label = {i: i for i, _ in rows}
    near = {i: [j for j in ids if j != i and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] >= cosine * np.linalg.norm(fine[i]) * np.linalg.norm(fine[j])] for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min([label[i], *(label[j] for j in near[i])])
            changed |= low < label[i]
            label[i] = low
    return {i: (len(near.get(i, ())), label[i]) for i, _ in rows}


def test_decoding_gives_the_nearest_point():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(300, 8)) * 2
    p = lattice.nearest(y)
    assert np.allclose((2 * p) % 1, 0) and np.allclose(p.sum(1) % 2, 0) and len(np.unique(np.rint(2 * lattice.NEIGHBOURS), axis=0)) == 240
    # no neighbour of the point found is nearer
    d = ((y - p) ** 2).sum(1)
    others = ((y[:, None] - (p[:, None] + lattice.NEIGHBOURS[None])) ** 2).sum(2).min(1)
    assert (d <= others + 1e-9).all() and (d <= 1 + 1e-9).all()


def test_recall_and_precision_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 32))
    rows, n = [], 0
    for c, v in enumerate(base):
        for k in range(1 + c % 6):
            noise = rng.normal(size=32) * (0.0 if k == 1 else 0.05 + 0.1 * (c % 5))
            rows.append((n, [float(x) for x in v + noise * (k > 0)]))
            n += 1
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.embedding_dedup(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i][0] <= want[i][0] for i in got)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert all(k == (i == c) for i, (_, c, k) in got.items())


def test_large_cells_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 16)
    rng = np.random.default_rng(3)
    v = rng.normal(size=24)
    rows = [(i, [float(x) for x in v + rng.normal(size=24) * 0.02]) for i in range(90)]
    got = ed.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(89, 0)}


def test_edge_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 3.0]), (4, [1.0, math.nan, 3.0]), (5, [1.0, math.inf, 3.0]), (6, v), (7, v), (8, [2.0, 4.0, 6.0]), (9, v[:2]), (10, [1e-300, 2e-300, 3e-300]), (11, [])]
    docs = spark.createDataFrame([(*r, 1) for r in [*rows, (7, v), (None, v)]], "vec_id long, embedding array<double>, rep int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.embedding_dedup(docs).collect()}
    want = {i: (0, i) for i, _ in rows} | {i: (3, 6) for i in (6, 7, 8, 10)}
    assert got == want
    assert ed.embedding_dedup(docs.limit(0)).collect() == []
