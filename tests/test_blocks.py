"""Number formats, products of blocks, sparse attention: against numpy, bit by bit where bits count."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelode.functions import bits
from framelode.operators import blockproduct as bp
from framelode.operators import sparse

# --- number formats -----------------------------------------------------------------------------------------------

ODD = [0.0, -0.0, 1.0, -1.0, math.inf, -math.inf, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, 0.1, 448.0, 449.0, 464.0, -1e9, 2.0**-9, 2.0**-10, 1.5 * 2.0**-10, 2.0**-11, 3.3895e38, 3.4e38, 1e-40, 2.0**-133, 2.0**-134, 1.0 + 2.0**-8, 1.0 + 3 * 2.0**-8, 1.0 - 2.0**-53]


def numbers():
    rng = np.random.default_rng(1)
    raw = rng.integers(-(2**63), 2**63 - 1, 3000).astype(np.int64).view(np.float64)
    powers = [s * 2.0**e * f for e in range(-1074, 1024, 7) for s in (1, -1) for f in (1.0, 1 - 2.0**-53)]
    return [x for x in [*ODD, *raw[~np.isnan(raw)].tolist(), *rng.normal(0, 300, 2000).tolist(), *powers]]


def test_bits_of_doubles_and_back(spark):
    rows = spark.createDataFrame([(x,) for x in numbers()], "x double").withColumn("b", bits.to_bits(F.col("x")))
    for r in rows.withColumn("y", bits.from_bits(F.col("b"))).collect():
        assert r.b == struct.unpack("!q", struct.pack("!d", r.x))[0] and struct.pack("!d", r.y) == struct.pack("!d", r.x), r
    odd = spark.createDataFrame([(math.nan,), (None,)], "x double").select(bits.to_bits(F.col("x")).alias("b")).collect()
    assert [r.b for r in odd] == [0x7FF8 << 48, None] and math.isnan(spark.range(1).select(bits.from_bits(F.lit(0x7FF8 << 48))).first()[0])


def nearest_bf16(x):
    with np.errstate(over="ignore"):
        raw = int(np.array(x, np.float32).view(np.uint32))
    if raw & 0x7F800000 != 0x7F800000:
        raw = raw + 0x7FFF + (raw >> 16 & 1)
    return float(np.array(raw >> 16 << 16 & 0xFFFFFFFF, np.uint32).view(np.float32))


def test_bfloat16_is_that_of_the_bits(spark):
    rows = spark.createDataFrame([(x,) for x in numbers()], "x double").withColumn("y", bits.bf16(F.col("x"))).collect()
    assert all(r.y == nearest_bf16(r.x) for r in rows)
    assert math.isnan(spark.createDataFrame([(math.nan,)], "x double").select(bits.bf16(F.col("x"))).first()[0])


def test_e4m3_takes_the_nearest_of_all_its_values(spark):
    values = sorted({s * (m / 8 * 2.0**-6 if e == 0 else (1 + m / 8) * 2.0 ** (e - 7)) for s in (1, -1) for e in range(16) for m in range(8) if (e, m) != (15, 7)})
    even = {v: (abs(v) / 2.0 ** max(math.floor(math.log2(abs(v))) - 3, -9)) % 2 == 0 if v else True for v in values}
    got = spark.createDataFrame([(x,) for x in numbers()], "x double").withColumn("y", bits.e4m3(F.col("x"))).collect()
    for r in got:
        x = max(min(r.x, 448.0), -448.0)
        near = min(values, key=lambda v: (abs(v - x), not even[v]))
        assert r.y == near, (r, near)


# --- products of blocks -------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("m", "n", "k", "side", "depth"), [(37, 11, 20, 5, 3), (8, 30, 7, 4, 100), (1, 1, 1, 256, 512), (300, 3, 40, 256, 16)])
def test_scaled_products_are_exact(spark, monkeypatch, m, n, k, side, depth):
    monkeypatch.setattr(bp, "SIDE", side)
    monkeypatch.setattr(bp, "DEPTH", depth)
    rng = np.random.default_rng(m)
    a, b = rng.integers(-127, 128, (m, k)), rng.integers(-127, 128, (n, k))
    sa, sb, bias = rng.random(m), rng.random(n), rng.normal(size=n)
    left = spark.createDataFrame([(7 * i, a[i].tolist(), float(sa[i])) for i in range(m)], "m long, x array<int>, scale double").repartition(3)
    right = spark.createDataFrame([(j, b[j].tolist(), float(sb[j]), float(bias[j])) for j in range(n)], "n long, w array<int>, scale double, bias double")
    got = {(r.m, r.n): (r.sum, r.y) for r in bp.scaled_product(left, right).collect()}
    exact = a @ b.T
    assert len(got) == m * n
    for (i, j), (s, y) in got.items():
        assert s == exact[i // 7, j] and abs(y - (s * sa[i // 7] * sb[j] + bias[j])) < 1e-9


def test_rows_of_other_lengths_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(bp, "DEPTH", 2)
    left = spark.createDataFrame([(1, [1, 2, 3, 4, 5], 1.0), (2, [1], 2.0), (3, [], 1.0), (4, None, 1.0), (None, [9], 1.0), (5, [0, 0, 1], None)], "m long, x array<int>, scale double")
    right = spark.createDataFrame([(1, [1, 1, 1, 1, 1], 1.0, 0.5), (2, [0, 0, 0, 10], 1.0, None)], "n long, w array<int>, scale double, bias double")
    got = {(r.m, r.n): (r.sum, r.y) for r in bp.scaled_product(left, right).collect()}
    assert got == {(1, 1): (15, 15.5), (1, 2): (40, None), (2, 1): (1, 2.5), (2, 2): (0, None), (5, 1): (1, None), (5, 2): (0, None)}
    assert bp.scaled_product(left.limit(0), right).count() == 0
    with pytest.raises(Exception, match="twice"):
        bp.scaled_product(left.union(left), right).collect()
    with pytest.raises(Exception, match="exact"):
        bp.scaled_product(left.withColumn("x", F.transform("x", lambda v: v.cast("double") * 2.0**50)), right.withColumn("w", F.transform("w", lambda v: v.cast("double") * 8))).collect()


def test_shuffled_rows_follow_the_blocks_not_the_products(spark):
    a = spark.range(512).select(F.col("id").alias("m"), F.array_repeat(F.lit(1), 64).alias("x"), F.lit(1.0).alias("scale"))
    b = a.select(F.col("m").alias("n"), F.col("x").alias("w"), "scale", F.lit(0.0).alias("bias"))
    assert bp.row_blocks(a.select(F.col("m").alias("number"), F.col("x").alias("values"), "scale", F.lit(0.0).alias("bias")), 2).count() == 512
    assert bp.scaled_product(a, b).agg(F.sum("sum")).first()[0] == 512 * 512 * 64


# --- sparse attention ---------------------------------------------------------------------------------------------


def morton(y, x):
    return sum(((x >> i & 1) << 2 * i) + ((y >> i & 1) << 2 * i + 1) for i in range(8))


def pairs_by_hand(tokens, grid, tile, query_tiles, key_tiles, window, kernel, masked):
    height, width = grid
    plane = sorted(((b, c) for b in range(height // tile[1]) for c in range(width // tile[2])), key=lambda p: morton(*p))
    number = {t: (t[0] // tile[0]) * len(plane) + plane.index((t[1] // tile[1], t[2] // tile[2])) for t in tokens}
    tiles = {(t[0] // tile[0], t[1] // tile[1], t[2] // tile[2]): n for t, n in number.items()}
    size = (max(a for a, _, _ in tiles) + 1, height // tile[1], width // tile[2])
    blocks = {}
    for t, n in tiles.items():
        blocks.setdefault(n // query_tiles, []).append(t)
    out = {(n // query_tiles, n // key_tiles) for n in tiles.values()}
    for q, members in blocks.items():
        start = [min(max(sum(t[i] for t in members) // len(members) - window[i] // 2, 0), size[i] - window[i]) for i in range(3)]
        out |= {(q, n // key_tiles) for t, n in tiles.items() if all(start[i] <= t[i] < start[i] + window[i] for i in range(3))}
    shielded = {number[t] // query_tiles for t in tokens for m in masked if all(abs(t[i] - m[i]) <= kernel[i] // 2 for i in range(3))}
    return out | {(q, n // key_tiles) for q in shielded for n in tiles.values()}, number, shielded


@pytest.mark.parametrize(("frames", "grid", "tile", "query_tiles", "key_tiles", "window", "chunk"), [(4, (6, 8), (2, 2, 2), 3, 2, (1, 2, 3), 2), (5, (4, 4), (1, 1, 2), 2, 2, (3, 3, 1), 64), (2, (4, 6), (4, 2, 3), 1, 1, (1, 1, 1), 1)])
def test_sparse_attention_equals_dense_attention_behind_a_mask(spark, monkeypatch, frames, grid, tile, query_tiles, key_tiles, window, chunk):
    monkeypatch.setattr(sparse, "CHUNK", chunk)
    rng = np.random.default_rng(frames)
    places = [(t, y, x) for t in range(frames) for y in range(grid[0]) for x in range(grid[1]) if (t, y) != (frames - 1, grid[0] - 1)]  # a ragged end
    masked = [places[i] for i in rng.choice(len(places), 2, replace=False)]
    vectors = {p: rng.normal(size=(3, 6)) for p in places}
    rows = [(5, *p, int(p in masked), *(v.tolist() for v in vectors[p])) for p in places] + [(6, 0, 0, 0, 0, *[[1.0] * 6] * 3)]
    tokens = spark.createDataFrame(rows, "clip long, t long, y long, x long, mask int, q array<double>, k array<double>, v array<double>").repartition(3)
    layout = sparse.Layout(*grid, tile, query_tiles, key_tiles)
    pairs = sparse.block_pairs(tokens, layout, window, (3, 3, 3))
    want, number, shielded = pairs_by_hand(places, grid, tile, query_tiles, key_tiles, window, (3, 3, 3), masked)
    assert {(r.qb, r.kb) for r in pairs.where("clip = 5").collect()} == want
    assert {r.qb for r in sparse.protected(tokens, layout, (3, 3, 3)).collect()} == shielded
    got = {(r.t, r.y, r.x): r.out for r in sparse.sparse_attention(tokens, pairs, layout, 0.4).where("clip = 5").collect()}
    assert got.keys() == set(places)
    for p in places:
        seen = [o for o in places if (number[p] // query_tiles, number[o] // key_tiles) in want]
        w = np.exp([0.4 * vectors[p][0] @ vectors[o][1] for o in seen])
        assert np.allclose(got[p], w @ np.array([vectors[o][2] for o in seen]) / w.sum())

@pytest.mark.parametrize("rows", [1, 24, 32_000])
def test_sparse_attention_sends_keys_to_groups_of_queries(spark, monkeypatch, rows):
    monkeypatch.setattr(sparse, "ROWS", rows)
    rng = np.random.default_rng(3)
    places = [(t, y, x) for t in range(6) for y in range(4) for x in range(4)]
    tokens = spark.createDataFrame([(1, *p, int(p == (0, 0, 0)), *(v.tolist() for v in rng.normal(size=(3, 4)))) for p in places], "clip long, t long, y long, x long, mask int, q array<double>, k array<double>, v array<double>").repartition(3)
    layout = sparse.Layout(4, 4, (1, 2, 2), 2, 1)
    packed = sparse.packed_pairs(tokens, layout, (1, 1, 1), (1, 1, 1))
    pairs = sparse.block_pairs(tokens, layout, (1, 1, 1), (1, 1, 1))
    # the one protected block of queries is a row for each chunk of keys
    assert packed.where("kbs IS NULL").count() == packed.where("protected = 1").count() == -(-24 // layout.chunk())
    assert pairs.count() == pairs.distinct().count() == 24 + 11 * 2
    got, want = ({(r.t, r.y, r.x): r.out for r in sparse.sparse_attention(tokens, p, layout, 0.3).collect()} for p in (packed, pairs.select("clip", "qb", "kb")))
    assert got.keys() == want.keys() == set(places)
    assert all(np.allclose(got[p], want[p]) for p in places)


def test_morton_column_and_bad_layouts(spark):
    rows = spark.range(64).select(F.expr("id div 8").alias("y"), F.expr("id % 8").alias("x")).withColumn("m", sparse.morton(F.col("y"), F.col("x"))).collect()
    assert all(r.m == morton(r.y, r.x) for r in rows)
    with pytest.raises(ValueError, match="isn't made of tiles"):
        sparse.Layout(5, 4, (1, 2, 2), 1, 1)
