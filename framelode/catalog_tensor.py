"""Queries over blocks of tensors: sparse attention, scaled products, tiles, patches, colours and number formats."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelode import bindings as bd
from framelode.catalog import _PLAN, OVERLAP, _bytes, _plan, query, rounded
from framelode.functions import arrays as ar
from framelode.functions import bits
from framelode.operators import blockproduct, images, layers, masks, overlap, patches, preprocess, reuse, sparse, tiles, transfer
from framelode.plans import windows

# --- attention over listed blocks ---------------------------------------------------------------------------------

# a vector is a token of a frame of 10 x 10, a tile 2 x 5 tokens of one frame; 4 tiles ask, 2 are asked
_LAYOUT = sparse.Layout(10, 10, (1, 2, 5), 4, 2)
_WINDOW, _KERNEL3 = (3, 3, 2), (3, 3, 3)
_TOKENS = (
    "tk AS (SELECT vec_id, vec_id // 100 AS t, vec_id % 100 // 10 AS y, vec_id % 10 AS x, v, v[1] > 0.3 AS m FROM vectors), "
    "pl AS (SELECT b, c, row_number() OVER (ORDER BY (c & 1) + ((c >> 1) & 1) * 4 + (b & 1) * 2 + ((b >> 1) & 1) * 8 + ((b >> 2) & 1) * 32) - 1 AS place FROM (SELECT unnest(range(5)) AS b), (SELECT unnest(range(2)) AS c)), "
    "tt AS (SELECT tk.*, t AS a, b, c, (t * 10 + place) // 4 AS qb, (t * 10 + place) // 2 AS kb FROM tk JOIN pl ON b = y // 2 AND c = x // 5), "
    "ti AS (SELECT DISTINCT a, b, c, qb, kb FROM tt), "
    "ce AS (SELECT qb, least(greatest(CAST(floor(avg(a)) AS BIGINT) - 1, 0), (SELECT max(a) + 1 FROM ti) - 3) AS a0, least(greatest(CAST(floor(avg(b)) AS BIGINT) - 1, 0), 2) AS b0, least(greatest(CAST(floor(avg(c)) AS BIGINT) - 1, 0), 0) AS c0 FROM ti GROUP BY qb), "
    "pr AS (SELECT DISTINCT o.qb FROM tt o JOIN tk n ON n.m AND abs(n.t - o.t) <= 1 AND abs(n.y - o.y) <= 1 AND abs(n.x - o.x) <= 1), "
    "bp AS (SELECT DISTINCT ce.qb, ti.kb FROM ce JOIN ti ON a >= a0 AND a < a0 + 3 AND b >= b0 AND b < b0 + 3 AND c >= c0 AND c < c0 + 2 UNION SELECT qb, kb FROM ti UNION SELECT pr.qb, ti.kb FROM pr, ti)"
)


def _tokens(spark, sf_dir: str) -> DataFrame:
    v = bd.vectors(spark, sf_dir)
    at = {"t": "vec_id div 100", "y": "vec_id % 100 div 10", "x": "vec_id % 10"}
    mask = F.when(F.col("v")[0] > 0.3, 1).otherwise(0)
    return v.select(F.lit(0).cast("long").alias("clip"), *[F.expr(e).alias(c) for c, e in at.items()], mask.alias("mask"), F.col("v").alias("q"), F.reverse("v").alias("k"), F.transform("v", lambda x: x * 2 + 1).alias("v"))


@query(f"{_TOKENS} SELECT qb, kb, CAST(qb IN (SELECT qb FROM pr) AS INTEGER) AS protected FROM bp", "vectors")
def sparse_block_pairs(spark, sf_dir: str) -> DataFrame:
    """The pairs of blocks that attention computes, and whether the mask protects the queries."""
    tokens = _tokens(spark, sf_dir).select("clip", "t", "y", "x", "mask")
    return sparse.block_pairs(tokens, _LAYOUT, _WINDOW, _KERNEL3).select("qb", "kb", "protected")


@query(
    f"{_TOKENS}, sc AS (SELECT q.vec_id, exp(list_dot_product(q.v, list_reverse(k.v)) * 0.125) AS w, k.v FROM bp JOIN tt q ON q.qb = bp.qb JOIN tt k ON k.kb = bp.kb), "
    "pe AS (SELECT vec_id, unnest(range(64)) AS place, w, unnest(v) AS e FROM sc) SELECT vec_id, place, round(sum(w * (e * 2 + 1)) / sum(w), 6) AS out FROM pe GROUP BY vec_id, place",
    "vectors",
)
def sparse_attention(spark, sf_dir: str) -> DataFrame:
    """Attention of every vector over the listed blocks; equal to dense attention behind a mask of pairs."""
    tokens = _tokens(spark, sf_dir)
    pairs = sparse.packed_pairs(tokens.select("clip", "t", "y", "x", "mask"), _LAYOUT, _WINDOW, _KERNEL3)
    out = sparse.sparse_attention(tokens, pairs, _LAYOUT, 0.125)
    return rounded(out.select(F.expr("t * 100 + y * 10 + x").alias("vec_id"), F.posexplode("out").alias("place", "out")), "out")


# --- scaled products and number formats ---------------------------------------------------------------------------

_QUANT = "qt AS (SELECT vec_id, label, v, list_max(list_transform(v, lambda t: abs(t))) AS top FROM vectors), fi AS (SELECT label, min(vec_id) AS vec_id FROM vectors GROUP BY label)"
_INT8 = "list_transform(v, lambda t: greatest(least(round_even(t / (top / 127), 0), 127), -127))"
#: E4M3 of t in SQL: the exponent by a logarithm, which the values here don't mislead.
_E4M3 = "round_even(t / (top / 448) / pow(2.0, greatest(floor(log2(greatest(abs(t / (top / 448)), 1e-30))), -6) - 3), 0) * pow(2.0, greatest(floor(log2(greatest(abs(t / (top / 448)), 1e-30))), -6) - 3)"


def _sides(spark, sf_dir: str, top: float, rounding) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the first of each label as weights, both quantised."""
    v = bd.vectors(spark, sf_dir)
    weights = v.join(v.groupBy("label").agg(F.min("vec_id").alias("vec_id")), ["label", "vec_id"]).select(F.col("label").cast("long").alias("n"), "v", (F.col("label") * 0.5).alias("bias"))
    a = blockproduct.quantised(v.select(F.col("vec_id").alias("m"), "v"), "v", top, rounding, "x")
    return a, blockproduct.quantised(weights, "v", top, rounding, "w")


@query(f"{_QUANT}, s AS (SELECT a.vec_id AS m, b.label AS n, list_dot_product({_INT8.replace('(v,', '(a.v,').replace('top', 'a.top')}, {_INT8.replace('(v,', '(b.v,').replace('top', 'b.top')}) AS s, a.top / 127 AS sa, b.top / 127 AS sb FROM qt a, qt b JOIN fi ON fi.vec_id = b.vec_id) SELECT m, n, CAST(s AS BIGINT) AS sum, round(s * sa * sb + n * 0.5, 9) AS y FROM s", "vectors")
def int8_scaled_product(spark, sf_dir: str) -> DataFrame:
    """Exact integer products of all vectors with a weight row for each label, scaled, with bias."""
    a, b = _sides(spark, sf_dir, 127.0, blockproduct.int8)
    return rounded(blockproduct.scaled_product(a, b).withColumn("sum", F.col("sum").cast("long")), "y", digits=9)


@query(f"{_QUANT}, e AS (SELECT vec_id, label, top / 448 AS s, list_transform(v, lambda t: {_E4M3}) AS q FROM qt) SELECT a.vec_id AS m, b.label AS n, round(list_dot_product(a.q, b.q) * a.s * b.s + b.label * 0.5, 6) AS y FROM e a, e b JOIN fi ON fi.vec_id = b.vec_id", "vectors")
def fp8_scaled_product(spark, sf_dir: str) -> DataFrame:
    """The same with eight-bit floats; every product of two is a whole number of steps of 2**-18, so sums stay exact."""
    a, b = _sides(spark, sf_dir, 448.0, lambda v: bits.e4m3(v) * 512)
    out = blockproduct.scaled_product(a, b.withColumn("scale", F.col("scale") / (512 * 512)))
    return rounded(out.select("m", "n", "y"), "y")


@query("fq AS (SELECT vec_id, unnest(range(64)) AS place, unnest(v) AS t, top FROM (SELECT vec_id, v, list_max(list_transform(v, lambda t: abs(t))) AS top FROM vectors)) SELECT vec_id, place, round({0}, 6) AS q FROM fq".format(_E4M3), "vectors")
def fp8_values(spark, sf_dir: str) -> DataFrame:
    rows = blockproduct.quantised(bd.vectors(spark, sf_dir).select("vec_id", "v"), "v", 448.0, bits.e4m3, "q")
    return rounded(rows.select("vec_id", F.posexplode("q").alias("place", "q")), "q")


_BF16 = "round_even(CAST(CAST({0} AS FLOAT) AS DOUBLE) / pow(2.0, floor(log2(abs(CAST(CAST({0} AS FLOAT) AS DOUBLE)))) - 7), 0) * pow(2.0, floor(log2(abs(CAST(CAST({0} AS FLOAT) AS DOUBLE)))) - 7)"


@query(
    f"{_PLAN}, b0 AS (SELECT clip, frame, {_BF16.format('(value + 0.001)')} AS value FROM frames), w AS (SELECT f.clip, f.frame, window_index, f.frame - load_start AS place, value * (1 + window_index) AS value, overlap_left, deal_start + deal_length AS deal_end FROM b0 f JOIN p ON f.clip = p.clip AND f.frame >= load_start AND f.frame < load_end), "
    f"x AS (SELECT a.clip, a.frame, CASE WHEN b.value IS NOT NULL AND a.place < a.overlap_left THEN (1 - a.place / {OVERLAP - 1}) * {_BF16.format('b.value')} + (1 - (1 - a.place / {OVERLAP - 1})) * {_BF16.format('a.value')} ELSE {_BF16.format('a.value')} END AS mixed, row_number() OVER (PARTITION BY a.clip, a.frame ORDER BY a.window_index DESC) AS r FROM w a LEFT JOIN w b ON b.clip = a.clip AND b.frame = a.frame AND b.window_index = a.window_index - 1 WHERE a.frame < a.deal_end) "
    f"SELECT clip, frame, {_BF16.format('mixed')} AS value FROM x WHERE r = 1",
    "frames",
    "clips",
)
def blend_bf16(spark, sf_dir: str) -> DataFrame:
    """Overlaps of bfloat16 outputs, mixed in floating point and rounded to bfloat16 again."""
    plan = _plan(spark, sf_dir)
    rows = bd.frames(spark, sf_dir).select("clip", "frame", bits.bf16(F.col("value") + 0.001).alias("value"))
    placed = windows.frame_windows(rows, plan).withColumn("value", bits.bf16(F.col("value") * (1 + F.col("window_index"))))
    return overlap.blended(placed, plan, "linear").select("clip", "frame", bits.bf16(F.col("value")).alias("value"))


@query("SELECT event_id, CAST((1023 + floor(log2(value + 0.001))) * 4503599627370496 AS BIGINT) + CAST(((value + 0.001) / pow(2.0, floor(log2(value + 0.001))) - 1) * 4503599627370496 AS BIGINT) AS bits, value + 0.001 AS back FROM events")
def float_bits(spark, sf_dir: str) -> DataFrame:
    """Each value's 64 bits, and the value that they give back."""
    rows = bd.table(spark, sf_dir, "events").select("event_id", bits.to_bits(F.col("value") + 0.001).alias("bits"))
    return rows.withColumn("back", bits.from_bits(F.col("bits")))


# --- colours ------------------------------------------------------------------------------------------------------

# a vector is 64 pixels; a few vectors have no referred pixel, or one
_COLOURS = (
    "px AS (SELECT vec_id, unnest(range(64)) AS p, v FROM vectors), "
    "pc AS (SELECT vec_id, p, [abs(v[p + 1]) * 1.5, abs(v[(p + 21) % 64 + 1]), abs(v[(p + 42) % 64 + 1]) * 0.5] AS m, [abs(v[64 - p]), abs(v[(p + 5) % 64 + 1]), abs(v[(p + 9) % 64 + 1])] AS s, CASE WHEN vec_id % 11 = 0 THEN false WHEN vec_id % 13 = 0 THEN p = 7 ELSE (p * 7 + vec_id) % 5 <> 0 END AS refer FROM px), "
    "pq AS (SELECT vec_id, p, refer, list_transform(m, lambda t: trunc(t * 255) / 255) AS m, s FROM pc)"
)


def _colours(spark, sf_dir: str) -> DataFrame:
    rows = bd.vectors(spark, sf_dir).select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("place"))
    near = lambda step: F.abs(F.get("v", (F.col("place") + step) % 64))
    refer = F.expr("CASE WHEN vec_id % 11 = 0 THEN false WHEN vec_id % 13 = 0 THEN place = 7 ELSE (place * 7 + vec_id) % 5 <> 0 END")
    return rows.select("vec_id", "place", F.array(near(0) * 1.5, near(21), near(42) * 0.5).alias("made"), F.array(F.abs(F.get("v", 63 - F.col("place"))), near(5), near(9)).alias("source"), refer.alias("refer"))


def _aligned_sql(to: str, back: list[str], together: bool = False) -> str:
    """The three channels of pq in a space, statistics of each, and the way back (c[1], c[2], c[3])."""
    group = "vec_id" if together else "vec_id, ch"
    empty = "1e-8" if together else "0"
    return (
        f"{_COLOURS}, sp AS (SELECT vec_id, p, refer, {to.replace('$', 'm')} AS m, {to.replace('$', 's')} AS s FROM pq), "
        "ex AS (SELECT vec_id, p, refer, unnest([1, 2, 3]) AS ch, unnest(m) AS m, unnest(s) AS s FROM sp), "
        f"st AS (SELECT {group}, avg(m) AS am, sqrt(var_samp(m) + 1e-8) AS astd, count(*) FILTER (refer) AS n, coalesce(avg(m) FILTER (refer), {empty}) AS rm, CASE WHEN count(*) FILTER (refer) = 0 THEN 1e-8 ELSE sqrt(var_samp(m) FILTER (refer) + 1e-8) END AS rs, coalesce(avg(s) FILTER (refer), {empty}) AS om, CASE WHEN count(*) FILTER (refer) = 0 THEN 1e-8 ELSE sqrt(var_samp(s) FILTER (refer) + 1e-8) END AS os FROM ex GROUP BY {group}), "
        f"al AS (SELECT ex.vec_id, p, list((m - am) / astd * (os / rs * astd) + om / nullif(rm, 0) * am ORDER BY ex.ch) AS c FROM ex JOIN st USING ({group}) GROUP BY ex.vec_id, p), "
        f"bk AS (SELECT vec_id, p, len(list_filter(c, lambda t: t IS NULL)) = 0 AS sure, [{', '.join(back)}] AS c FROM al) "
        "SELECT vec_id, p AS place, " + ", ".join(f"CASE WHEN sure THEN round(trunc(least(greatest(c[{i + 1}] + 1e-9, 0), 1) * 255) / 255, 6) END AS {n}" for i, n in enumerate("rgb")) + " FROM bk"
    )


_TO_YUV = "[0.299 * $[1] + 0.587 * $[2] + 0.114 * $[3], -0.147 * $[1] - 0.289 * $[2] + 0.436 * $[3], 0.615 * $[1] - 0.515 * $[2] - 0.100 * $[3]]"
_YUV_BACK = ["c[1] + 1.14 * c[3]", "c[1] - 0.396 * c[2] - 0.581 * c[3]", "c[1] + 2.029 * c[2]"]
_PLAIN = ["c[1]", "c[2]", "c[3]"]


def _align(name: str, sql: str, **more) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        return rounded(transfer.aligned(_colours(spark, sf_dir), ["vec_id"], **more), "r", "g", "b")

    run.__name__ = name
    query(sql, "vectors")(run)


_align("colour_align_rgb", _aligned_sql("$", _PLAIN))
_align("colour_align_yuv", _aligned_sql(_TO_YUV, _YUV_BACK), space="YUV")
_align("colour_align_together", _aligned_sql("$", _PLAIN, True), per_channel=False)


# --- tiles --------------------------------------------------------------------------------------------------------

# forty vectors are an image of 40 x 64
_IMAGES = "im AS (SELECT vec_id // 40 AS id, row_number() OVER (PARTITION BY vec_id // 40 ORDER BY vec_id) - 1 AS y, v FROM vectors), hi AS (SELECT id, count(*) AS h FROM im GROUP BY id), ip AS (SELECT id, y, unnest(range(64)) AS x, unnest(v) AS g FROM im)"


def _images(spark, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("id").orderBy("vec_id")
    return bd.vectors(spark, sf_dir).withColumn("id", F.expr("vec_id div 40")).select("id", (F.row_number().over(order) - 1).alias("y"), F.col("v").alias("pixels"))


def _tiles_sql(tile: int, stride: int, up: int, down: int, made: str) -> str:
    """made: SQL for the tiles' results tr (id, i, j, h, w, y, x, g), h and w their sizes, over ti (id, i, j, y, x, g: the
    tiles' own pixels) and tm (id, i, j, m: their means). Strides are at least as wide as seams, so a seam's far side is
    mixed along the other axis at most."""
    seam, step = (tile - stride) * up // down, stride * up // down
    return (
        f"{_IMAGES}, tg AS (SELECT id, h, i, j, least({tile}, h - i * {stride}) * {up} // {down} AS th, least({tile}, 64 - j * {stride}) * {up} // {down} AS tw FROM (SELECT id, h, unnest(range(CAST(ceil(h / {stride}) AS BIGINT))) AS i FROM hi), (SELECT unnest(range(CAST(ceil(64 / {stride}) AS BIGINT))) AS j)), "
        f"ti AS (SELECT tg.id, i, j, th, tw, y - i * {stride} AS y, x - j * {stride} AS x, g FROM tg JOIN ip ON ip.id = tg.id AND y >= i * {stride} AND y < i * {stride} + {tile} AND x >= j * {stride} AND x < j * {stride} + {tile}), "
        f"tm AS (SELECT id, i, j, avg(g) AS m FROM ti GROUP BY id, i, j), tr AS ({made}), "
        # mixed to the left with what isn't mixed, then up, then to the left again
        f"hb AS (SELECT b.id, b.i, b.j, b.th, b.tw, b.y, b.x, CASE WHEN a.g IS NULL THEN b.g ELSE a.g * (1 - b.x / least(a.tw, b.tw, {seam})) + b.g * (b.x / least(a.tw, b.tw, {seam})) END AS g FROM tr b LEFT JOIN tr a ON a.id = b.id AND a.i = b.i AND a.j = b.j - 1 AND a.y = b.y AND b.x < least(a.tw, b.tw, {seam}) AND a.x = a.tw - least(a.tw, b.tw, {seam}) + b.x), "
        f"vb AS (SELECT b.id, b.i, b.j, b.th, b.tw, b.y, b.x, CASE WHEN a.g IS NULL THEN b.g ELSE a.g * (1 - b.y / least(a.th, b.th, {seam})) + b.g * (b.y / least(a.th, b.th, {seam})) END AS g FROM tr b LEFT JOIN hb a ON a.id = b.id AND a.j = b.j AND a.i = b.i - 1 AND a.x = b.x AND b.y < least(a.th, b.th, {seam}) AND a.y = a.th - least(a.th, b.th, {seam}) + b.y), "
        f"fb AS (SELECT b.id, b.i, b.j, b.y, b.x, CASE WHEN a.g IS NULL THEN b.g ELSE a.g * (1 - b.x / least(a.tw, b.tw, {seam})) + b.g * (b.x / least(a.tw, b.tw, {seam})) END AS g FROM vb b LEFT JOIN vb a ON a.id = b.id AND a.i = b.i AND a.j = b.j - 1 AND a.y = b.y AND b.x < least(a.tw, b.tw, {seam}) AND a.x = a.tw - least(a.tw, b.tw, {seam}) + b.x) "
        f"SELECT id, i * {step} + y AS y, j * {step} + x AS x, round(g, 6) AS value FROM fb WHERE y < {step} AND x < {step}"
    )


_HALVED = "SELECT id, i, j, th, tw, y // 2 AS y, x // 2 AS x, avg(g) - 0.5 * any_value(m) AS g FROM ti JOIN tm USING (id, i, j) WHERE y // 2 < th AND x // 2 < tw GROUP BY id, i, j, th, tw, y // 2, x // 2"
_DOUBLED = "SELECT id, i, j, th, tw, y * 2 + dy AS y, x * 2 + dx AS x, g + 0.25 * dy * m + 0.1 * m AS g FROM ti JOIN tm USING (id, i, j), (SELECT unnest(range(2)) AS dy), (SELECT unnest(range(2)) AS dx)"


def _halved(t):
    even = t[: len(t) // 2 * 2, : t.shape[1] // 2 * 2]
    return even.reshape(len(even) // 2, 2, -1, 2).mean((1, 3)) - 0.5 * t.mean()


def _doubled(t):
    wide = t.repeat(2, 0).repeat(2, 1)
    wide[1::2] += 0.25 * t.mean()
    return wide + 0.1 * t.mean()


def _places(df: DataFrame) -> DataFrame:
    return rounded(df.select("id", "y", "x", F.posexplode("pixels").alias("at", "value")).select("id", "y", (F.col("x") + F.col("at")).alias("x"), "value"), "value")


@query(_tiles_sql(24, 16, 1, 2, _HALVED), "vectors")
def tiled_encode(spark, sf_dir: str) -> DataFrame:
    """Images halved tile by tile, each less its own mean, so that seams show what blending does."""
    return _places(tiles.tiled(_images(spark, sf_dir), _halved, (24, 24), (16, 16), Fraction(1, 2)))


@query(_tiles_sql(12, 8, 2, 1, _DOUBLED), "vectors")
def tiled_decode(spark, sf_dir: str) -> DataFrame:
    """Images doubled tile by tile."""
    return _places(tiles.tiled(_images(spark, sf_dir), _doubled, (12, 12), (8, 8), Fraction(2)))


def _paired(t):
    rest = t[1:][: (len(t) - 1) // 2 * 2]
    return np.concatenate([t[:1], rest.reshape(len(rest) // 2, 2, t.shape[1]).mean(1)]) - 0.25 * t.mean()


@query(
    "w AS (SELECT clip, num_frames, unnest(range(CAST(ceil(num_frames / 6) AS BIGINT))) AS i FROM clips), "
    "t AS (SELECT w.clip, i, frame - i * 6 AS y, value * 0.7310585786 AS g, least(11, num_frames - i * 6) AS n FROM w JOIN frames f ON f.clip = w.clip AND frame >= i * 6 AND frame < i * 6 + 11), "
    "m AS (SELECT clip, i, avg(g) AS m FROM t GROUP BY clip, i), "
    "e AS (SELECT t.clip, i, (y + 1) // 2 AS y, avg(g) - 0.25 * any_value(m) AS g, 1 + (n - 1) // 2 AS n FROM t JOIN m USING (clip, i) WHERE (y + 1) // 2 < 1 + (n - 1) // 2 GROUP BY t.clip, i, n, (y + 1) // 2), "
    "r AS (SELECT clip, i, CASE WHEN i = 0 THEN y ELSE y - 1 END AS y, g, CASE WHEN i = 0 THEN n ELSE n - 1 END AS n FROM e WHERE i = 0 OR y > 0), "
    "b AS (SELECT x.clip, x.i, x.y, CASE WHEN a.g IS NULL THEN x.g ELSE a.g * (1 - x.y / least(a.n, x.n, 2)) + x.g * (x.y / least(a.n, x.n, 2)) END AS g FROM r x LEFT JOIN r a ON a.clip = x.clip AND a.i = x.i - 1 AND x.y < least(a.n, x.n, 2) AND a.y = a.n - least(a.n, x.n, 2) + x.y) "
    "SELECT clip, CASE WHEN i = 0 THEN y ELSE i * 3 + 1 + y END AS frame, round(g, 6) AS value FROM b WHERE y < CASE WHEN i = 0 THEN 4 ELSE 3 END",
    "frames",
    "clips",
)
def tiled_time(spark, sf_dir: str) -> DataFrame:
    """Clips halved in tiles of 10 + 1 frames, 6 apart: the first frame by itself, the others in pairs."""
    frames = bd.frames(spark, sf_dir).select("clip", "frame", F.array(F.col("value") * 0.7310585786).alias("pixels"))
    return rounded(tiles.tiled_frames(frames, _paired, 10, 6, 2).select("clip", "frame", F.col("pixels")[0].alias("value")), "value")


# --- patches, masks that are filled -------------------------------------------------------------------------------

_PATCH_WEIGHTS = "fw AS (SELECT label AS n, vec_id AS f, label * 0.5 AS bias FROM (SELECT label, min(vec_id) AS vec_id FROM vectors GROUP BY label)), wk AS (SELECT n, bias, unnest(range(2)) AS ch, w.v FROM fw JOIN vectors w ON w.vec_id = f), wv AS (SELECT n, bias, ch, unnest(range(16)) AS k, v FROM wk)"


@query(
    f"{_PATCH_WEIGHTS}, px AS (SELECT vec_id AS id, unnest(range(64)) AS p, v FROM vectors), pp AS (SELECT id, p // 8 AS y, p % 8 AS x, ch, CASE WHEN ch = 0 THEN v[p + 1] ELSE v[p + 1] * v[64 - p] END AS g FROM px, (SELECT unnest(range(2)) AS ch)), "
    "oc AS (SELECT unnest(range(4)) AS r, unnest(range(4)) AS c0), rc AS (SELECT a.r, b.c0 AS c FROM oc a, oc b), "
    "gt AS (SELECT id, r, c, ch, (y + 1 - 2 * r) * 4 + x + 1 - 2 * c AS k, g FROM pp JOIN rc ON y + 1 - 2 * r BETWEEN 0 AND 3 AND x + 1 - 2 * c BETWEEN 0 AND 3) "
    "SELECT id, r AS row, c AS col, n, round(sum(g * v[ch * 16 + gt.k + 1]) + any_value(bias), 6) AS y FROM gt JOIN wv USING (ch, k) GROUP BY id, r, c, n",
    "vectors",
)
def patch_projection(spark, sf_dir: str) -> DataFrame:
    """Images of 8 x 8 with two channels: patches of 4 x 4 at every second place, one place outside, times ten rows."""
    v = bd.vectors(spark, sf_dir)
    second = F.zip_with("v", F.reverse("v"), lambda a, b: a * b)
    pixels = v.select(F.col("vec_id").alias("id"), F.posexplode(F.array("v", second)).alias("channel", "v")).select("id", "channel", F.posexplode("v").alias("p", "value"))
    pixels = pixels.select("id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.expr("p div 8").alias("y"), F.expr("p % 8").alias("x"), "channel", "value")
    weights = v.join(v.groupBy("label").agg(F.min("vec_id").alias("vec_id")), ["label", "vec_id"]).select(F.col("label").cast("long").alias("n"), F.slice("v", 1, 32).alias("w"), (F.col("label") * 0.5).alias("bias"))
    return rounded(patches.projected(patches.patch_rows(pixels, (4, 4), (2, 2), (1, 1), 2), weights), "y")


_FULL = "CASE WHEN (p + 3 * vec_id) % 41 = 0 OR (p > 58 AND vec_id % 5 = 0) THEN least(254, floor(abs(v[p + 1]) * 255)) ELSE 255 END"
_CHAIN = "d AS (SELECT unnest(range(-1, 2)) AS d), k AS (SELECT i, CASE WHEN i + d < 0 THEN 1 WHEN i + d > 7 THEN 6 ELSE i + d END AS j, sum(exp(-d * d / 1.28) / (SELECT sum(exp(-d * d / 1.28)) FROM d)) AS w FROM (SELECT unnest(range(8)) AS i), d GROUP BY ALL)"


def _masks(spark, sf_dir: str) -> DataFrame:
    value = F.expr("transform(v, (x, p) -> IF((p + 3 * vec_id) % 41 = 0 OR (p > 58 AND vec_id % 5 = 0), least(254, floor(abs(x) * 255)), 255))")
    return bd.vectors(spark, sf_dir).select(F.col("label").alias("clip"), F.col("vec_id").alias("frame"), F.lit(8).alias("height"), F.lit(8).alias("width"), _bytes(value).alias("pixels"))


def _fill_sql() -> str:
    first = (
        f"{_CHAIN}, px AS (SELECT label AS clip, vec_id AS frame, p // 8 AS y, p % 8 AS x, 1 - {_FULL} / 255 AS g FROM (SELECT *, unnest(range(64)) AS p FROM vectors)), "
        "di AS (SELECT a.clip, a.frame, a.y, a.x, min(greatest(abs(a.y - b.y), abs(a.x - b.x))) AS d FROM px a JOIN px b ON b.clip = a.clip AND b.frame = a.frame AND b.g > 0 GROUP BY ALL), "
        "st AS (SELECT clip, max(d) AS s FROM di GROUP BY clip), b0 AS (SELECT px.*, s FROM px JOIN st USING (clip))"
    )
    # a row of the 8 x 8 kernel products for each pixel and step
    steps = [f"b{i} AS (SELECT b.clip, b.frame, ky.i AS y, kx.i AS x, sum(ky.w * kx.w * b.g) AS g, b.s FROM b{i - 1} b JOIN k ky ON ky.j = b.y JOIN k kx ON kx.j = b.x WHERE b.s >= {i} GROUP BY b.clip, b.frame, ky.i, kx.i, b.s UNION ALL SELECT * FROM b{i - 1} WHERE s < {i})" for i in range(1, 8)]
    return ", ".join([first.replace("SELECT px.*, s", "SELECT px.clip, px.frame, y, x, g, s"), *steps]) + " SELECT clip, frame, y * 8 + x AS place, round(1 - g, 6) AS value FROM b7"


@query(_fill_sql(), "vectors")
def mask_fill(spark, sf_dir: str) -> DataFrame:
    """Masks that are almost full, blurred from their gaps until nothing is full: as many steps as the clip needs."""
    out = images.filled_masks(_masks(spark, sf_dir))
    return rounded(out.select("clip", "frame", F.posexplode("filled").alias("place", "value")), "value")


@query(
    f"{_CHAIN.replace('-1, 2', '-2, 3').replace('WHEN i + d < 0 THEN 1 WHEN i + d > 7 THEN 6', 'WHEN i + d < 0 THEN -(i + d) WHEN i + d > 7 THEN 14 - (i + d)').replace('1.28', '2.0')}, "
    "px AS (SELECT vec_id AS frame, p // 8 AS y, p % 8 AS x, CASE WHEN v[p + 1] > 0.2 THEN least(255, floor(v[p + 1] * 400)) ELSE 0 END AS m FROM (SELECT *, unnest(range(64)) AS p FROM vectors)), "
    "g1 AS (SELECT o.frame, o.y, o.x, o.m, max(CASE WHEN n.m > 0 THEN 1.0 ELSE 0.0 END) AS g FROM px o JOIN px n ON n.frame = o.frame AND ((n.x = o.x AND abs(n.y - o.y) <= 2) OR (n.y = o.y AND abs(n.x - o.x) <= 2)) GROUP BY ALL), "
    "g2 AS (SELECT frame, ky.i AS y, kx.i AS x, sum(ky.w * kx.w * g) AS g FROM g1 JOIN k ky ON ky.j = y JOIN k kx ON kx.j = x GROUP BY frame, ky.i, kx.i), "
    "g3 AS (SELECT frame, ky.i AS y, kx.i AS x, sum(ky.w * kx.w * g) AS g FROM g2 JOIN k ky ON ky.j = y JOIN k kx ON kx.j = x GROUP BY frame, ky.i, kx.i) "
    "SELECT frame, y * 8 + x AS place, round(m / 255 + (1 - m / 255) * g3.g, 6) AS value FROM g1 JOIN g3 USING (frame, y, x)",
    "vectors",
)
def mask_soft_border(spark, sf_dir: str) -> DataFrame:
    """Masks that keep their own values and get a soft border: dilated once by a cross of 5, blurred twice."""
    value = F.transform("v", lambda x: F.when(x > 0.2, F.least(F.lit(255), F.floor(x * 400))).otherwise(0))
    rows = bd.vectors(spark, sf_dir).select(F.col("vec_id").alias("frame"), F.lit(8).alias("height"), F.lit(8).alias("width"), _bytes(value).alias("pixels"))
    return rounded(images.grown_masks(rows, 1, 5, 1.0, 1).select("frame", F.posexplode("soft").alias("place", "value")), "value")


# --- a window's input ---------------------------------------------------------------------------------------------

# the vectors of a label are a clip of 8 x 8 frames
_WINDOW_IN = (
    "im AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, v FROM vectors), cn AS (SELECT clip, count(*) AS n FROM im GROUP BY clip), "
    "px AS (SELECT clip, frame, y, x, least(255, floor(abs(v[least(y, 7) * 8 + least(x, 7) + 1]) * 255)) AS g, CASE WHEN v[least(y, 7) * 8 + least(x, 7) + 1] > 0.2 THEN 1 ELSE 0 END AS m FROM im, (SELECT unnest(range(12)) AS y), (SELECT unnest(range(12)) AS x)), "
    "c1 AS (SELECT a.clip, a.frame, a.y, a.x, sum(b.m) AS m FROM px a JOIN px b ON b.clip = a.clip AND b.frame = a.frame AND ((b.y = a.y AND abs(b.x - a.x) <= 1) OR (b.x = a.x AND abs(b.y - a.y) = 1)) GROUP BY ALL), "
    "c2 AS (SELECT a.clip, a.frame, a.y, a.x, sum(b.m) > 7.5 AS hit FROM c1 a JOIN c1 b ON b.clip = a.clip AND b.frame = a.frame AND ((b.y = a.y AND abs(b.x - a.x) <= 1) OR (b.x = a.x AND abs(b.y - a.y) = 1)) GROUP BY ALL), "
    "pl AS (SELECT clip, n, unnest(range(CAST(greatest(1, ceil((n - 9) / 8)) * 8 + 9 AS BIGINT))) AS place FROM cn), "
    "pf AS (SELECT clip, place, CASE WHEN place % greatest(2 * n - 2, 1) < n THEN place % greatest(2 * n - 2, 1) ELSE 2 * n - 2 - place % greatest(2 * n - 2, 1) END AS frame FROM pl)"
)


def _window_input(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    order = Window.partitionBy("label").orderBy("vec_id")
    v = bd.vectors(spark, sf_dir).select(F.col("label").alias("clip"), (F.row_number().over(order) - 1).cast("long").alias("frame"), "v")
    byte = F.transform("v", lambda x: F.least(F.lit(255), F.floor(F.abs(x) * 255)))
    mask = F.transform("v", lambda x: F.when(x > 0.2, 200).otherwise(3))
    frames = v.select("clip", "frame", F.lit(8).alias("height"), F.lit(8).alias("width"), byte.alias("p"), mask.alias("m")).select("clip", "frame", "height", "width", _bytes("p").alias("pixels"), _bytes("m").alias("mask"))
    return preprocess.prepared(frames, v.groupBy("clip").agg(F.count("*").alias("num_frames")), True, 17, 9, 6, 3, 2, 0.3)


@query(f"{_WINDOW_IN} SELECT pf.clip, place, y * 12 + x AS at, round(CASE WHEN hit THEN 0 ELSE g / 255 END, 6) AS value FROM pf JOIN px USING (clip, frame) JOIN c2 USING (clip, frame, y, x)", "vectors")
def window_masked(spark, sf_dir: str) -> DataFrame:
    """Each clip as one window: padded, mirrored to whole batches, and 0 under the thickened mask."""
    masked, _ = _window_input(spark, sf_dir)
    return rounded(masked.select("clip", "place", F.posexplode("values").alias("at", "value")), "value")


@query(f"{_WINDOW_IN}, lt AS (SELECT pf.clip, CASE WHEN place = 0 THEN 0 ELSE (place - 1) // 8 + 1 END AS part, y * 12 + x AS pos, bool_or(hit) AS hit FROM pf JOIN c2 USING (clip, frame) GROUP BY ALL) SELECT clip, part, pos AS at, round(CASE WHEN hit THEN CASE WHEN part = 0 THEN 1 ELSE 255 END ELSE 0 END * (0.299 / 255 + 0.587 / 255 + 0.0004), 6) AS value FROM lt", "vectors")
def window_latents(spark, sf_dir: str) -> DataFrame:
    """The same window's mask, eight frames to one, as grey."""
    _, latents = _window_input(spark, sf_dir)
    return rounded(latents.select("clip", "part", F.posexplode("values").alias("at", "value")), "value")


# the frames of a clip: as many of a label's vectors as make 4 equal groups behind the first
_ENCODE = "im AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, v FROM vectors), cn AS (SELECT clip, count(*) AS n, (count(*) - 1) // 4 * 4 + 1 AS num_frames FROM im GROUP BY clip), px AS (SELECT im.clip, frame, num_frames, p // 8 AS y, p % 8 AS x, greatest(v[p + 1], v[64 - p]) AS m FROM im JOIN cn USING (clip), (SELECT unnest(range(64)) AS p) WHERE frame < num_frames)"


def _mask_pixels(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    order = Window.partitionBy("label").orderBy("vec_id")
    v = bd.vectors(spark, sf_dir).select(F.col("label").alias("clip"), (F.row_number().over(order) - 1).cast("long").alias("frame"), "v")
    clips = v.groupBy("clip").agg((F.expr("(count(*) - 1) div 4 * 4 + 1")).alias("num_frames"))
    channels = v.join(clips, "clip").where("frame < num_frames").select("clip", "frame", F.posexplode(F.array("v", F.reverse("v"))).alias("channel", "v"))
    pixels = channels.select("clip", "frame", "channel", F.posexplode("v").alias("p", "mask"))
    return pixels.select("clip", "frame", F.lit(8).alias("height"), F.lit(8).alias("width"), F.expr("CAST(p div 8 AS bigint)").alias("y"), F.expr("CAST(p % 8 AS bigint)").alias("x"), "channel", "mask"), clips


_PARTS = "CASE WHEN frame = 0 THEN 0 ELSE (frame - 1) // ((num_frames - 1) // 4) + 1 END"


@query(f"{_ENCODE}, yy AS (SELECT unnest(range(3)) AS oy), xx AS (SELECT unnest(range(5)) AS ox) SELECT clip, {_PARTS} AS part, oy AS y, ox AS x, round(max(m), 6) AS mask FROM px JOIN yy ON y = oy * 8 // 3 JOIN xx ON x = ox * 8 // 5 GROUP BY ALL", "vectors")
def mask_encode(spark, sf_dir: str) -> DataFrame:
    """Two channels of masks at 3 x 5 places and in five parts of time."""
    pixels, clips = _mask_pixels(spark, sf_dir)
    return rounded(masks.encoded(pixels, clips, 3, 5, 5), "mask")


@query(f"{_ENCODE} SELECT clip, {_PARTS} AS part, y // 3 AS y, x // 3 AS x, max(CASE WHEN m > 0.3 THEN 1.0 ELSE 0.0 END) AS mask FROM px WHERE y < 6 AND x < 6 GROUP BY ALL", "vectors")
def mask_encode_pooled(spark, sf_dir: str) -> DataFrame:
    """The same with blocks of 3 x 3 that are on if any pixel is."""
    pixels, clips = _mask_pixels(spark, sf_dir)
    return masks.encoded(pixels.withColumn("mask", F.col("mask") - 0.3), clips, 3, 3, 5, pool=True)


# --- layers -------------------------------------------------------------------------------------------------------

_GELU = "0.5 * {0} * (1 + tanh(0.7978845608028654 * ({0} + 0.044715 * {0} * {0} * {0})))"


@query(
    "fw AS (SELECT label AS n, min(vec_id) AS f FROM vectors GROUP BY label), w1 AS (SELECT n, v, n * 0.1 AS bias FROM fw JOIN vectors ON vec_id = f), "
    f"h AS (SELECT a.vec_id, w1.n, list_dot_product(a.v, w1.v) + bias AS z FROM vectors a, w1), g AS (SELECT vec_id, list({_GELU.format('z')} ORDER BY n) AS v FROM h GROUP BY vec_id), "
    "w2 AS (SELECT n, v[1:len(v) // 6] AS v, 0.5 - n AS bias FROM w1) "
    "SELECT g.vec_id AS m, w2.n, round(list_dot_product(g.v, w2.v[1:len(g.v)]) + bias, 6) AS y FROM g, w2",
    "vectors",
)
def feed_forward(spark, sf_dir: str) -> DataFrame:
    """Two layers over all vectors: ten rows of weights, GELU, and ten rows over its ten numbers."""
    v = bd.vectors(spark, sf_dir)
    first = v.join(v.groupBy("label").agg(F.min("vec_id").alias("vec_id")), ["label", "vec_id"]).select(F.col("label").cast("long").alias("n"), F.col("v").alias("w"))
    second = first.select("n", F.slice("w", 1, 10).alias("w"), (0.5 - F.col("n")).alias("bias"))
    out = layers.feed_forward(v.select(F.col("vec_id").alias("m"), F.col("v").alias("x")), first.withColumn("bias", F.col("n") * 0.1), second, ar.gelu)
    return rounded(out, "y")


@query(
    "s AS (SELECT clip, frame, value, 1000 - frame * 12 AS t FROM frames), c AS (SELECT *, NOT (100 < t AND t < 800) OR frame % 3 = 0 AS computed FROM s) "
    "SELECT clip, frame, computed, last_value(CASE WHEN computed THEN value END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM c",
    "frames",
)
def attention_broadcast(spark, sf_dir: str) -> DataFrame:
    """Steps that give the last computed value again, inside a range of time steps and but for every third."""
    rows = bd.frames(spark, sf_dir).select(F.col("clip").alias("branch"), F.col("frame").alias("step"), "value", (1000 - F.col("frame") * 12).alias("t"))
    out = reuse.broadcast_steps(rows, (100, 800), 3)
    return out.select(F.col("branch").alias("clip"), F.col("step").alias("frame"), "computed", "value")
