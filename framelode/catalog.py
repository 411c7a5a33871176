"""All queries over the engine's own operators, each with the DuckDB SQL that checks it.

Tables of events, orders, line items and embeddings play clips, tasks, boxes and tensors (see bindings.py). Floating
results are rounded on both sides.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode import bindings as bd
from framelode.functions import arrays as ar
from framelode.functions import numbers as nb
from framelode.operators import images, layers, masks, overlap, quality, reuse, statistics, tasks, tensors, timing
from framelode.plans import shards, windows
from framelode.streaming import frames as streams

FLAGSHIP = "window_plan"
INFER, OVERLAP = 17, 3
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *names: str):
    """Registers a query under its function's name; names: bindings that stand before the SQL, which begins with its
    own WITH parts or SELECT."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            parts = [bd.SQL[n] for n in names]
            ORACLES[f.__name__] = f"WITH {', '.join(parts)}" + (f", {body}" if not body.startswith("SELECT") else f" {body}") if parts else body
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


# --- windows ------------------------------------------------------------------------------------------------------

_K = f"k AS (SELECT *, unnest(range(1 + greatest(CAST(ceil((num_frames - {INFER}) / {INFER - OVERLAP}) AS BIGINT), 0))) AS i FROM clips)"
_D = f"d AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE {INFER} + (i - 1) * {INFER - OVERLAP} END AS deal_start, CASE WHEN i = 0 THEN 0 ELSE {OVERLAP} END AS overlap_left FROM k)"
_P = f"p AS (SELECT clip, i AS window_index, 0 AS scene_index, 0 AS scene_start, num_frames AS scene_end, deal_start - overlap_left AS load_start, deal_start + least(num_frames - deal_start, {INFER} - overlap_left) AS load_end, deal_start, least({INFER} - overlap_left, num_frames - deal_start) AS deal_length, least(num_frames - deal_start, {INFER} - overlap_left) AS load_length, overlap_left, CASE WHEN deal_start + least({INFER} - overlap_left, num_frames - deal_start) < num_frames THEN {OVERLAP} ELSE 0 END AS overlap_right FROM d)"
_PLAN = f"{_K}, {_D}, {_P}"


def _plan(spark, sf_dir: str) -> DataFrame:
    return windows.window_plan(windows.whole_clips(bd.clips(spark, sf_dir)), INFER, OVERLAP)


@query(f"{_PLAN} SELECT * FROM p", "clips")
def window_plan(spark, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(f"{_PLAN} SELECT clip, window_index, load_start AS stable_start, deal_start + deal_length - overlap_right AS stable_end FROM p", "clips")
def stable_ranges(spark, sf_dir: str) -> DataFrame:
    return windows.stable_ranges(_plan(spark, sf_dir))


@query(f"{_PLAN} SELECT f.clip, f.frame, window_index, f.frame - load_start AS place, value FROM frames f JOIN p ON f.clip = p.clip AND f.frame >= load_start AND f.frame < load_end", "frames", "clips")
def frame_to_window(spark, sf_dir: str) -> DataFrame:
    return windows.frame_windows(bd.frames(spark, sf_dir).select("clip", "frame", "value"), _plan(spark, sf_dir))


def _scenes(spark, sf_dir: str) -> DataFrame:
    """Three scenes for each clip, one with a negative start, one too long, one behind the end."""
    clips = bd.clips(spark, sf_dir)
    spec = "explode(array(struct(-5L AS start, 20L AS length), struct(20L AS start, 1000L AS length), struct(5000L AS start, 3L AS length)))"
    return clips.select("clip", "num_frames", F.expr(spec).alias("s")).select("clip", "num_frames", "s.*")


_SCENES = "sc AS (SELECT clip, num_frames, 0 AS scene_start, 20 AS scene_end, 0 AS scene_index FROM clips UNION ALL SELECT clip, num_frames, 20, num_frames, 1 FROM clips)"


@query(f"{_SCENES} SELECT clip, num_frames, scene_start, scene_end, scene_index FROM sc", "clips")
def scene_normalize(spark, sf_dir: str) -> DataFrame:
    return windows.normalized_scenes(_scenes(spark, sf_dir))


@query(
    f"{_SCENES}, sk AS (SELECT *, 1 + greatest(CAST(ceil((scene_end - scene_start - {INFER}) / {INFER - OVERLAP}) AS BIGINT), 0) AS windows FROM sc), "
    f"si AS (SELECT *, coalesce(sum(windows) OVER (PARTITION BY clip ORDER BY scene_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, unnest(range(windows)) AS i FROM sk), "
    f"sd AS (SELECT *, CASE WHEN i = 0 THEN scene_start ELSE scene_start + {INFER} + (i - 1) * {INFER - OVERLAP} END AS deal_start, CASE WHEN i = 0 THEN 0 ELSE {OVERLAP} END AS overlap_left FROM (SELECT clip, num_frames, scene_index, scene_start, scene_end, i, windows, sum(CASE WHEN scene_index = 0 THEN 0 ELSE 0 END) OVER () AS z FROM si) si2) "
    f"SELECT clip, CAST((SELECT coalesce(sum(b.windows), 0) FROM sk b WHERE b.clip = sd.clip AND b.scene_index < sd.scene_index) + i AS BIGINT) AS window_index, scene_index, scene_start, scene_end, deal_start - overlap_left AS load_start, deal_start + least(num_frames - deal_start, {INFER} - overlap_left) AS load_end, deal_start, least({INFER} - overlap_left, scene_end - deal_start) AS deal_length, least(num_frames - deal_start, {INFER} - overlap_left) AS load_length, overlap_left, CASE WHEN deal_start + least({INFER} - overlap_left, scene_end - deal_start) < scene_end THEN {OVERLAP} ELSE 0 END AS overlap_right FROM sd",
    "clips",
)
def window_plan_scenes(spark, sf_dir: str) -> DataFrame:
    return windows.window_plan(windows.normalized_scenes(_scenes(spark, sf_dir)), INFER, OVERLAP)


@query("SELECT clip, CAST(greatest(1, ceil((num_frames - 1) / 8)) AS BIGINT) AS head_batches, CAST(greatest(1, ceil((num_frames - 1) / 8)) * 8 + 1 - num_frames AS BIGINT) AS head_padded, CAST(ceil(num_frames / 8) AS BIGINT) AS batches, CAST(ceil(num_frames / 8) * 8 - num_frames AS BIGINT) AS padded, CAST(least(121, 9 + greatest(8, ((num_frames + 7) // 8) * 8)) AS BIGINT) AS compact FROM clips", "clips")
def pad_plan(spark, sf_dir: str) -> DataFrame:
    n = F.col("num_frames")
    head, tail = windows.pad_plan(n, F.lit(True), 9, 1), windows.pad_plan(n, F.lit(False), 9, 1)
    return bd.clips(spark, sf_dir).select("clip", head[0].cast("long").alias("head_batches"), head[1].cast("long").alias("head_padded"), tail[0].cast("long").alias("batches"), tail[1].cast("long").alias("padded"), windows.compact_length(n, F.lit(False), 121, 9).cast("long").alias("compact"))


@query("m AS (SELECT *, unnest(range(150)) AS place FROM clips) SELECT clip, place, CASE WHEN place % (2 * num_frames - 2) < num_frames THEN place % (2 * num_frames - 2) ELSE 2 * num_frames - 2 - place % (2 * num_frames - 2) END AS source FROM m", "clips")
def mirror_pad_index(spark, sf_dir: str) -> DataFrame:
    places = bd.clips(spark, sf_dir).withColumn("place", F.explode(F.expr("sequence(0L, 149L)")))
    return places.select("clip", "place", windows.mirror_source(F.col("place"), F.col("num_frames")).alias("source"))


@query("m AS (SELECT *, unnest(range(200)) AS place FROM clips) SELECT clip, place, least(place, num_frames - 1) AS last_source, CASE WHEN place < num_frames THEN place WHEN (place - num_frames) % (2 * num_frames - 2) < num_frames THEN num_frames - 1 - (place - num_frames) % (2 * num_frames - 2) ELSE (place - num_frames) % (2 * num_frames - 2) - num_frames + 1 END AS mirror_source FROM m", "clips")
def repeat_frames(spark, sf_dir: str) -> DataFrame:
    return windows.repeated_frames(bd.clips(spark, sf_dir), 200)


@query("SELECT clip, frame, value FROM frames WHERE frame < 5 OR frame >= 30", "frames")
def passthrough_gap(spark, sf_dir: str) -> DataFrame:
    ranges = bd.clips(spark, sf_dir).select("clip", F.lit(5).cast("long").alias("stable_start"), F.lit(30).cast("long").alias("stable_end"))
    return windows.passthrough(bd.frames(spark, sf_dir).select("clip", "frame", "value"), ranges)


@query("m AS (SELECT clip, num_frames, unnest(range(24)) AS place FROM clips) SELECT m.clip, place, frame, value FROM m JOIN frames f ON f.clip = m.clip AND f.frame = place * num_frames // 24", "frames", "clips")
def nearest_downsample(spark, sf_dir: str) -> DataFrame:
    return masks.nearest_frames(bd.frames(spark, sf_dir), bd.clips(spark, sf_dir), 24).select("clip", "place", "frame", "value")


# --- masks and boxes ----------------------------------------------------------------------------------------------


@query("SELECT clip, frame, CASE WHEN (SELECT max(value) FROM frames) <= 0 OR value <= (SELECT max(value) FROM frames) * 0.3 THEN 0 ELSE 255 END AS mask FROM frames", "frames")
def mask_binarize_global(spark, sf_dir: str) -> DataFrame:
    return masks.binarized(bd.frames(spark, sf_dir), 0.3).select("clip", "frame", "mask")


@query("t AS (SELECT clip, max(value) AS top FROM frames GROUP BY clip) SELECT f.clip, frame, CASE WHEN top <= 0 OR value <= top * 0.5 THEN 0 ELSE 255 END AS mask FROM frames f JOIN t USING (clip)", "frames")
def mask_binarize_clip(spark, sf_dir: str) -> DataFrame:
    return masks.binarized(bd.frames(spark, sf_dir), 0.5, "clip").select("clip", "frame", "mask")


@query("SELECT clip, frame, CASE WHEN frame % 10 = 3 THEN 255 WHEN value > 20.0 THEN 255 ELSE 0 END AS mask FROM frames", "frames")
def mask_threshold_nan(spark, sf_dir: str) -> DataFrame:
    threshold = F.when(F.col("frame") % 10 == 3, F.lit(float("nan"))).otherwise(F.lit(20.0))
    return bd.frames(spark, sf_dir).select("clip", "frame", masks.thresholded(F.col("value"), threshold).alias("mask"))


@query("SELECT clip, CASE WHEN frame < 1 THEN 0 ELSE (frame - 1) // 8 + 1 END AS part, CASE WHEN max(CASE WHEN value > 60 THEN 255 ELSE 0 END) >= 1 THEN 255 ELSE 0 END AS mask FROM frames GROUP BY ALL", "frames")
def temporal_compress(spark, sf_dir: str) -> DataFrame:
    rows = bd.frames(spark, sf_dir).withColumn("mask", F.when(F.col("value") > 60, 255).otherwise(0))
    return masks.temporal_groups(rows)


@query("SELECT clip, frame, round(0.299 / 255 * value + 0.587 / 255 * (value + 1) + 0.0004 * (value + 2), 6) AS gray FROM frames", "frames")
def mask_gray(spark, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return bd.frames(spark, sf_dir).select("clip", "frame", F.round(masks.gray(v, v + 1, v + 2), 6).alias("gray"))


@query("SELECT object, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2 FROM boxes WHERE x > 0 OR y > 0 OR x + w > 0 OR y + h > 0 GROUP BY object HAVING max(x + w) > min(x) AND max(y + h) > min(y)", "boxes")
def max_bbox(spark, sf_dir: str) -> DataFrame:
    return masks.union_boxes(bd.boxes(spark, sf_dir))


_ALIGN = (
    "s AS (SELECT *, greatest(sqrt(4096.0 / (w * h)), 1.0) AS k FROM boxes WHERE w > 0 AND h > 0), "
    "t AS (SELECT *, CAST(ceil(least(ceil(w * k), 640) / 32) * 32 AS BIGINT) AS tw, CAST(ceil(least(ceil(h * k), 360) / 32) * 32 AS BIGINT) AS th FROM s), "
    "u AS (SELECT *, CAST(CASE WHEN tw > th THEN greatest(least(tw, ceil((4096 // th) / 32) * 32), ceil(w / 32) * 32) ELSE tw END AS BIGINT) AS uw, CAST(CASE WHEN tw > th THEN th ELSE greatest(least(th, ceil((4096 // tw) / 32) * 32), ceil(h / 32) * 32) END AS BIGINT) AS uh FROM t), "
    "f AS (SELECT *, least(uw, 640) AS bw, least(uh, 352) AS bh FROM u) "
    "SELECT object, frame, least(greatest(0, (2 * x + w) // 2 - bw // 2), 640 - bw) AS bx, least(greatest(0, (2 * y + h) // 2 - bh // 2), 360 - bh) AS \"by\", bw, bh FROM f"
).replace("FROM boxes", "FROM {0}")


@query(_ALIGN.format("boxes"), "boxes")
def bbox_align(spark, sf_dir: str) -> DataFrame:
    return masks.aligned_boxes(bd.boxes(spark, sf_dir), 640, 360, 32, 4096)


@query("ob AS (SELECT object, frame, CASE WHEN h > 0 THEN x ELSE 0 END AS x, CASE WHEN h > 0 THEN y ELSE 0 END AS y, CASE WHEN h > 0 THEN w ELSE 640 END AS w, CASE WHEN h > 0 THEN h ELSE 360 END AS h FROM boxes), " + _ALIGN.format("ob"), "boxes")
def crop_boxes(spark, sf_dir: str) -> DataFrame:
    """Aligned boxes, and the whole frame where a box has no area."""
    return masks.aligned_boxes(masks.boxes_or_frames(bd.boxes(spark, sf_dir), 640, 360), 640, 360, 32, 4096)


@query(
    f"{_PLAN} SELECT p.clip, window_index, min(CAST(frame % 7 AS BIGINT)) AS x1, min(CAST(frame % 5 AS BIGINT)) AS y1, max(CAST(frame % 7 + trunc(value) AS BIGINT)) AS x2, max(CAST(frame % 5 + frame % 3 AS BIGINT)) AS y2 FROM p JOIN frames f ON f.clip = p.clip AND f.frame >= deal_start AND f.frame < deal_start + deal_length WHERE trunc(value) > 0 AND frame % 3 > 0 GROUP BY p.clip, window_index",
    "frames",
    "clips",
)
def window_bbox(spark, sf_dir: str) -> DataFrame:
    box = bd.frames(spark, sf_dir).select("clip", "frame", F.expr("frame % 7").alias("x1"), F.expr("frame % 5").alias("y1"), F.expr("frame % 7 + CAST(value AS BIGINT)").alias("x2"), F.expr("frame % 5 + frame % 3").alias("y2"))
    return masks.window_boxes(box, _plan(spark, sf_dir))


# --- overlaps -----------------------------------------------------------------------------------------------------

_RAMPS = {
    "linear": f"1 - a.place / {OVERLAP - 1}",
    "cosine": f"cos(a.place / {OVERLAP - 1} * 1.5707963267948966)",
    "sigmoid": f"1 / (1 + exp(a.place / {OVERLAP - 1} * 12 - 6))",
    "value:0.25": "0.25",
    "before": "1.0",
    "after": "0.0",
}


def _outputs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What each window made of its frames: value and ten for each window before."""
    plan = _plan(spark, sf_dir)
    placed = windows.frame_windows(bd.frames(spark, sf_dir).select("clip", "frame", "value"), plan)
    return placed.withColumn("value", F.col("value") + F.col("window_index") * 10), plan


def _blend(name: str, mode: str, whole: bool) -> None:
    mixed = f"CASE WHEN b.value IS NOT NULL AND a.place < a.overlap_left THEN ({_RAMPS[mode]}) * b.value + (1 - ({_RAMPS[mode]})) * a.value ELSE a.value END"
    out = f"round_even(least(greatest({mixed}, 0), 255), 0)" if whole else mixed
    sql = (
        f"{_PLAN}, w AS (SELECT f.clip, f.frame, window_index, f.frame - load_start AS place, value + window_index * 10 AS value, overlap_left, deal_start + deal_length AS deal_end FROM frames f JOIN p ON f.clip = p.clip AND f.frame >= load_start AND f.frame < load_end), "
        f"x AS (SELECT a.clip, a.frame, a.window_index, {out} AS mixed, row_number() OVER (PARTITION BY a.clip, a.frame ORDER BY a.window_index DESC) AS r, count(*) OVER (PARTITION BY a.clip, a.frame) AS windows FROM w a LEFT JOIN w b ON b.clip = a.clip AND b.frame = a.frame AND b.window_index = a.window_index - 1 WHERE a.frame < a.deal_end) "
        "SELECT clip, frame, round(mixed, 6) AS value, windows FROM x WHERE r = 1"
    )

    def run(spark, sf_dir: str) -> DataFrame:
        placed, plan = _outputs(spark, sf_dir)
        return rounded(overlap.blended(placed, plan, mode, whole), "value")

    run.__name__ = name
    query(sql, "frames", "clips")(run)


for _name, _mode, _whole in (("blend_linear", "linear", False), ("blend_cosine", "cosine", False), ("blend_sigmoid", "sigmoid", False), ("blend_value", "value:0.25", False), ("blend_before", "before", False), ("blend_after", "after", False), ("blend_linear_bytes", "linear", True)):
    _blend(_name, _mode, _whole)


# --- quality ------------------------------------------------------------------------------------------------------

# an embedding is a frame of 8 x 8 bytes, the next one the candidate
_BYTE = "CAST(least(255, floor(abs({}) * 255)) AS DOUBLE)"
_PIXELS = f"px AS (SELECT a.label AS clip, a.vec_id AS frame, unnest(range(len(a.v))) AS place, unnest(a.v) AS r, unnest(b.v) AS c FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1), pm AS (SELECT clip, frame, place, place // 8 AS y, place % 8 AS x, {_BYTE.format('r')} AS reference, {_BYTE.format('c')} AS candidate, CASE WHEN place % 4 = 0 AND frame % 5 <> 0 AND place < 40 THEN 1 ELSE 0 END AS mask FROM px)"
#: Weights of an 11-wide Gaussian with sigma 1.5 on a mirrored axis of 8: k (i, j, w).
_KERNEL = "d AS (SELECT unnest(range(-5, 6)) AS d), g AS (SELECT d, exp(-d * d / 4.5) / (SELECT sum(exp(-d * d / 4.5)) FROM d) AS g FROM d), k AS (SELECT i, CASE WHEN abs(i + d) > 7 THEN 14 - abs(i + d) ELSE abs(i + d) END AS j, sum(g) AS w FROM (SELECT unnest(range(8)) AS i), g GROUP BY ALL)"
_QUALITY = (
    f"{_PIXELS}, {_KERNEL}, "
    "h AS (SELECT clip, frame, y, k.i AS x, sum(w * reference) AS ma, sum(w * candidate) AS mb, sum(w * reference * reference) AS aa, sum(w * candidate * candidate) AS bb, sum(w * reference * candidate) AS ab FROM pm JOIN k ON k.j = pm.x GROUP BY clip, frame, y, k.i), "
    "b AS (SELECT clip, frame, k.i AS y, x, sum(w * ma) AS ma, sum(w * mb) AS mb, sum(w * aa) AS aa, sum(w * bb) AS bb, sum(w * ab) AS ab FROM h JOIN k ON k.j = h.y GROUP BY clip, frame, k.i, x), "
    "e AS (SELECT p.clip, p.frame, p.place, max(n.mask) <> min(n.mask) AS edge FROM pm p JOIN pm n ON n.clip = p.clip AND n.frame = p.frame AND abs(n.y - p.y) <= 5 AND abs(n.x - p.x) <= 5 GROUP BY ALL), "
    "s AS (SELECT clip, frame, mask > 0 AS m, edge, abs(candidate - reference) AS d, (2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (aa - ma * ma + bb - mb * mb + 58.5225)) AS t FROM pm JOIN b USING (clip, frame, y, x) JOIN e USING (clip, frame, place)), "
    "q AS (SELECT clip, frame, avg(t) AS ssim, avg(d) AS mae, avg(d * d) AS mse, count(*) FILTER (m) AS mask_pixels, count(*) FILTER (edge) AS edge_pixels, avg(t) FILTER (m) AS mask_ssim, avg(d) FILTER (m) AS mask_mae, avg(t) FILTER (edge) AS edge_ssim, avg(d) FILTER (edge) AS edge_mae, avg(t) FILTER (NOT m) AS outside_ssim, avg(d) FILTER (NOT m) AS outside_mae FROM s GROUP BY clip, frame)"
)
_MEASURES = ["ssim", "mae", "mse", "mask_ssim", "mask_mae", "edge_ssim", "edge_mae", "outside_ssim", "outside_mae"]


def _bytes(column: str) -> Column:
    """An array of numbers in 0..255 as binary."""
    return F.unhex(F.array_join(F.transform(column, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))


def _image_pairs(spark, sf_dir: str) -> DataFrame:
    """clip, frame, height, width, and the arrays reference, candidate and mask."""
    byte = lambda v: F.transform(v, lambda x: F.least(F.lit(255), F.floor(F.abs(x) * 255)))
    a = bd.vectors(spark, sf_dir)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), byte("v").alias("candidate"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.when((p % 4 == 0) & (F.col("vec_id") % 5 != 0) & (p < 40), 1).otherwise(0))
    return a.join(b, "vec_id").select(F.col("label").alias("clip"), F.col("vec_id").alias("frame"), F.lit(8).alias("height"), F.lit(8).alias("width"), byte("v").alias("reference"), "candidate", mask.alias("mask"))


def _image_rows(spark, sf_dir: str) -> DataFrame:
    return _image_pairs(spark, sf_dir).select("clip", "frame", "height", "width", _bytes("reference").alias("pixels"), _bytes("candidate").alias("candidate"), _bytes("mask").alias("mask"))


def _compared(spark, sf_dir: str, *names: str) -> DataFrame:
    return images.compared(_image_rows(spark, sf_dir), names or None).drop("height", "width")


@query(f"{_QUALITY} SELECT clip, frame, mask_pixels, edge_pixels, {', '.join(f'round({m}, 6) AS {m}' for m in _MEASURES)} FROM q", "vectors")
def quality_frame(spark, sf_dir: str) -> DataFrame:
    return rounded(_compared(spark, sf_dir), *_MEASURES)


@query(f"{_PIXELS}, l AS (SELECT clip, frame, candidate - reference AS e, lag(candidate - reference) OVER (PARTITION BY clip, place ORDER BY frame) AS p FROM pm) SELECT clip, frame, round(avg(abs(e)), 6) AS mae, round(avg(abs(e - p)), 6) AS temporal_delta FROM l GROUP BY clip, frame", "vectors")
def quality_temporal(spark, sf_dir: str) -> DataFrame:
    pixels = _image_pairs(spark, sf_dir).select("clip", "frame", F.posexplode(F.arrays_zip("reference", "candidate")).alias("place", "p")).select("clip", "frame", "place", F.col("p.reference").cast("double").alias("reference"), F.col("p.candidate").cast("double").alias("candidate"))
    return rounded(quality.temporal_delta(pixels), "mae", "temporal_delta")


@query(f"{_QUALITY} SELECT clip, count(*) AS frames, round(avg(ssim), 6) AS ssim, round(avg(mae), 6) AS mae, round(avg(mask_mae), 6) AS mask_mae, round(avg(outside_mae), 6) AS outside_mae, round(min(ssim), 6) AS min_ssim, first(frame ORDER BY ssim, frame) AS min_frame FROM q GROUP BY clip", "vectors")
def quality_summary(spark, sf_dir: str) -> DataFrame:
    return rounded(quality.summary(_compared(spark, sf_dir, "ssim", "mae", "mask_mae", "outside_mae")), "ssim", "mae", "mask_mae", "outside_mae", "min_ssim")


_REPORT = (*_MEASURES, "temporal_delta")


@query(
    f"{_QUALITY}, l AS (SELECT clip, frame, candidate - reference AS e, lag(candidate - reference) OVER (PARTITION BY clip, place ORDER BY frame) AS p FROM pm), t AS (SELECT clip, frame, avg(abs(e - p)) AS temporal_delta FROM l GROUP BY clip, frame) "
    f"SELECT clip, count(*) AS frames, count(mask_ssim) AS mask_frames, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _REPORT)}, round(min(ssim), 6) AS min_ssim, round(min(mask_ssim), 6) AS min_mask_ssim, first(frame ORDER BY ssim, frame) AS worst_frame, first(frame ORDER BY mask_ssim, frame) FILTER (mask_ssim IS NOT NULL) AS worst_mask_frame FROM q JOIN t USING (clip, frame) GROUP BY clip",
    "vectors",
)
def quality_report(spark, sf_dir: str) -> DataFrame:
    """All 16 values of a comparison."""
    quality_rows = images.compared(images.with_before(_image_rows(spark, sf_dir)))
    return rounded(quality.report(quality_rows), *_REPORT, "min_ssim", "min_mask_ssim")


# --- timings and tasks --------------------------------------------------------------------------------------------


def _timings(spark, sf_dir: str) -> DataFrame:
    return bd.table(spark, sf_dir, "events").select(F.col("user_id").alias("request"), F.col("event_type").alias("stage"), F.col("value").alias("ms"))


@query("SELECT user_id AS request, event_type AS stage, round(sum(value), 4) AS ms, count(*) AS calls FROM events GROUP BY ALL")
def timing_stages(spark, sf_dir: str) -> DataFrame:
    return rounded(timing.stage_sums(_timings(spark, sf_dir)), "ms", digits=4)


@query("WITH s AS (SELECT user_id, event_type AS stage, sum(value) AS ms FROM events GROUP BY ALL) SELECT stage, count(*) AS requests, round(avg(ms), 4) AS mean_ms, round(median(ms), 4) AS median_ms, round(min(ms), 4) AS min_ms, round(max(ms), 4) AS max_ms, round(stddev_samp(ms), 4) AS std_ms FROM s GROUP BY stage")
def timing_summary(spark, sf_dir: str) -> DataFrame:
    return rounded(timing.spread(_timings(spark, sf_dir)), "mean_ms", "median_ms", "min_ms", "max_ms", "std_ms", digits=4)


@query("SELECT user_id AS request, round(sum(value) FILTER (event_type IN ('click', 'view')) / 1000, 6) AS seconds FROM events GROUP BY user_id")
def timing_pure(spark, sf_dir: str) -> DataFrame:
    return rounded(timing.pure_seconds(_timings(spark, sf_dir), ["click", "view"]), "seconds")


@query("SELECT event_type AS kind, user_id AS clip, count(*) AS calls, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS bytes, count(*) FILTER (event_id % 7 = 0) AS failures, first('e' || event_id % 3 ORDER BY event_id) FILTER (event_id % 7 = 0) AS first_error FROM events GROUP BY ALL")
def collective_profile(spark, sf_dir: str) -> DataFrame:
    e = bd.table(spark, sf_dir, "events")
    error = F.expr("CASE WHEN event_id % 7 = 0 THEN concat('e', event_id % 3) END")
    calls = e.select(F.col("event_type").alias("kind"), F.col("user_id").alias("clip"), F.col("event_id").alias("seq"), F.col("value").cast("long").alias("bytes"), error.alias("error"))
    return timing.collective_profile(calls)


@query("d AS (SELECT unnest(['queued', 'running', 'completed', 'failed', 'cancelled']) AS status) SELECT d.status, count(task_id) AS n FROM d LEFT JOIN tasks USING (status) GROUP BY d.status", "tasks")
def status_counts(spark, sf_dir: str) -> DataFrame:
    return timing.counted_over(bd.tasks(spark, sf_dir), "status", tasks.STATUSES)


@query("SELECT owner, first(task_id ORDER BY created_at DESC, task_id DESC) AS task_id, first(price ORDER BY created_at DESC, task_id DESC) AS price FROM tasks WHERE status = 'completed' GROUP BY owner", "tasks")
def latest_completed(spark, sf_dir: str) -> DataFrame:
    return tasks.latest_completed(bd.tasks(spark, sf_dir), "owner")


@query("c AS (SELECT created_at AS a, task_id AS t FROM tasks ORDER BY created_at, task_id LIMIT 1 OFFSET 99) SELECT task_id, status, created_at, true AS has_more FROM tasks, c WHERE created_at > a OR (created_at = a AND task_id > t) ORDER BY created_at, task_id LIMIT 50", "tasks")
def task_page(spark, sf_dir: str) -> DataFrame:
    rows = bd.tasks(spark, sf_dir)
    cursor = rows.orderBy("created_at", "task_id").limit(100).orderBy(F.desc("created_at"), F.desc("task_id")).first()
    return tasks.page(rows, 50, (cursor.created_at, cursor.task_id)).select("task_id", "status", "created_at", "has_more")


@query("n AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, task_id DESC) AS r FROM tasks WHERE status = 'completed') SELECT owner, task_id, CASE WHEN created_at + 31536000 <= 900000000 THEN 'ttl' ELSE 'overflow' END AS reason FROM n WHERE created_at + 31536000 <= 900000000 OR r > 2", "tasks")
def task_expire(spark, sf_dir: str) -> DataFrame:
    return tasks.expired(bd.tasks(spark, sf_dir), 900_000_000, 31_536_000, 2, "owner")


@query("SELECT owner, task_id, row_number() OVER (PARTITION BY owner ORDER BY created_at, task_id) - 1 AS position FROM tasks WHERE status = 'queued'", "tasks")
def queue_positions(spark, sf_dir: str) -> DataFrame:
    return tasks.queue_positions(bd.tasks(spark, sf_dir), "owner")


@query("SELECT task_id, status, created_at, CASE WHEN status = 'completed' THEN '/v1/videos/' || task_id || '/content' END AS content_url, status = 'completed' AS ended FROM tasks", "tasks")
def task_public(spark, sf_dir: str) -> DataFrame:
    return tasks.public(bd.tasks(spark, sf_dir))


@query("SELECT clip, frame, CAST(max(least(greatest(floor(value), 0), 99)) OVER (PARTITION BY clip ORDER BY frame) AS BIGINT) AS progress FROM frames", "frames")
def progress_running_max(spark, sf_dir: str) -> DataFrame:
    return tasks.progress(bd.frames(spark, sf_dir)).select("clip", "frame", F.col("progress").cast("long").alias("progress"))


@query("SELECT clip, CAST(least(94, 5 + floor(89 * 10 / num_frames)) AS BIGINT) AS progress FROM clips", "clips")
def progress_pipeline(spark, sf_dir: str) -> DataFrame:
    return bd.clips(spark, sf_dir).select("clip", tasks.pipeline_progress(F.lit(10), F.col("num_frames")).cast("long").alias("progress"))


_STATUS_OF = "CASE kind WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END"


@query(
    f"h AS (SELECT clip, frame, {_STATUS_OF} AS status FROM frames), l AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY clip ORDER BY frame), 'queued') AS before FROM h) "
    "SELECT clip, count(*) AS steps, count(*) FILTER (NOT ((before = 'queued' AND status IN ('running', 'cancelled')) OR (before = 'running' AND status IN ('completed', 'failed', 'cancelled')))) AS bad_steps, first(status ORDER BY frame DESC) AS last_status FROM l GROUP BY clip",
    "frames",
)
def task_history(spark, sf_dir: str) -> DataFrame:
    return tasks.valid_history(bd.frames(spark, sf_dir).select("clip", "frame", F.expr(_STATUS_OF).alias("status")))


# --- statistics ---------------------------------------------------------------------------------------------------


@query("x AS (SELECT label AS layer, unnest(v) AS x FROM vectors), a AS (SELECT layer, count(*) AS elements, max(abs(x)) AS max_abs, count(*) FILTER (abs(x) > 0.2) AS clipped FROM x GROUP BY ROLLUP (layer)) SELECT layer, elements, round(max_abs, 6) AS max_abs, clipped, 0 AS nonfinite, round(clipped / elements, 6) AS clipped_share FROM a", "vectors")
def activation_audit(spark, sf_dir: str) -> DataFrame:
    rows = bd.vectors(spark, sf_dir).select(F.col("label").alias("layer"), F.explode("v").alias("x"))
    return rounded(timing.clipped(rows, 0.2), "max_abs", "clipped_share")


def _channels(spark, sf_dir: str) -> DataFrame:
    return bd.vectors(spark, sf_dir).select("vec_id", "label", F.posexplode("v").alias("channel", "x"))


_CHANNELS = "ch AS (SELECT vec_id, label, unnest(range(len(v))) AS channel, unnest(v) AS x FROM vectors)"


@query(f"{_CHANNELS} SELECT channel, count(x) AS n, round(avg(x), 6) AS mean, round(sqrt(var_samp(x) + 1e-5), 6) AS std FROM ch GROUP BY channel", "vectors")
def channel_stats(spark, sf_dir: str) -> DataFrame:
    return rounded(statistics.channel_stats(_channels(spark, sf_dir)).withColumn("channel", F.col("channel").cast("long")), "mean", "std")


@query(f"{_CHANNELS}, m AS (SELECT channel, x, CASE WHEN label < channel % 12 THEN 1 ELSE 0 END AS mask FROM ch) SELECT channel, count(*) FILTER (mask > 0) AS n, round(coalesce(avg(x) FILTER (mask > 0), 0), 6) AS mean, round(CASE WHEN count(*) FILTER (mask > 0) = 0 THEN 1e-8 ELSE sqrt(var_samp(x) FILTER (mask > 0)) END, 6) AS std FROM m GROUP BY channel", "vectors")
def channel_stats_masked(spark, sf_dir: str) -> DataFrame:
    rows = _channels(spark, sf_dir).withColumn("mask", F.when(F.col("label") < F.col("channel") % 12, 1).otherwise(0))
    return rounded(statistics.masked_stats(rows).withColumn("channel", F.col("channel").cast("long")), "mean", "std")


@query(f"{_CHANNELS}, c AS (SELECT channel, avg(x) AS mc, sqrt(var_samp(x) + 1e-5) AS sc FROM ch WHERE label < 5 GROUP BY channel), s AS (SELECT channel, avg(x) AS ms, sqrt(var_samp(x) + 1e-5) AS ss FROM ch WHERE label >= 5 GROUP BY channel) SELECT vec_id, channel, round((x - mc) / sc * ss + ms, 6) AS y FROM ch JOIN c USING (channel) JOIN s USING (channel) WHERE label < 5", "vectors")
def adain(spark, sf_dir: str) -> DataFrame:
    rows = _channels(spark, sf_dir)
    out = statistics.transferred(rows.where("label < 5"), rows.where("label >= 5"))
    return rounded(out.select("vec_id", F.col("channel").cast("long").alias("channel"), "y"), "y")


@query("SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: abs(a.v[i] - b.v[i]))) / greatest(list_sum(list_transform(b.v, lambda t: abs(t))), 1e-12), 6) AS distance FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id - 1", "vectors")
def relative_l1(spark, sf_dir: str) -> DataFrame:
    now = bd.vectors(spark, sf_dir)
    before = now.select((F.col("vec_id") + 1).alias("vec_id"), F.col("v").alias("u"))
    return now.join(before, "vec_id").select("vec_id", F.round(ar.relative_l1(F.col("v"), F.col("u")), 6).alias("distance"))


_PAIRS = "pr AS (SELECT clip, frame // 8 AS part, value AS now, lag(value) OVER (PARTITION BY clip ORDER BY frame) AS before, CASE WHEN frame % 3 = 0 THEN 1 ELSE 0 END AS mask FROM frames), rs AS (SELECT clip, part, region, sum(abs(now - before)) AS num, sum(abs(before)) AS den FROM (SELECT *, unnest(['all', CASE WHEN mask > 0 THEN 'mask' ELSE 'background' END]) AS region FROM pr WHERE before IS NOT NULL) GROUP BY ALL)"


def _pairs(spark, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("clip").orderBy("frame")
    return bd.frames(spark, sf_dir).select("clip", F.floor(F.col("frame") / 8).alias("part"), F.col("value").alias("now"), F.lag("value").over(order).alias("before"), F.when(F.col("frame") % 3 == 0, 1).otherwise(0).alias("mask")).where("before IS NOT NULL")


@query(f"{_PAIRS} SELECT clip, part, region, round(num, 4) AS num, round(den, 4) AS den FROM rs", "frames")
def region_sums(spark, sf_dir: str) -> DataFrame:
    return rounded(statistics.region_sums(_pairs(spark, sf_dir)), "num", "den", digits=4)


@query(f"{_PAIRS} SELECT clip, round(max(num / greatest(den, 1e-12)), 6) AS distance FROM rs GROUP BY clip", "frames")
def region_distance(spark, sf_dir: str) -> DataFrame:
    return rounded(statistics.region_distance(statistics.region_sums(_pairs(spark, sf_dir))), "distance")


@query("SELECT event_id AS id, round(value + 3.0 * (value * 1.1 - value), 6) AS y FROM events")
def guidance_merge(spark, sf_dir: str) -> DataFrame:
    rows = bd.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("plain"), (F.col("value") * 1.1).alias("prompted"))
    return rounded(statistics.guided(rows, 3.0), "y")


@query("SELECT user_id AS id, round(sum(exp(value / 100) * value) / sum(exp(value / 100)), 6) AS value FROM events GROUP BY user_id")
def softmax_merge(spark, sf_dir: str) -> DataFrame:
    e = bd.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_type", (F.col("value") / 100).alias("s"), "value")
    tops = e.groupBy("id", "event_type").agg(F.max("s").alias("top"))
    parts = e.join(tops, ["id", "event_type"]).groupBy("id", "event_type", "top").agg(F.sum(F.exp(F.col("s") - F.col("top"))).alias("norm"), F.sum(F.exp(F.col("s") - F.col("top")) * F.col("value")).alias("value"))
    return rounded(statistics.merged_softmax(parts).select("id", "value"), "value")


# --- reuse of cached results --------------------------------------------------------------------------------------

_COEFFICIENTS = [0.5, 0.1]


def _probes(spark, sf_dir: str) -> DataFrame:
    return bd.frames(spark, sf_dir).select(F.col("clip").alias("branch"), F.col("frame").alias("step"), (F.col("value") / 1000).alias("distance"), F.when(F.col("frame") < 30, "a").otherwise("b").alias("layout"))


def _fold(condition: str, acc: str) -> str:
    reason = f"CASE WHEN f.frame < 3 THEN 'early' WHEN f.frame >= n.num_frames - 2 THEN 'late' WHEN f.frame = 30 THEN 'layout' WHEN s.run >= 4 THEN 'run' WHEN {condition} THEN 'skip' ELSE 'distance' END"
    return (
        "SELECT branch, step, reason = 'skip' AS skip, reason FROM (WITH RECURSIVE g AS (SELECT clip, frame, value / 1000 AS d FROM frames), "
        "s(branch, step, reason, acc, run) AS (SELECT clip, 0::BIGINT, 'early', CAST(0.0 AS DOUBLE), 0 FROM clips UNION ALL "
        f"SELECT branch, step, reason, CASE WHEN reason = 'skip' THEN {acc} ELSE 0.0 END, CASE WHEN reason = 'skip' THEN run + 1 ELSE 0 END FROM (SELECT s.branch, f.frame AS step, s.acc, s.run, f.d, {reason} AS reason FROM s JOIN g f ON f.clip = s.branch AND f.frame = s.step + 1 JOIN clips n ON n.clip = s.branch)) SELECT * FROM s)"
    )


@query(_fold("s.acc + (0.5 * f.d + 0.1) < 0.45", "acc + (0.5 * d + 0.1)"), "frames", "clips")
def teacache_decisions(spark, sf_dir: str) -> DataFrame:
    return reuse.accumulated(_probes(spark, sf_dir), 0.45, _COEFFICIENTS, 3, 2, 4)


@query(_fold("f.d < 0.05", "0.0"), "frames", "clips")
def cachedit_decisions(spark, sf_dir: str) -> DataFrame:
    return reuse.residual(_probes(spark, sf_dir), 0.05, 3, 2, 4)


@query(f"r AS ({_fold('f.d < 0.05', '0.0')}), c AS (SELECT branch, count(*) FILTER (NOT skip) AS computed, count(*) FILTER (skip) AS skipped FROM r GROUP BY branch) SELECT branch, computed, skipped, round(skipped / (computed + skipped), 6) AS hit_rate, round((computed + skipped) / computed, 6) AS speedup FROM c", "frames", "clips")
def cache_report(spark, sf_dir: str) -> DataFrame:
    return rounded(reuse.report(reuse.residual(_probes(spark, sf_dir), 0.05, 3, 2, 4)), "hit_rate", "speedup")


@query("SELECT event_type AS grp, CAST(sum(user_id) AS BIGINT) AS computed, CAST(sum(event_id % 5) AS BIGINT) AS skipped, round(sum(event_id % 5) / greatest(1, sum(user_id) + sum(event_id % 5)), 6) AS hit_rate FROM events WHERE event_id % 2 = 0 GROUP BY event_type")
def rank_reports(spark, sf_dir: str) -> DataFrame:
    e = bd.table(spark, sf_dir, "events").select(F.col("event_id").alias("rank"), F.col("event_type").alias("grp"), F.col("user_id").alias("computed"), F.expr("event_id % 5").alias("skipped"))
    return rounded(reuse.leaders(e, 2), "hit_rate")


# --- partition plans ----------------------------------------------------------------------------------------------


@query("r AS (SELECT clip AS id, num_frames AS length, unnest(range(4)) AS rank FROM clips), c AS (SELECT *, CAST(ceil(length / 4) AS BIGINT) AS size FROM r) SELECT id, rank, least(rank * size, length) AS first, least(least(rank * size, length) + size, length) AS last, size - (least(least(rank * size, length) + size, length) - least(rank * size, length)) AS padding FROM c", "clips")
def shard_plan(spark, sf_dir: str) -> DataFrame:
    return shards.padded_shards(bd.clips(spark, sf_dir).select(F.col("clip").alias("id"), F.col("num_frames").alias("length")), 4)


@query("r AS (SELECT clip AS id, num_frames AS length, unnest(range(3)) AS rank FROM clips) SELECT id, rank, length * rank // 3 AS first, length * (rank + 1) // 3 AS last FROM r", "clips")
def shard_plan_uneven(spark, sf_dir: str) -> DataFrame:
    return shards.uneven_shards(bd.clips(spark, sf_dir).select(F.col("clip").alias("id"), F.col("num_frames").alias("length")), 3)


@query("SELECT task_id, task_id % 3 AS worker, task_id // 3 AS round FROM tasks", "tasks")
def task_partition(spark, sf_dir: str) -> DataFrame:
    worker, turn = shards.strided(F.col("task_id"), 3)
    return bd.tasks(spark, sf_dir).select("task_id", worker.alias("worker"), turn.alias("round"))


@query("SELECT CAST(p_partkey AS BIGINT) AS rank, p_partkey // 2 AS sp_group, p_partkey % 2 AS sp_rank, p_partkey // 4 * 2 + p_partkey % 2 AS cfg_group, p_partkey // 2 % 2 AS cfg_rank FROM part")
def rank_topology(spark, sf_dir: str) -> DataFrame:
    return shards.topology(bd.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rank")), 2, 2)


@query("d AS (SELECT DISTINCT object, y FROM boxes), i AS (SELECT object, y, y - row_number() OVER (PARTITION BY object ORDER BY y) AS g FROM d), r AS (SELECT object, min(y) AS a, max(y) AS b FROM i GROUP BY object, g) SELECT object, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS runs FROM r GROUP BY object", "boxes")
def cpu_set_runs(spark, sf_dir: str) -> DataFrame:
    return shards.islands(bd.boxes(spark, sf_dir), "object", "y")


# --- vectors ------------------------------------------------------------------------------------------------------


def _per_element(column, spark, sf_dir: str) -> DataFrame:
    return bd.vectors(spark, sf_dir).select("vec_id", F.posexplode(column).alias("place", "y")).select("vec_id", F.col("place").cast("long").alias("place"), F.round(F.col("y").cast("double"), 6).alias("y"))


def _element_sql(expression: str, length: str = "len(v)") -> str:
    return f"e AS (SELECT vec_id, v, unnest(range({length})) AS place FROM vectors) SELECT vec_id, place, round({expression}, 6) AS y FROM e"


_SQUARE = "list_sum(list_transform(v, lambda t: t * t))"
_MEAN = "list_sum(v) / len(v)"


@query(_element_sql(f"v[place + 1] / sqrt({_SQUARE} / len(v) + 1e-6)"), "vectors")
def rms_norm(spark, sf_dir: str) -> DataFrame:
    return _per_element(ar.rms_norm(F.col("v")), spark, sf_dir)


@query(_element_sql(f"(v[place + 1] - {_MEAN}) / sqrt({_SQUARE} / len(v) - ({_MEAN}) * ({_MEAN}) + 1e-5)"), "vectors")
def layer_norm(spark, sf_dir: str) -> DataFrame:
    return _per_element(ar.layer_norm(F.col("v")), spark, sf_dir)


@query(_element_sql("v[place + 1] + 0.5 * v[len(v) - place]"), "vectors")
def gated_residual(spark, sf_dir: str) -> DataFrame:
    return _per_element(ar.gated(F.col("v"), F.reverse("v"), F.lit(0.5)), spark, sf_dir)


@query(_element_sql("v[place + 1] / (1 + exp(-v[place + 1])) * v[place + 33]", "32"), "vectors")
def silu_and_mul(spark, sf_dir: str) -> DataFrame:
    return _per_element(ar.halves_gated(F.col("v"), lambda v: v * ar.sigmoid(v)), spark, sf_dir)


@query(_element_sql("0.5 * v[place + 1] * (1 + tanh(0.7978845608028654 * (v[place + 1] + 0.044715 * v[place + 1] ** 3))) * v[place + 33]", "32"), "vectors")
def gelu_and_mul(spark, sf_dir: str) -> DataFrame:
    return _per_element(ar.halves_gated(F.col("v"), ar.gelu), spark, sf_dir)


_ANGLE = "vec_id * pow(10000.0, -(place // 2 * 2) / 64)"


@query(_element_sql(f"CASE WHEN place % 2 = 0 THEN v[place + 1] * cos({_ANGLE}) - v[place + 2] * sin({_ANGLE}) ELSE v[place + 1] * cos({_ANGLE}) + v[place] * sin({_ANGLE}) END"), "vectors")
def rotary_embedding(spark, sf_dir: str) -> DataFrame:
    return _per_element(ar.rotary(F.col("v"), F.col("vec_id")), spark, sf_dir)


@query("s AS (SELECT vec_id, v, list_max(list_transform(v, lambda t: abs(t))) / 127 AS scale FROM vectors), e AS (SELECT vec_id, scale, unnest(range(len(v))) AS place, unnest(v) AS x FROM s) SELECT vec_id, place, CAST(greatest(least(round_even(x / scale, 0), 127), -127) AS BIGINT) AS q, round(greatest(least(round_even(x / scale, 0), 127), -127) * scale, 6) AS y FROM e", "vectors")
def int8_roundtrip(spark, sf_dir: str) -> DataFrame:
    rows = bd.vectors(spark, sf_dir).withColumn("scale", ar.int8_scale(F.col("v")))
    return rows.select("vec_id", "scale", F.posexplode(ar.int8(F.col("v"), F.col("scale"))).alias("place", "q")).select("vec_id", F.col("place").cast("long").alias("place"), F.col("q").cast("long").alias("q"), F.round(F.col("q") * F.col("scale"), 6).alias("y"))


# --- scalars ------------------------------------------------------------------------------------------------------


@query("SELECT event_id, round(CASE WHEN event_id % 4 = 0 THEN 0.0 WHEN event_id % 4 = 1 THEN user_id ELSE user_id / 1001.0 END, 6) AS fps FROM events")
def frame_rates(spark, sf_dir: str) -> DataFrame:
    text = F.expr("CASE event_id % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN CAST(user_id AS STRING) ELSE concat(user_id, '/1001') END")
    return bd.table(spark, sf_dir, "events").select("event_id", F.round(nb.safe_fraction(text), 6).alias("fps"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE text END AS shown FROM documents")
def log_text(spark, sf_dir: str) -> DataFrame:
    return bd.table(spark, sf_dir, "documents").select("doc_id", nb.shortened(F.col("text")).alias("shown"))


@query("SELECT event_id, CAST(round_even(least(greatest(value / 100, 0), 1) * 255, 0) AS INTEGER) AS byte, round(trunc(least(value / 100, 1) * 255) / 255, 6) AS cut FROM events")
def byte_values(spark, sf_dir: str) -> DataFrame:
    x = F.col("value") / 100
    return bd.table(spark, sf_dir, "events").select("event_id", nb.to_byte(x).alias("byte"), F.round(nb.truncated(F.least(x, F.lit(1.0))), 6).alias("cut"))


@query("i AS (SELECT clip, frame AS i, num_frames AS n, num_frames // 2 AS k FROM frames JOIN clips USING (clip)) SELECT clip, i, round(1 - CASE WHEN i < k THEN i * 0.025 / k ELSE (k - 0.025 * n) / (k * pow(n - k, 2)) * i * i + (0.025 / k - 2 * (k - 0.025 * n) / pow(n - k, 2)) * i + (k - 0.025 * n) / (k * pow(n - k, 2)) * k * k END, 9) AS sigma FROM i", "frames", "clips")
def sigma_schedule(spark, sf_dir: str) -> DataFrame:
    """A schedule for each clip, a step for each of its frames."""
    steps = bd.frames(spark, sf_dir).select("clip", F.col("frame").alias("i")).join(bd.clips(spark, sf_dir), "clip")
    return steps.select("clip", "i", F.round(nb.linear_quadratic(F.col("i"), F.col("num_frames")), 9).alias("sigma"))


@query("SELECT event_id, round(least(255, floor(value)) / 255, 6) AS unit, round(least(255, floor(value)) / 255 * 2 - 1, 6) AS sign, round(least(greatest((value / 50 - 1) / 2 + 0.5, 0), 1), 6) AS back FROM events")
def frame_scaling(spark, sf_dir: str) -> DataFrame:
    """Bytes as values in [0, 1] and in [-1, 1], and values in [-1, 1] back."""
    byte = F.least(F.lit(255), F.floor(F.col("value")))
    rows = bd.table(spark, sf_dir, "events").select("event_id", nb.from_byte(byte).alias("unit"), nb.signed(nb.from_byte(byte)).alias("sign"), nb.unsigned(F.col("value") / 50 - 1).alias("back"))
    return rounded(rows, "unit", "sign", "back")


@query("SELECT f.clip, frame, greatest(0, frame - least(17, num_frames) // 2) AS start, least(17, num_frames) AS frames FROM frames f JOIN clips USING (clip)", "frames", "clips")
def window_index(spark, sf_dir: str) -> DataFrame:
    """The window around each frame: where it starts, and how many frames it may have."""
    rows = bd.frames(spark, sf_dir).select("clip", "frame").join(bd.clips(spark, sf_dir), "clip")
    return windows.around(rows, 17).select("clip", "frame", "start", "frames")


# --- streams ------------------------------------------------------------------------------------------------------


def _stream(spark, sf_dir: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/event[s].parquet")
    return rows.select(F.col("user_id").alias("clip"), "ts", "event_id", F.col("event_type").alias("kind"), "value")


def _folder(spark, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a local one only where that is unset and Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="framelode-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"{_PLAN} SELECT clip, window_index, load_start, load_end, load_start AS stable_start, load_start + {INFER - OVERLAP} AS stable_end FROM p WHERE load_end - load_start = {INFER}", "clips")
def stream_windows(spark, sf_dir: str) -> DataFrame:
    return streams.collected(streams.fired_windows(_stream(spark, sf_dir).select("clip", "ts"), INFER, OVERLAP), _folder(spark, "windows"), "append").drop("batch")


@query(f"{_PLAN} SELECT clip, window_index, load_start, load_end, load_start AS stable_start, deal_start + deal_length - overlap_right AS stable_end FROM p", "clips")
def stream_all_windows(spark, sf_dir: str) -> DataFrame:
    """All windows of the plan, each clip's tail too; stream_windows beside it knows no clip's end."""
    rows = _stream(spark, sf_dir).select("clip", "ts").join(bd.clips(spark, sf_dir), "clip")
    return streams.collected(streams.fired_windows(rows, INFER, OVERLAP), _folder(spark, "windows"), "append").drop("batch")


@query(ORACLES["task_history"])
def stream_task_states(spark, sf_dir: str) -> DataFrame:
    changes = _stream(spark, sf_dir).select("clip", "ts", "event_id", F.expr(_STATUS_OF).alias("status"))
    seen = streams.collected(streams.task_states(changes), _folder(spark, "states"), "update")
    return seen.groupBy("clip").agg(F.max(F.struct("batch", "steps", "bad_steps", "last_status")).alias("s")).select("clip", "s.steps", "s.bad_steps", "s.last_status")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def stream_daily_sums(spark, sf_dir: str) -> DataFrame:
    seen = streams.collected(streams.daily_sums(_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "30 days"), _folder(spark, "days"), "update")
    last = seen.groupBy("day", "kind").agg(F.max(F.struct("batch", "n", "value")).alias("s"))
    return rounded(last.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "kind", "s.n", "s.value"), "value", digits=4)


@query("g AS (SELECT clip, ts, CASE WHEN lag(ts) OVER (PARTITION BY clip ORDER BY ts) IS NULL OR ts >= lag(ts) OVER (PARTITION BY clip ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM frames), s AS (SELECT clip, ts, sum(new) OVER (PARTITION BY clip ORDER BY ts) AS session FROM g) SELECT clip, min(ts) AS start, count(*) AS frames FROM s GROUP BY clip, session", "frames")
def scene_sessions(spark, sf_dir: str) -> DataFrame:
    rows = bd.table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), "ts")
    return rows.groupBy("clip", F.session_window("ts", "12 hours").alias("s")).agg(F.count("*").alias("frames")).select("clip", F.col("s.start").alias("start"), "frames")


# --- tensors ------------------------------------------------------------------------------------------------------


def _cells(spark, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 grids."""
    return bd.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.posexplode("v").alias("place", "x")).select("id", F.expr("CAST(place div 8 AS BIGINT)").alias("row"), F.expr("CAST(place % 8 AS BIGINT)").alias("col"), "x")


_CELLS = "cells AS (SELECT vec_id AS id, unnest(range(64)) // 8 AS row, unnest(range(64)) % 8 AS col, unnest(v) AS x FROM vectors)"


@query(f"{_CELLS} SELECT id, row // 2 * 4 + col // 2 AS token, row % 2 * 2 + col % 2 AS place, round(x, 6) AS x FROM cells", "vectors")
def pack_patches(spark, sf_dir: str) -> DataFrame:
    return rounded(tensors.packed(_cells(spark, sf_dir), 2, 8), "x")


@query(f"{_CELLS} SELECT id, row, col, round(x, 6) AS x FROM cells", "vectors")
def unpack_patches(spark, sf_dir: str) -> DataFrame:
    return rounded(tensors.unpacked(tensors.packed(_cells(spark, sf_dir), 2, 8), 2, 8), "x")


@query(f"{_CHANNELS}, st AS (SELECT channel, avg(x) AS mean, sqrt(var_samp(x) + 1e-5) AS std FROM ch GROUP BY channel) SELECT vec_id, channel, round((x - mean) * 0.5 / std, 6) AS y FROM ch JOIN st USING (channel)", "vectors")
def normalize_latents(spark, sf_dir: str) -> DataFrame:
    rows = _channels(spark, sf_dir)
    out = tensors.normalized(rows, statistics.channel_stats(rows), 0.5)
    return rounded(out.select("vec_id", F.col("channel").cast("long").alias("channel"), "y"), "y")


@query(f"{_CHANNELS} SELECT a.vec_id AS m, b.label AS n, round(sum(a.x * b.x), 6) AS y FROM ch a JOIN (SELECT label, channel, avg(x) AS x FROM ch GROUP BY ALL) b USING (channel) GROUP BY ALL", "vectors")
def matrix_product(spark, sf_dir: str) -> DataFrame:
    """All vectors times the mean vector of each label, as a product of blocks."""
    rows = bd.vectors(spark, sf_dir)
    means = _channels(spark, sf_dir).groupBy("label", "channel").agg(F.avg("x").alias("x"))
    weights = means.groupBy(F.col("label").cast("long").alias("n")).agg(F.array_sort(F.collect_list(F.struct("channel", "x"))).alias("w")).select("n", F.transform("w", lambda c: c["x"]).alias("w"), F.lit(0.0).alias("bias"))
    return rounded(layers.linear(rows.select(F.col("vec_id").alias("m"), F.col("v").alias("x")), weights), "y")


@query("kq AS (SELECT vec_id AS q, v FROM vectors WHERE vec_id % 20 = 0), s AS (SELECT q, b.v AS value, exp(list_dot_product(a.v, b.v) * 8) AS w FROM kq a, vectors b), e AS (SELECT q, w, unnest(range(64)) AS place, unnest(value) AS x FROM s) SELECT q, place, round(sum(w * x) / sum(w), 6) AS y FROM e GROUP BY ALL", "vectors")
def attention(spark, sf_dir: str) -> DataFrame:
    """A search: every embedding whose id is divisible by 20 asks all embeddings."""
    rows = bd.vectors(spark, sf_dir)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "v")
    out = tensors.attention(asked, rows.select(F.col("vec_id").alias("k"), "v", F.col("v").alias("value")), 8.0)
    return rounded(out.select("q", F.col("place").cast("long").alias("place"), "y"), "y")


@query("w AS (SELECT a.vec_id AS q, exp(list_dot_product(a.v, b.v) * 8) AS w, b.v AS value FROM vectors a, vectors b), e AS (SELECT q, w, unnest(range(64)) AS place, unnest(value) AS x FROM w) SELECT q, place, round(sum(w * x) / sum(w), 6) AS y FROM e GROUP BY ALL", "vectors")
def attention_all(spark, sf_dir: str) -> DataFrame:
    """Every embedding asks all embeddings; in attention every twentieth does."""
    rows = bd.vectors(spark, sf_dir)
    out = tensors.attention(rows.select(F.col("vec_id").alias("q"), "v"), rows.select(F.col("vec_id").alias("k"), "v", F.col("v").alias("value")), 8.0)
    return rounded(out.select("q", F.col("place").cast("long").alias("place"), "y"), "y")


@query("e AS (SELECT clip, frame AS t, unnest(range(16)) AS place FROM frames) SELECT clip, t, place, round(CASE WHEN place < 8 THEN cos(t * pow(10000.0, -place / 8)) ELSE sin(t * pow(10000.0, -(place - 8) / 8)) END, 6) AS y FROM e", "frames")
def timestep_embedding(spark, sf_dir: str) -> DataFrame:
    """Each clip's frames as time steps."""
    out = tensors.timestep_embedding(bd.frames(spark, sf_dir).select("clip", F.col("frame").alias("t")), 16)
    return out.select("clip", "t", F.posexplode("emb").alias("place", "y")).select("clip", "t", F.col("place").cast("long").alias("place"), F.round("y", 6).alias("y"))


@query(f"r AS ({_fold('f.d < 0.05', '0.0')}), c AS (SELECT branch, step, value AS x, CASE WHEN step < 30 THEN 'a' ELSE 'b' END AS layout FROM r JOIN frames ON clip = branch AND frame = step WHERE NOT skip) SELECT branch, step + 1 AS step, round(x + coalesce((x - lag(x) OVER (PARTITION BY branch, layout ORDER BY step)) / (step - lag(step) OVER (PARTITION BY branch, layout ORDER BY step)), 0), 6) AS guess FROM c", "frames", "clips")
def bounded_prediction(spark, sf_dir: str) -> DataFrame:
    """What the steps that cachedit_decisions computes foretell for the step after each."""
    layout = F.when(F.col("frame") < 30, "a").otherwise("b")
    values = bd.frames(spark, sf_dir).select(F.col("clip").alias("branch"), F.col("frame").alias("step"), F.col("value").alias("x"), layout.alias("layout"))
    rows = reuse.residual(_probes(spark, sf_dir), 0.05, 3, 2, 4).where("NOT skip").select("branch", "step").join(values, ["branch", "step"])
    return rounded(tensors.predicted(rows), "guess")


@query("WITH p AS (SELECT p_partkey AS task, p_partkey % 7 * (p_partkey % 2) AS rank FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY task) - 1 AS round FROM p), g AS (SELECT a.rank, b.round FROM (SELECT unnest(range(8)) AS rank) a, (SELECT unnest(range((SELECT max(round) + 1 FROM r))) AS round) b) SELECT g.round, g.rank, task FROM g LEFT JOIN r ON r.rank = g.rank AND r.round = g.round")
def plan_rounds(spark, sf_dir: str) -> DataFrame:
    plan = bd.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task"), F.expr("p_partkey % 7 * (p_partkey % 2)").cast("long").alias("rank"))
    return tensors.rounds(plan, spark.range(8).select(F.col("id").alias("rank")))


@query("WITH d AS (SELECT DISTINCT l_orderkey AS row, l_suppkey AS col FROM lineitem), s AS (SELECT row, col, col - coalesce(lag(col) OVER (PARTITION BY row ORDER BY col), 0) AS delta FROM d) SELECT row, count(*) AS count, string_agg(delta, ',' ORDER BY col) AS deltas FROM s GROUP BY row")
def block_table(spark, sf_dir: str) -> DataFrame:
    pairs = bd.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_suppkey").alias("col"))
    return tensors.delta_table(pairs).withColumn("deltas", F.array_join("deltas", ","))


@query("SELECT clip, frame, value, value + 1 AS other FROM frames", "frames")
def paired_frames(spark, sf_dir: str) -> DataFrame:
    rows = bd.frames(spark, sf_dir).select("clip", "frame", "value")
    return tensors.paired(rows, rows.withColumn("value", F.col("value") + 1))


# the other modules of queries register themselves
from framelode import catalog_flow, catalog_layers, catalog_media, catalog_requests, catalog_tensor  # noqa: E402, F401
