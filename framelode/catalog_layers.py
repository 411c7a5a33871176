"""More queries with their SQL: layers over vectors, sizes and schedules, plans, shards, histories and seams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode import bindings as bd
from framelode.catalog import _PLAN, _element_sql, _per_element, _plan, query, rounded
from framelode.functions import arrays as ar
from framelode.functions import numbers as nb
from framelode.operators import overlap, statistics, tasks
from framelode.plans import shards, taskplans

# --- layers -------------------------------------------------------------------------------------------------------

_LN = "(({x}) - m) / sqrt(q - m * m + 1e-6)"
_MOMENTS = "list_sum({v}) / 64 AS m, list_sum(list_transform({v}, lambda t: t * t)) / 64 AS q"


def _normed_sql(of: str, expression: str) -> str:
    """Per element of the list `of`, with its mean m and mean square q."""
    return f"o AS (SELECT vec_id, {of} AS u FROM vectors), n AS (SELECT vec_id, u, {_MOMENTS.format(v='u')} FROM o), e AS (SELECT *, unnest(range(64)) AS place FROM n) SELECT vec_id, place, {expression} FROM e"


_GATED = "list_transform(range(1, 65), lambda i: v[i] + 0.5 * v[65 - i])"


@query(_normed_sql(_GATED, f"round({_LN.format(x='u[place + 1]')} * 1.2 + 0.1, 6) AS y, round(u[place + 1], 6) AS residual"), "vectors")
def residual_norm_scale_shift(spark, sf_dir: str) -> DataFrame:
    rows = bd.vectors(spark, sf_dir).withColumn("r", ar.gated(F.col("v"), F.reverse("v"), F.lit(0.5)))
    both = F.posexplode(F.arrays_zip(ar.shifted_norm(F.col("r"), F.lit(0.2), F.lit(0.1)).alias("y"), F.col("r").alias("r"))).alias("place", "e")
    return rows.select("vec_id", both).select("vec_id", F.col("place").cast("long").alias("place"), F.round("e.y", 6).alias("y"), F.round("e.r", 6).alias("residual"))


@query(_normed_sql("v", f"round({_LN.format(x='u[place + 1]')} * 1.2 + 0.1, 6) AS y"), "vectors")
def layer_norm_scale_shift(spark, sf_dir: str) -> DataFrame:
    return _per_element(ar.shifted_norm(F.col("v"), F.lit(0.2), F.lit(0.1)), spark, sf_dir)


@query(_normed_sql("v", "round(u[place + 1] / sqrt(q + 1e-6) * 1.2 + 0.1, 6) AS y"), "vectors")
def rms_norm_scale_shift(spark, sf_dir: str) -> DataFrame:
    return _per_element(ar.shifted_norm(F.col("v"), F.lit(0.2), F.lit(0.1), ar.rms_norm), spark, sf_dir)


@query(_normed_sql("v", f"round({_LN.format(x='u[place + 1]')} * tanh(0.7) + 0.1, 6) AS y"), "vectors")
def norm_tanh_mul_add(spark, sf_dir: str) -> DataFrame:
    return _per_element(ar.tanh_norm(F.col("v"), F.lit(0.7), F.lit(0.1)), spark, sf_dir)


_HEADS = "hd AS (SELECT vec_id, h, list_slice(v, 16 * h + 1, 16 * h + 16) AS u FROM (SELECT vec_id, v, unnest(range(4)) AS h FROM vectors)), hn AS (SELECT vec_id, h, list_transform(u, lambda x: x / sqrt(list_sum(list_transform(u, lambda t: t * t)) / 16 + 1e-6)) AS u FROM hd), he AS (SELECT vec_id, h, u, unnest(range(16)) AS i FROM hn)"


@query(f"{_HEADS} SELECT vec_id, 16 * h + i AS place, round(u[i + 1], 6) AS y FROM he", "vectors")
def qk_norm(spark, sf_dir: str) -> DataFrame:
    return _per_element(ar.per_head(F.col("v"), 4, ar.rms_norm), spark, sf_dir)


_HALF_ANGLE = "vec_id * pow(10000.0, -2.0 * (i % 8) / 16)"


@query(f"{_HEADS} SELECT vec_id, 16 * h + i AS place, round(u[i + 1] * cos({_HALF_ANGLE}) + CASE WHEN i < 8 THEN -u[i + 9] ELSE u[i - 7] END * sin({_HALF_ANGLE}), 6) AS y FROM he", "vectors")
def qk_norm_rope(spark, sf_dir: str) -> DataFrame:
    turned = ar.per_head(ar.per_head(F.col("v"), 4, ar.rms_norm), 4, lambda h: ar.rotary_halves(h, F.col("vec_id")))
    return _per_element(turned, spark, sf_dir)


_SCALED_ANGLE = "vec_id / 4.0 * pow(10000.0, -2.0 * (place % 32) / 64)"


@query(_element_sql(f"v[place + 1] * cos({_SCALED_ANGLE}) + CASE WHEN place < 32 THEN -v[place + 33] ELSE v[place - 31] END * sin({_SCALED_ANGLE})"), "vectors")
def rotary_linear_scaled(spark, sf_dir: str) -> DataFrame:
    return _per_element(ar.rotary_halves(F.col("v"), F.col("vec_id") / 4), spark, sf_dir)


_AXES = [(16, "vec_id // 64", 1.0), (24, "vec_id // 8 % 8", 2.0), (24, "vec_id % 8", 1.0)]
_AXIS_SQL = " UNION ALL ".join(f"SELECT vec_id, {b} + i AS place, ({p}) * 0.5 / pow(10000.0 * pow({r}, {n} / {n - 2}.0), 2 * i / {n}.0) AS angle FROM vectors, (SELECT unnest(range({n // 2})) AS i)" for (n, p, r), b in zip(_AXES, (0, 8, 20), strict=True))


@query(f"a AS ({_AXIS_SQL}) SELECT vec_id, place, round(cos(angle), 6) AS c, round(sin(angle), 6) AS s FROM a", "vectors")
def rotary_grid(spark, sf_dir: str) -> DataFrame:
    """The cosines and sines of a position on three axes, one after the other."""
    angles = F.concat(*[ar.rotary_angles(F.expr(p.replace("//", "div")), n, rescale=r, interpolation=0.5) for n, p, r in _AXES])
    return bd.vectors(spark, sf_dir).select("vec_id", F.posexplode(angles).alias("place", "a")).select("vec_id", F.col("place").cast("long").alias("place"), F.round(F.cos("a"), 6).alias("c"), F.round(F.sin("a"), 6).alias("s"))


@query(_element_sql("v[place + 1] / (1 + exp(-1.702 * v[place + 1]))"), "vectors")
def quick_gelu(spark, sf_dir: str) -> DataFrame:
    return _per_element(F.transform("v", ar.quick_gelu), spark, sf_dir)


@query(_element_sql("v[place + 1] + v[place + 1] * (1 + v[64 - place])"), "vectors")
def mul_add(spark, sf_dir: str) -> DataFrame:
    return _per_element(ar.mul_add(F.col("v"), F.reverse("v"), F.col("v"), 1.0), spark, sf_dir)


@query("x AS (SELECT label, unnest(v) AS x FROM vectors) SELECT label, round(CASE WHEN max(abs(x)) = 0 THEN 1 ELSE max(abs(x)) / 448 END, 9) AS scale FROM x GROUP BY label", "vectors")
def fp8_scales(spark, sf_dir: str) -> DataFrame:
    top = bd.vectors(spark, sf_dir).select("label", F.array_max(F.transform("v", F.abs)).alias("top")).groupBy("label").agg(F.max("top").alias("top"))
    return top.select("label", F.round(ar.fp8_scale(F.col("top")), 9).alias("scale"))


# --- sizes, schedules and names -----------------------------------------------------------------------------------


@query("SELECT clip, (num_frames - 1) // 8 + 1 AS latent_frames, 704 // 32 AS latent_width, 480 // 32 AS latent_height, least(17, ((num_frames % 20 + 1) - 1 + 7) // 8 * 8 + 1) AS window_frames, CAST(ceil((num_frames + 100) / 32.0) * 32 AS BIGINT) AS aligned FROM clips", "clips")
def latent_sizes(spark, sf_dir: str) -> DataFrame:
    n = F.col("num_frames")
    return bd.clips(spark, sf_dir).select("clip", nb.latent_frames(n, 8).alias("latent_frames"), F.lit(704 // 32).cast("long").alias("latent_width"), F.lit(480 // 32).cast("long").alias("latent_height"), nb.window_frames(n % 20 + 1, 17, 8, 1, dynamic=True).cast("long").alias("window_frames"), nb.align_up(n + 100, 32).cast("long").alias("aligned"))


@query("SELECT clip, CAST(trunc(greatest(num_frames - least(num_frames * 0.6, num_frames), 0)) AS BIGINT) AS skipped, num_frames - CAST(trunc(greatest(num_frames - least(num_frames * 0.6, num_frames), 0)) AS BIGINT) AS kept FROM (SELECT clip, CAST(num_frames AS DOUBLE) AS num_frames FROM clips)", "clips")
def kept_timesteps(spark, sf_dir: str) -> DataFrame:
    n = F.col("num_frames").cast("double")
    skipped = nb.skipped_steps(n, 0.6)
    return bd.clips(spark, sf_dir).select("clip", skipped.alias("skipped"), (n - skipped).alias("kept"))


@query("s AS (SELECT clip, frame, 1.0 + CASE WHEN frame < 15 THEN greatest(3.0 / pow(pow(3.0, 1.0 / 15), frame), 0) ELSE 0 END AS scale FROM frames) SELECT clip, frame, round(scale, 6) AS scale, scale > 1 AS guided FROM s", "frames")
def guidance_scales(spark, sf_dir: str) -> DataFrame:
    rows = bd.frames(spark, sf_dir).select("clip", "frame", nb.guidance_scale(F.col("frame"), 4.0).alias("scale"))
    return rows.select("clip", "frame", F.round("scale", 6).alias("scale"), (F.col("scale") > 1).alias("guided"))


_SIGMA = "CASE WHEN {i} >= num_frames THEN 0 ELSE CASE WHEN num_frames > 1 THEN 1 - {i} * 0.999 / (num_frames - 1) ELSE 1 END END"
_SHIFTED = "3 * ({0}) / (1 + 2 * ({0}))"


@query(f"g AS (SELECT clip, frame, value, {_SHIFTED.format(_SIGMA.format(i='frame'))} AS sigma, {_SHIFTED.format(_SIGMA.format(i='(frame + 1)'))} AS after FROM frames JOIN clips USING (clip)) SELECT clip, frame, round(sigma, 6) AS sigma, round(100 + sum((after - sigma) * value) OVER (PARTITION BY clip ORDER BY frame), 4) AS sample FROM g", "frames", "clips")
def flow_match_steps(spark, sf_dir: str) -> DataFrame:
    """The sample that starts at 100 and moves by each step's prediction over the drop of the noise level."""
    from pyspark.sql import Window

    rows = bd.frames(spark, sf_dir).join(bd.clips(spark, sf_dir), "clip")
    n = F.col("num_frames")
    rows = rows.withColumn("sigma", nb.flow_sigma(F.col("frame"), n, shift=3.0)).withColumn("after", nb.flow_sigma(F.col("frame") + 1, n, shift=3.0))
    past = Window.partitionBy("clip").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("clip", "frame", F.round("sigma", 6).alias("sigma"), F.round(100 + F.sum((F.col("after") - F.col("sigma")) * F.col("value")).over(past), 4).alias("sample"))


@query("SELECT clip, CASE clip % 3 WHEN 0 THEN 32 ELSE 64 END AS align_w, CASE clip % 3 WHEN 2 THEN 64 ELSE 32 END AS align_h, round(8 / (24.0 + clip % 7), 6) AS rope_t, 32.0 AS rope_s FROM clips", "clips")
def spatial_alignment(spark, sf_dir: str) -> DataFrame:
    degree = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.col("clip") % 3 + 1).cast("int"))
    return bd.clips(spark, sf_dir).select("clip", nb.spatial_alignment(degree).alias("a"), F.round(8 / (24.0 + F.col("clip") % 7), 6).alias("rope_t"), F.lit(32.0).alias("rope_s")).select("clip", "a.align_w", "a.align_h", "rope_t", "rope_s")


@query("SELECT p_partkey AS id, 'https://frames.s3.eu-west-1.amazonaws.com/' || replace(replace(p_name, '%', '%25'), ' ', '%20') || '/out.mp4' AS url, CASE WHEN p_size > 1 THEN 'clip.v' || p_size || '_' || (p_size % 4) || '.mp4' ELSE 'clip.v' || p_size || '.mp4' END AS name FROM part")
def result_names(spark, sf_dir: str) -> DataFrame:
    rows = bd.table(spark, sf_dir, "part")
    name = F.concat(F.lit("clip.v"), "p_size", F.lit(".mp4"))
    return rows.select(F.col("p_partkey").alias("id"), nb.object_url(F.concat("p_name", F.lit("/out.mp4")), "frames", "eu-west-1").alias("url"), nb.numbered_name(name, F.col("p_size"), F.col("p_size") % 4).alias("name"))


@query("SELECT clip, frame, CAST(least(94, 5 + floor(89 * (frame % 10 + 0.9 * greatest(0.0, least(value / 100, 1.0))) / 10)) AS BIGINT) AS progress FROM frames", "frames")
def window_progress(spark, sf_dir: str) -> DataFrame:
    return bd.frames(spark, sf_dir).select("clip", "frame", nb.window_fraction(F.col("frame") % 10, F.col("value") / 100, F.lit(10)).cast("long").alias("progress"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN user_id END, 17) AS infer_len, coalesce(CASE WHEN event_id % 5 = 0 THEN event_type END, 'linear') AS mode, [10, 20, 30][least(event_id % 7, 2) + 1] AS picked, CASE WHEN event_id % 4 > 0 THEN nullif(event_type, 'view') END AS note FROM events")
def task_parameters(spark, sf_dir: str) -> DataFrame:
    """A task's own settings before the defaults, the object's item of a list, and texts that say nothing as null."""
    e = bd.table(spark, sf_dir, "events")
    own = e.select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("infer_len"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("mode"), F.when(F.col("event_id") % 4 > 0, F.when(F.col("event_type") == "view", "N/A").otherwise(F.col("event_type"))).otherwise("").alias("text"))
    out = tasks.defaulted(own, {"infer_len": 17, "mode": "linear"})
    return out.select("event_id", "infer_len", "mode", nb.picked(F.array(F.lit(10), F.lit(20), F.lit(30)), F.col("event_id") % 7).alias("picked"), nb.optional_string(F.col("text")).alias("note"))


# --- statistics ---------------------------------------------------------------------------------------------------

_TENSORS = "x AS (SELECT vec_id AS tensor, unnest(range(len(v))) AS place, unnest(v) AS x FROM vectors), m AS (SELECT tensor, x, place % 16 < tensor % 18 - 2 AS mask FROM x)"


@query(f"{_TENSORS} SELECT tensor, count(*) FILTER (mask) AS n, round(coalesce(avg(x) FILTER (mask), 1e-8), 6) AS mean, round(CASE WHEN count(*) FILTER (mask) = 0 THEN 1e-8 ELSE sqrt(var_samp(x) FILTER (mask) + 1e-8) END, 6) AS std FROM m GROUP BY tensor", "vectors")
def tensor_stats_masked(spark, sf_dir: str) -> DataFrame:
    rows = bd.vectors(spark, sf_dir).select(F.col("vec_id").alias("tensor"), F.posexplode("v").alias("place", "x"))
    mask = F.when(F.col("place") % 16 < F.col("tensor") % 18 - 2, 1).otherwise(0)
    return rounded(statistics.masked_tensor_stats(rows.withColumn("mask", mask)), "mean", "std")


@query("SELECT event_type AS \"group\", count(*) AS runs, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_samp(value), 6) AS std, bool_and(value >= 0) AS positive, bool_and(value < 50) AS short, count(DISTINCT user_id % 2) = 1 AS same_output FROM events GROUP BY event_type")
def run_summary(spark, sf_dir: str) -> DataFrame:
    e = bd.table(spark, sf_dir, "events").select(F.col("event_type").alias("group"), "value", (F.col("value") >= 0).alias("positive"), (F.col("value") < 50).alias("short"), (F.col("user_id") % 2).alias("output"))
    return rounded(statistics.run_summary(e, "value", ["positive", "short"], "output"), "mean", "min", "max", "std")


# --- seams of tiles -----------------------------------------------------------------------------------------------

_TILES = "tl AS (SELECT vec_id AS tile, unnest(range(64)) AS p, unnest(v) AS value FROM vectors)"


def _tiles(spark, sf_dir: str, **axes: str) -> DataFrame:
    rows = bd.vectors(spark, sf_dir).select(F.col("vec_id").alias("tile"), F.posexplode("v").alias("p", "value"))
    return rows.select("tile", *[F.expr(e).cast("long").alias(k) for k, e in axes.items()], "value")


def _seam_sql(axis: str, other: str, of_axis: str, of_other: str, size: int, extent: int) -> str:
    return f"{_TILES}, t AS (SELECT tile, {of_axis} AS {axis}, {of_other} AS {other}, value FROM tl) SELECT b.tile, b.{axis}, b.{other}, round(CASE WHEN a.value IS NULL THEN b.value ELSE a.value * (1 - b.{axis} / {extent}) + b.value * (b.{axis} / {extent}) END, 6) AS value FROM t b LEFT JOIN t a ON a.tile = b.tile - 1 AND a.{other} = b.{other} AND b.{axis} < {extent} AND a.{axis} = {size - extent} + b.{axis}"


@query(_seam_sql("y", "x", "p // 8", "p % 8", 8, 3), "vectors")
def blend_tiles_down(spark, sf_dir: str) -> DataFrame:
    return rounded(overlap.seamed(_tiles(spark, sf_dir, y="p div 8", x="p % 8"), "y", ["x"], 8, 3), "value")


@query(_seam_sql("x", "y", "p % 8", "p // 8", 8, 5), "vectors")
def blend_tiles_right(spark, sf_dir: str) -> DataFrame:
    return rounded(overlap.seamed(_tiles(spark, sf_dir, x="p % 8", y="p div 8"), "x", ["y"], 8, 5), "value")


@query(_seam_sql("frame", "pixel", "p // 16", "p % 16", 4, 2), "vectors")
def blend_tiles_in_time(spark, sf_dir: str) -> DataFrame:
    return rounded(overlap.seamed(_tiles(spark, sf_dir, frame="p div 16", pixel="p % 16"), "frame", ["pixel"], 4, 2), "value")


# --- plans and shards ---------------------------------------------------------------------------------------------

_TASKS = f"{_PLAN}, k2 AS (SELECT clip AS plan, window_index AS task_id, window_index % 4 AS rank, load_end - load_start AS cost FROM p)"
_RANKS = "r2 AS (SELECT plan, rank, count(*) AS n FROM k2 GROUP BY ALL), u2 AS (SELECT plan, CAST(sum(n) AS BIGINT) AS tasks, max(n) AS rounds FROM r2 GROUP BY plan)"


def _tasks(spark, sf_dir: str) -> DataFrame:
    w = F.col("window_index")
    return _plan(spark, sf_dir).select(F.col("clip").alias("plan"), w.alias("task_id"), (w % 4).alias("rank"), (F.col("load_end") - F.col("load_start")).alias("cost"))


@query(f"{_TASKS}, {_RANKS} SELECT plan, tasks, rounds, plan % 3 > 0 OR tasks < 2 AS fine FROM u2", "clips")
def task_plan_check(spark, sf_dir: str) -> DataFrame:
    """Every third plan names its first task twice and lacks the last one."""
    rows = _tasks(spark, sf_dir).join(bd.clips(spark, sf_dir).select(F.col("clip").alias("plan")), "plan")
    broken = F.when((F.col("plan") % 3 == 0) & (F.col("task_id") > 0), F.col("task_id") - 1).otherwise(F.col("task_id"))
    return taskplans.validated(rows.withColumn("task_id", broken))


@query(f"{_TASKS} SELECT * FROM k2", "clips")
def task_plan_codec(spark, sf_dir: str) -> DataFrame:
    return taskplans.decoded(taskplans.encoded(_tasks(spark, sf_dir)))


_LE = "list_aggregate(list_transform(range(8), lambda i: substr(printf('%016x', x), 15 - 2 * i, 2)), 'string_agg', '')"


@query(f"{_TASKS}, {_RANKS}, f2 AS (SELECT plan, -1 AS o, 0 AS c, 1 AS x FROM u2 UNION ALL SELECT plan, -1, 1, tasks FROM u2 UNION ALL SELECT plan, -1, 2, rounds FROM u2 UNION ALL SELECT plan, task_id, 0, task_id FROM k2 UNION ALL SELECT plan, task_id, 1, rank FROM k2 UNION ALL SELECT plan, task_id, 2, cost FROM k2), h2 AS (SELECT plan, o, c, {_LE} AS h FROM f2) SELECT plan, sha256(unhex(string_agg(h, '' ORDER BY o, c))) AS digest FROM h2 GROUP BY plan", "clips")
def task_plan_digest(spark, sf_dir: str) -> DataFrame:
    return taskplans.digests(taskplans.encoded(_tasks(spark, sf_dir)))


@query("SELECT clip, CAST(list(value ORDER BY frame) AS VARCHAR) <> '' AS whole, round(list_sum(list_transform(list(value ORDER BY frame), lambda x, i: x * i)), 4) AS weighted, count(*) AS n FROM frames GROUP BY clip", "frames")
def shards_gathered(spark, sf_dir: str) -> DataFrame:
    """Clips dealt to four ranks in uneven parts and put together again, in order."""
    plan = shards.uneven_shards(bd.clips(spark, sf_dir).select(F.col("clip").alias("id"), F.col("num_frames").alias("length")), 4)
    back = shards.gathered(shards.sharded(bd.frames(spark, sf_dir).select(F.col("clip").alias("id"), F.col("frame").alias("place"), "value"), plan))
    weighted = F.aggregate(F.zip_with("values", F.sequence(F.lit(1), F.size("values")), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return back.select(F.col("id").alias("clip"), F.lit(True).alias("whole"), F.round(weighted, 4).alias("weighted"), F.size("values").cast("long").alias("n"))


@query("SELECT o_orderkey AS id, r AS rank, c AS cpu FROM orders, (VALUES (0, 0), (0, 1), (0, 2), (0, 8), (1, 3), (1, 4)) t(r, c)")
def cpu_affinity(spark, sf_dir: str) -> DataFrame:
    rows = bd.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("0 = 0-2, 8; 1=3-4;").alias("text"))
    return shards.cpu_map(rows, 2).select("id", F.col("rank").cast("int").alias("rank"), F.col("cpu").cast("int").alias("cpu"))


# --- histories ----------------------------------------------------------------------------------------------------


@query("SELECT clip, frame // 14 AS window_index, max(frame) AS seq, first(kind ORDER BY frame DESC) AS state, round(first(value ORDER BY frame DESC), 6) AS value FROM frames GROUP BY ALL", "frames")
def window_states(spark, sf_dir: str) -> DataFrame:
    changes = bd.frames(spark, sf_dir).select("clip", F.floor(F.col("frame") / 14).alias("window_index"), F.col("frame").alias("seq"), F.col("kind").alias("state"), "value")
    return rounded(tasks.upserted(changes, ["clip", "window_index"]), "value")


@query("SELECT clip, frame AS seq, kind AS event, CASE WHEN frame % 2 = 0 THEN '{\"window\":' || (frame // 14) || ',\"phase\":\"' || kind || '\"}' ELSE '{\"window\":' || (frame // 14) || '}' END AS payload FROM frames", "frames")
def runtime_events(spark, sf_dir: str) -> DataFrame:
    rows = bd.frames(spark, sf_dir).select("clip", F.col("frame").alias("seq"), F.col("kind").alias("event"), F.floor(F.col("frame") / 14).alias("window"), F.when(F.col("frame") % 2 == 0, F.col("kind")).alias("phase"))
    return tasks.recorded(rows, ["window", "phase"])



@query(f"{_PLAN}, c2 AS (SELECT clip, max(window_index) + 1 AS windows FROM p GROUP BY clip) SELECT clip, frame AS seq, least(frame // 14, windows) AS next_window, windows, frame // 14 >= windows - 1 AS last_window, round(sum(value) OVER (PARTITION BY clip ORDER BY frame), 4) AS done FROM frames JOIN c2 USING (clip)", "frames", "clips")
def state_snapshots(spark, sf_dir: str) -> DataFrame:
    """What each step of a clip leaves behind: the next window of all, and what is done so far."""
    from pyspark.sql import Window

    count = _plan(spark, sf_dir).groupBy("clip").agg((F.max("window_index") + 1).alias("windows"))
    at = F.floor(F.col("frame") / 14)
    past = Window.partitionBy("clip").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return bd.frames(spark, sf_dir).join(count, "clip").select("clip", F.col("frame").alias("seq"), F.least(at, "windows").alias("next_window"), "windows", (at >= F.col("windows") - 1).alias("last_window"), F.round(F.sum("value").over(past), 4).alias("done"))
