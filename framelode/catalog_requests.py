"""Queries over what surrounds a run: profiles, calibrations, reports, static masks, ids, signatures, scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelode import bindings as bd
from framelode.catalog import _folder, _timings, query, rounded
from framelode.functions import arrays as ar
from framelode.operators import images, layers, requests
from framelode.plans import windows

_ORDERS9 = "['progressive', 'tt', 'bff', 'top', 'bb', 'interlaced', 'tb', 'bottom_field_first', 'bt']"
_NAMES9 = "['progressive', 'top_field_first', 'bottom_field_first', 'top_field_first', 'bottom_field_first', 'interlaced', 'top_field_first', 'bottom_field_first', 'bottom_field_first']"


@query(
    "SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'libx264' ELSE 'prores_ks' END AS encoder, (o_custkey % 90 + 1) * 1000 // greatest(gcd((o_custkey % 90 + 1) * 1000, 1001), 1) || '/' || 1001 // greatest(gcd((o_custkey % 90 + 1) * 1000, 1001), 1) AS frame_rate, "
    f"CASE WHEN o_orderkey % 10 = 9 THEN 'progressive' ELSE {_NAMES9}[o_orderkey % 10 + 1] END AS field_order, CASE WHEN o_orderkey % 4 = 0 THEN '10000000' WHEN o_orderkey % 4 = 1 THEN '10000000' ELSE CAST(o_custkey * 1000 AS VARCHAR) END AS video_bitrate, CASE WHEN o_orderkey % 3 = 0 THEN 'yuv420p' ELSE 'yuv422p10le' END AS pix_fmt, CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE 'bt709' END AS color_space FROM orders"
)
def encoding_profiles(spark, sf_dir: str) -> DataFrame:
    orders = bd.table(spark, sf_dir, "orders")
    metadata = orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_custkey") % 2 == 0, "H264").otherwise("prores").alias("codec_name"),
        F.expr("concat((o_custkey % 90 + 1) * 1000, '/1001')").alias("fps_fraction"),
        F.expr(f"IF(o_orderkey % 10 = 9, NULL, get(array({_ORDERS9[1:-1]}), CAST(o_orderkey % 10 AS int)))").alias("field_order"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN NULL ELSE CAST(o_custkey * 1000 AS string) END").alias("bit_rate"),
        F.expr("IF(o_orderkey % 3 = 0, '', 'yuv422p10le')").alias("pix_fmt"),
        F.expr("IF(o_orderkey % 3 = 1, 'N/A', 'bt709')").alias("color_space"),
    )
    return requests.encoding_profiles(metadata)


@query("x AS (SELECT label, unnest(range(8)) AS block, unnest(v[1:8]) AS x FROM vectors) SELECT label, block, round(avg(abs(x)) + 0.001, 9) AS scale FROM x GROUP BY label, block", "vectors")
def calibrations(spark, sf_dir: str) -> DataFrame:
    """A calibration file for each label, of eight layers, written and read with its checks."""
    folder = _folder(spark, "calibration")
    means = bd.vectors(spark, sf_dir).select("label", F.posexplode(F.slice("v", 1, 8)).alias("block", "x")).groupBy("label", "block").agg((F.avg(F.abs("x")) + 0.001).alias("scale"))
    files = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("block", "scale"))).alias("layers"))
    files.select(F.to_json(F.struct(F.lit(True).alias("completed"), F.lit(True).alias("holdout"), "layers")).alias("value"), "label").write.partitionBy("label").text(folder)
    rows = requests.calibrations(spark, f"{folder}/label=*", 8)
    return rounded(rows.select(F.regexp_extract("path", r"label=(\d+)", 1).cast("int").alias("label"), "block", "scale"), "scale", digits=9)


@query("s AS (SELECT user_id, event_type, sum(value) AS ms, count(*) AS n FROM events GROUP BY ALL) SELECT user_id AS request, event_type AS stage, round(ms, 4) AS ms, n AS calls, round(sum(ms) OVER (PARTITION BY user_id), 4) AS total FROM s".replace("s AS", "WITH s AS", 1))
def timing_reports(spark, sf_dir: str) -> DataFrame:
    """Each request's report, written as JSON lines and read again."""
    folder = _folder(spark, "reports")
    requests.reports(_timings(spark, sf_dir)).select(F.col("report").alias("value")).write.text(folder)
    read = spark.read.schema("request_id string, total_duration_ms double, stages map<string, double>, stage_counts map<string, long>").json(folder)
    each = read.select("request_id", "total_duration_ms", "stage_counts", F.explode("stages").alias("stage", "ms"))
    return rounded(each.select(F.col("request_id").cast("long").alias("request"), "stage", "ms", F.try_element_at("stage_counts", F.col("stage")).alias("calls"), F.col("total_duration_ms").alias("total")), "ms", "total", digits=4)


@query("m AS (SELECT label AS clip, min(vec_id) AS id FROM vectors GROUP BY label), n AS (SELECT label AS clip, count(*) % 7 + 3 AS num_frames FROM vectors GROUP BY label), p AS (SELECT m.clip, unnest(range(64)) AS p, v FROM m JOIN vectors ON vec_id = id) SELECT p.clip, f AS frame, p // 8 AS y, p % 8 AS x, CAST(floor(floor(least(255, abs(v[p + 1]) * 600)) * (CASE WHEN p % 3 = 0 THEN 0 WHEN p % 3 = 1 THEN 128 ELSE 255 END) / 255 + 0.5) AS BIGINT) AS mask FROM p JOIN n ON n.clip = p.clip, (SELECT unnest(range(10)) AS f) WHERE f < num_frames", "vectors")
def static_masks(spark, sf_dir: str) -> DataFrame:
    """The first vector of a label as a mask with alpha, for all frames of the label's clip."""
    v = bd.vectors(spark, sf_dir)
    clips = v.groupBy(F.col("label").alias("clip")).agg((F.count("*") % 7 + 3).alias("num_frames")).withColumns({"height": F.lit(8), "width": F.lit(8)})
    first = v.groupBy("label").agg(F.min("vec_id").alias("vec_id")).join(v.drop("label"), "vec_id").select(F.col("label").alias("clip"), F.posexplode("v").alias("p", "g"))
    masks = first.select("clip", F.lit(8).alias("height"), F.lit(8).alias("width"), F.expr("CAST(p div 8 AS bigint)").alias("y"), F.expr("CAST(p % 8 AS bigint)").alias("x"), F.floor(F.least(F.lit(255.0), F.abs("g") * 600)).alias("value"), F.expr("CASE p % 3 WHEN 0 THEN 0 WHEN 1 THEN 128 ELSE 255 END").alias("alpha"))
    return requests.static_masks(masks, clips)


@query("t AS (SELECT clip, max(value) AS top, max(frame) AS last FROM frames GROUP BY clip), p AS (SELECT *, unnest(range(70)) AS place FROM t) SELECT p.clip, place AS frame, CASE WHEN value <= top * 0.3 THEN 0 ELSE 255 END AS mask FROM p JOIN frames f ON f.clip = p.clip AND f.frame = least(place, last)", "frames")
def runtime_masks(spark, sf_dir: str) -> DataFrame:
    return requests.held_masks(bd.frames(spark, sf_dir).select("clip", "frame", "value"), 70, 0.3)


@query("SELECT o_orderkey AS id, 'req_' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12) AS request FROM orders")
def request_ids(spark, sf_dir: str) -> DataFrame:
    return bd.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), requests.request_ids(F.col("o_orderkey")).alias("request"))


@query("SELECT l_returnflag AS backend, l_linestatus AS dtype, CAST(l_quantity AS BIGINT) AS shape, min(l_orderkey) AS first_at, 1 AS misses, count(*) - 1 AS hits FROM lineitem GROUP BY ALL")
def compile_signatures(spark, sf_dir: str) -> DataFrame:
    calls = bd.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("at"), F.col("l_returnflag").alias("backend"), F.col("l_linestatus").alias("dtype"), F.col("l_quantity").cast("long").alias("shape"))
    return requests.signatures(calls, ["backend", "dtype", "shape"])


@query("r AS (SELECT o_orderkey AS request, o_custkey % 3 + 1 AS objects, o_orderkey % 3 AS lists, o_custkey FROM orders), o AS (SELECT *, unnest(range(objects)) AS object FROM r) SELECT request, object, least(object, lists - 1) * 10 AS start, o_custkey % 20 + 1 AS length FROM o WHERE lists > 0 UNION ALL SELECT request, object, 100, least(object, lists - 1) + 5 FROM o WHERE lists > 0".replace("r AS", "WITH r AS", 1))
def object_scenes(spark, sf_dir: str) -> DataFrame:
    """Requests with a list of scenes for each of some objects; objects beyond take the last list."""
    lists = F.expr("transform(sequence(0L, o_orderkey % 3 - 1, 1L), i -> array(struct(i * 10 AS start, o_custkey % 20 + 1 AS length), struct(100L AS start, i + 5 AS length)))")
    rows = bd.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.expr("CAST(o_custkey % 3 + 1 AS int)").alias("objects"), F.when(F.col("o_orderkey") % 3 > 0, lists).alias("scenes"))
    return requests.scenes_of_objects(rows)


@query("fw AS (SELECT label AS n, min(vec_id) AS f FROM vectors GROUP BY label), w AS (SELECT n, v, n * 0.25 AS bias FROM fw JOIN vectors ON vec_id = f) SELECT a.vec_id AS m, w.n, round(list_dot_product(list_transform(a.v, lambda x: x / (1 + exp(-x))), w.v) + bias, 6) AS y FROM vectors a, w", "vectors")
def modulate_projection(spark, sf_dir: str) -> DataFrame:
    """SiLU of every vector, and a linear layer behind it."""
    v = bd.vectors(spark, sf_dir)
    weights = v.join(v.groupBy("label").agg(F.min("vec_id").alias("vec_id")), ["label", "vec_id"]).select(F.col("label").cast("long").alias("n"), F.col("v").alias("w"), (F.col("label") * 0.25).alias("bias"))
    return rounded(layers.linear(v.select(F.col("vec_id").alias("m"), F.transform("v", lambda x: x * ar.sigmoid(x)).alias("x")), weights), "y")


@query("im AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, v FROM vectors), n AS (SELECT clip, count(*) AS n FROM im GROUP BY clip), pl AS (SELECT clip, n, unnest(range(60)) AS place FROM n) SELECT pl.clip, place, y * 12 + x AS pos, CAST(least(255, floor(abs(v[least(y, 7) * 8 + least(x, 7) + 1]) * 255)) AS INTEGER) AS g FROM pl JOIN im ON im.clip = pl.clip AND im.frame = least(place, n - 1), (SELECT unnest(range(12)) AS y), (SELECT unnest(range(12)) AS x)", "vectors")
def single_window(spark, sf_dir: str) -> DataFrame:
    """Each clip as one window of 60 frames, padded to the right and below, its last frame repeated or its end cut."""
    order = Window.partitionBy("label").orderBy("vec_id")
    byte = F.transform("v", lambda x: F.least(F.lit(255), F.floor(F.abs(x) * 255)))
    v = bd.vectors(spark, sf_dir).select(F.col("label").alias("clip"), (F.row_number().over(order) - 1).cast("long").alias("frame"), byte.alias("b"))
    wide = images.padded(v.select("clip", "frame", F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(F.array_join(F.transform("b", lambda x: F.lpad(F.hex(x), 2, "0")), "")).alias("pixels")), 6)
    places = windows.repeated_frames(v.groupBy("clip").agg(F.count("*").alias("num_frames")), 60).select("clip", "place", F.col("last_source").alias("frame"))
    digits = F.split(F.regexp_replace(F.hex("pixels"), "(..)(?!$)", "$1,"), ",")
    return places.join(wide, ["clip", "frame"]).select("clip", "place", F.posexplode(F.transform(digits, lambda h: F.conv(h, 16, 10).cast("int"))).alias("pos", "g"))
