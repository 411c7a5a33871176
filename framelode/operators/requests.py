"""What surrounds a run: profiles from metadata, calibrations, reports, static masks, ids and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelode.functions.numbers import optional_string

# fixed values: encoders of source codecs, and names of field orders
ENCODERS = {"h264": "libx264", "prores": "prores_ks"}
FIELD_ORDERS = {"progressive": "progressive", "top": "top_field_first", "top_field_first": "top_field_first", "tb": "top_field_first", "tt": "top_field_first", "tff": "top_field_first", "bottom": "bottom_field_first", "bottom_field_first": "bottom_field_first", "bb": "bottom_field_first", "bt": "bottom_field_first", "bff": "bottom_field_first", "interlaced": "interlaced"}
BITRATE, PIXELS = "10000000", "yuv420p"


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _or_raise(value: Column, valid: Column, what: str, shown: Column) -> Column:
    return F.when(valid, value).otherwise(F.raise_error(F.concat(F.lit(what), F.coalesce(shown.cast("string"), F.lit("null")))).cast("string"))


def reduced(text: Column) -> Column:
    """A rational such as "50/2" in lowest terms, "25/1"; null where it is none or not above 0."""
    parts = F.transform(F.split(text, "/"), lambda p: F.when(F.trim(p).rlike(r"^\d{1,9}$"), F.trim(p).cast("long")))
    a, b = F.get(parts, F.lit(0)), F.when(F.size(parts) == 1, F.lit(1).cast("long")).otherwise(F.get(parts, F.lit(1)))
    # Euclid: 45 steps are enough for numbers of nine digits
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    divisor = F.aggregate(F.sequence(F.lit(1), F.lit(45)), pair(a, b), lambda s, _: F.when(s["y"] == 0, s).otherwise(pair(s["y"], s["x"] % F.greatest(s["y"], F.lit(1)))), lambda s: s["x"])
    good = (F.size(parts) <= 2) & (a > 0) & (b > 0)
    return F.when(good, F.concat_ws("/", (a / divisor).cast("long"), (b / divisor).cast("long")))


def encoding_profiles(metadata: DataFrame) -> DataFrame:
    """metadata (id, codec_name, fps_fraction, field_order, bit_rate, pix_fmt, color_space) as encoder, frame_rate (in
    lowest terms), field_order, video_bitrate, pix_fmt and color_space.

    A codec without an encoder, a frame rate that is no positive rational and an unknown field order raise; a null field
    order is progressive. A null, empty or "N/A" bit rate is BITRATE, a null or empty pixel format PIXELS.
    """
    encoder, rate = _lookup(ENCODERS, F.lower("codec_name")), reduced(F.col("fps_fraction"))
    order = F.when(F.col("field_order").isNull(), "progressive").otherwise(_lookup(FIELD_ORDERS, F.col("field_order")))
    return metadata.select(
        "id",
        _or_raise(encoder, encoder.isNotNull(), "unsupported source codec: ", F.col("codec_name")).alias("encoder"),
        _or_raise(rate, rate.isNotNull(), "invalid rational frame rate: ", F.col("fps_fraction")).alias("frame_rate"),
        _or_raise(order, order.isNotNull(), "unsupported field_order: ", F.col("field_order")).alias("field_order"),
        F.coalesce(optional_string(F.col("bit_rate")), F.lit(BITRATE)).alias("video_bitrate"),
        F.coalesce(F.nullif("pix_fmt", F.lit("")), F.lit(PIXELS)).alias("pix_fmt"),
        optional_string(F.col("color_space")).alias("color_space"),
    )


def calibrations(spark: SparkSession, path: str, layers: int) -> DataFrame:
    """(path, block, scale) of JSON files {completed, holdout, layers: [{block, scale}]}.

    A file that isn't completed, whose holdout failed, that has another number of layers, layers out of order or a scale
    that isn't finite and positive raises.
    """
    schema = "completed boolean, holdout boolean, layers array<struct<block: long, scale: double>>"
    files = spark.read.schema(schema).json(path, multiLine=True).withColumn("path", F.input_file_name())
    whole = F.coalesce(F.col("completed") & F.col("holdout") & (F.size("layers") == layers), F.lit(False))
    good = F.forall(F.transform("layers", lambda x, i: F.coalesce((x["block"] == i) & (x["scale"] > 0) & (x["scale"] < float("inf")) & ~F.isnan(x["scale"]), F.lit(False))), lambda x: x)
    checked = F.when(whole & good, F.col("layers")).otherwise(F.raise_error(F.concat(F.lit("invalid calibration "), "path")).cast("array<struct<block: long, scale: double>>"))
    return files.select("path", F.inline(checked))


def reports(timings: DataFrame) -> DataFrame:
    """(request, report) of timings (request, stage, ms): one JSON text a request, with its total, the sum and the number of
    each stage."""
    stages = timings.groupBy("request", "stage").agg(F.sum("ms").alias("ms"), F.count("*").alias("n"))
    rows = stages.groupBy("request").agg(F.sum("ms").alias("total"), F.sort_array(F.collect_list(F.struct("stage", "ms", "n"))).alias("s"))
    pairs = lambda field: F.map_from_entries(F.transform("s", lambda x: F.struct(x["stage"], x[field])))
    return rows.select("request", F.to_json(F.struct(F.col("request").cast("string").alias("request_id"), F.col("total").alias("total_duration_ms"), pairs("ms").alias("stages"), pairs("n").alias("stage_counts"))).alias("report"))


def static_masks(masks: DataFrame, clips: DataFrame) -> DataFrame:
    """(clip, frame, y, x, mask): one still mask (clip, height, width, y, x, value, alpha) for all frames of clips (clip,
    num_frames, height, width), its transparent parts flattened on black. A mask of another size raises."""
    sizes = clips.select("clip", "num_frames", F.col("height").alias("_h"), F.col("width").alias("_w"))
    joined = masks.join(sizes, "clip")
    fits = (F.col("height") == F.col("_h")) & (F.col("width") == F.col("_w"))
    wrong = F.raise_error(F.concat(F.lit("the mask of clip "), F.col("clip").cast("string"), F.lit(" has another size"))).cast("double")
    flat = F.when(fits, F.floor(F.col("value") * F.col("alpha") / 255 + 0.5)).otherwise(wrong)
    return joined.select("clip", "y", "x", flat.cast("long").alias("mask"), F.explode(F.expr("sequence(0L, num_frames - 1)")).alias("frame"))


def held_masks(masks: DataFrame, length: int, ratio: float) -> DataFrame:
    """(clip, frame, mask): masks (clip, frame from 0 on, value) binarised by their clip's largest value, and brought to
    length frames: later ones go, missing ones are the last frame's. Windows over a clip, which frames numbered by windows
    already lie in order for; no row is joined."""
    whole = Window.partitionBy("clip")
    rows = masks.where("clip IS NOT NULL").select("clip", "frame", "value", F.max("value").over(whole).alias("top"), F.max("frame").over(whole).alias("last"))
    on = F.when((F.col("top") <= 0) | (F.col("value") <= F.col("top") * ratio), 0).otherwise(255)
    # the last frame stands for all places from its own on
    shown = rows.where(f"frame = last AND last < {length} OR frame BETWEEN 0 AND {length - 1}")
    places = F.expr(f"IF(frame = last, sequence(greatest(CAST(frame AS bigint), 0L), {length - 1}L), array(CAST(frame AS bigint)))")
    return shown.select("clip", F.explode(places).alias("frame"), on.alias("mask"))


def request_ids(key: Column) -> Column:
    """"req_" and twelve hexadecimal digits, the same for the same key."""
    return F.concat(F.lit("req_"), F.substring(F.md5(key.cast("string").cast("binary")), 1, 12))


def signatures(calls: DataFrame, names: list[str]) -> DataFrame:
    """Per signature (the columns names) of calls (at, ...): when it was first seen, misses (that one) and hits (the
    others). Null is a value like others."""
    return calls.groupBy(*names).agg(F.min("at").alias("first_at"), F.lit(1).cast("long").alias("misses"), (F.count("*") - 1).alias("hits"))


def scenes_of_objects(requests: DataFrame) -> DataFrame:
    """(request, object, start, length): the scenes of each object of requests (request, objects, scenes: an array of
    scene lists). An object beyond the lists has the last one; null or empty lists have no scenes."""
    each = requests.withColumn("object", F.explode(F.expr("sequence(0, objects - 1)")))
    own = F.when(F.size("scenes") > 0, F.get("scenes", F.least(F.col("object"), F.size("scenes") - 1)))
    return each.select("request", "object", F.inline(own))
