"""Objects worked on one after the other: what one gives out is what the next takes in.

For each object the windows get the box around its boxes, and a window is worked on where the mask still has something in
that box. Its frames come out changed inside the box, those of other windows as they came; then the mask is cleared in
the boxes that were worked on, so that a later object doesn't work on them again. A round is one plan of Spark jobs and
ends in a written table, so the lineage of a chain is never longer than a round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelode.operators.masks import window_boxes
from framelode.operators.rangestore import appended
from framelode.streaming.carried import carried_windows

IN_BOX = "i div width >= y1 AND i div width < y2 AND i % width >= x1 AND i % width < x2"


def live_windows(frames: DataFrame, boxes: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with live, x1, y1, x2, y2 and width: the box of each window's new frames, and whether the mask of one of them
    has something in it. frames (clip, frame, width, mask), boxes (clip, frame, x1, y1, x2, y2)."""
    around = window_boxes(boxes, plan)
    named = plan.join(around, ["clip", "window_index"]).where("deal_length > 0").withColumn("frame", F.explode(F.expr("sequence(deal_start, deal_start + deal_length - 1)")))
    held = named.select("clip", "window_index", "frame", "x1", "y1", "x2", "y2").join(frames.select("clip", "frame", "width", "mask"), ["clip", "frame"])
    hit = F.expr(f"exists(sequence(0, size(mask) - 1), i -> get(mask, i) > 0 AND {IN_BOX})")
    seen = held.groupBy("clip", "window_index").agg(F.max(hit.cast("int")).alias("live"), F.max("width").alias("width"))
    both = plan.join(around.join(seen, ["clip", "window_index"]), ["clip", "window_index"], "left")
    return both.withColumn("live", F.coalesce("live", F.lit(0)))


def cleared(frames: DataFrame, plan: DataFrame) -> DataFrame:
    """frames (clip, frame, width, mask, ...) with the mask at 0 in the boxes of the live windows' new frames."""
    named = plan.where("live = 1 AND deal_length > 0").select("clip", "x1", "y1", "x2", "y2", F.explode(F.expr("sequence(deal_start, deal_start + deal_length - 1)")).alias("frame"))
    zero = F.expr(f"transform(mask, (v, i) -> IF({IN_BOX}, CAST(0 AS double), v))")
    return frames.join(named, ["clip", "frame"], "left").withColumn("mask", F.when(F.col("x1").isNull(), F.col("mask")).otherwise(zero)).drop("x1", "y1", "x2", "y2")


def passed_ranges(out: DataFrame) -> DataFrame:
    """(clip, version, start, end, changed): runs of frames that came out changed or as they were, in order; a clip whose
    frames don't follow each other from 0 on raises. out: (clip, frame, changed); only these light rows are ordered."""
    order = Window.partitionBy("clip").orderBy("frame")
    new = F.when((F.lag("changed").over(order) != F.col("changed")) | (F.lag("frame").over(order) != F.col("frame") - 1) | F.lag("frame").over(order).isNull(), 1).otherwise(0)
    runs = out.select("clip", "frame", "changed").withColumn("_new", new).withColumn("version", F.sum("_new").over(order) - 1)
    spans = runs.groupBy("clip", "version").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end"), F.first("changed").alias("changed"))
    return appended(spans).join(spans.select("clip", "version", "changed"), ["clip", "version"])


def chained(frames: DataFrame, boxes: DataFrame, plan: DataFrame, objects: list, edit: Callable, folder: str, mode: str = "before") -> tuple[DataFrame, DataFrame]:
    """Works on frames (clip, frame, height, width, pixels, mask: arrays of numbers, row after row) for each of objects, in
    their order.

    boxes (object, clip, frame, x1, y1, x2, y2); plan as of window_plan(); edit(pixels, window_index, object) gives a
    window's frames anew. Returns the frames, with the mask that is left, and the ranges (object, clip, version, start,
    end, changed) that each object has passed on: they cover every clip without a gap, or it raises. An object without
    boxes passes everything as it is. folder: a path that all nodes share; a round's tables are written there.
    """
    spark = frames.sparkSession
    held, ranges = frames, None
    for number, name in enumerate(objects):
        own = live_windows(held, boxes.where(F.col("object") == F.lit(name)).drop("object"), plan)
        own.write.parquet(f"{folder}/plan-{number}")
        own = spark.read.schema(own.schema).parquet(f"{folder}/plan-{number}")
        out = carried_windows(held.select("clip", "frame", "pixels", F.lit(False).alias("masked")), own, lambda pixels, k, name=name: edit(pixels, k, name), mode)
        out.write.parquet(f"{folder}/out-{number}")
        out = spark.read.schema(out.schema).parquet(f"{folder}/out-{number}")
        passed = passed_ranges(out).withColumn("object", F.lit(name))
        ranges = passed if ranges is None else ranges.unionByName(passed)
        new = cleared(held.drop("pixels"), own).join(out.select("clip", "frame", "pixels"), ["clip", "frame"])
        new = new.select(*frames.columns)
        new.write.parquet(f"{folder}/frames-{number}")
        held = spark.read.schema(new.schema).parquet(f"{folder}/frames-{number}")
    return held, ranges
