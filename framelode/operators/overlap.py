"""Joining the outputs of windows where they overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.functions.numbers import ramp


def blended(placed: DataFrame, windows: DataFrame, mode: str, whole: bool = False) -> DataFrame:
    """(clip, frame, value, windows): outputs (clip, window_index, frame, value) of all windows as one sequence.

    Inside the overlap of a window with the one before, both values are mixed by ramp(mode); elsewhere there is only
    one. With whole, values are bytes: clipped to 0..255 and rounded half to even. A frame belongs to two windows at
    most, which meet by a join on (clip, frame) with the later window's number: a shuffle that the plan already has.
    """
    parts = windows.select("clip", "window_index", "load_start", "overlap_left", "deal_start", "deal_length")
    later = placed.join(parts, ["clip", "window_index"]).where("frame < deal_start + deal_length")
    place = F.col("frame") - F.col("load_start")
    inside = place < F.col("overlap_left")
    weight = F.when(inside, ramp(place, F.col("overlap_left"), mode)).otherwise(0.0)
    now = later.select("clip", "frame", "window_index", "value", weight.alias("weight"), inside.alias("inside"))
    before = placed.select("clip", "frame", (F.col("window_index") + 1).alias("window_index"), F.col("value").alias("earlier"))
    joined = now.join(before, ["clip", "frame", "window_index"], "left")
    mixed = F.when(F.col("inside") & F.col("earlier").isNotNull(), F.col("weight") * F.col("earlier") + (1 - F.col("weight")) * F.col("value")).otherwise(F.col("value"))
    if whole:
        mixed = F.rint(F.least(F.greatest(mixed, F.lit(0.0)), F.lit(255.0)))
    out = joined.withColumn("mixed", mixed)
    # the frame's last window has the say
    return out.groupBy("clip", "frame").agg(F.max(F.struct("window_index", "mixed")).alias("last"), F.count("*").alias("windows")).select("clip", "frame", F.col("last.mixed").alias("value"), "windows")


def seamed(tiles: DataFrame, axis: str, others: list[str], size: int, extent: int) -> DataFrame:
    """Tiles (tile, axis, others..., value) whose first extent places along axis blend with the end of the tile before.

    Place i of the seam takes (1 - i / extent) of the earlier tile's place size - extent + i. One equi-join of the few
    seam rows; the rest of a tile passes.
    """
    extent = min(extent, size)
    before = tiles.where(F.col(axis) >= size - extent).select((F.col("tile") + 1).alias("tile"), (F.col(axis) - (size - extent)).alias(axis), *others, F.col("value").alias("_earlier"))
    share = F.col(axis) / extent
    return tiles.join(before, ["tile", axis, *others], "left").withColumn("value", F.when(F.col("_earlier").isNull(), F.col("value")).otherwise(F.col("_earlier") * (1 - share) + F.col("value") * share)).drop("_earlier")
