"""Masks over frames: thresholds, temporal groups, downsampling and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def thresholded(x: Column, threshold: Column) -> Column:
    """0 up to the threshold, else 255. No value is at most NaN, so a NaN threshold gives 255."""
    return F.when(F.isnan(threshold), 255).when(F.isnan(x) | (x > threshold), 255).otherwise(0)


def binarized(frames: DataFrame, ratio: float, by: str | None = None) -> DataFrame:
    """frames with mask = 0 up to ratio times the largest value (of all rows, or of each by), else 255.

    Nothing is masked where the largest value isn't positive. The maximum is one row, or one a group, and joined back.
    """
    if by is None:
        top = frames.agg(F.max("value").alias("top"))
        joined = frames.crossJoin(F.broadcast(top))  # one row
    else:
        joined = frames.join(frames.groupBy(by).agg(F.max("value").alias("top")), by)
    return joined.withColumn("mask", F.when((F.col("top") <= 0) | (F.col("value") <= F.col("top") * ratio), 0).otherwise(255)).drop("top")


def temporal_groups(frames: DataFrame, head: bool = True, size: int = 8) -> DataFrame:
    """(clip, part, mask): masks (clip, frame, mask) in tumbling groups of size frames, on if any frame is.

    In a clip's head the first frame is a group by itself.
    """
    shift = 1 if head else 0
    part = F.when(F.col("frame") < shift, F.lit(0).cast("long")).otherwise(F.floor((F.col("frame") - shift) / size) + shift)
    return frames.groupBy("clip", part.alias("part")).agg(F.when(F.max("mask") >= 1, 255).otherwise(0).alias("mask"))


def nearest_frames(frames: DataFrame, clips: DataFrame, target: int) -> DataFrame:
    """(clip, place, frame, value): each clip at target places, place i taking frame floor(i * n / target)."""
    picks = clips.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(target - 1).cast("long")))).select("clip", "place", F.expr(f"place * num_frames div {target}").alias("frame"))
    return picks.join(frames.select("clip", "frame", "value"), ["clip", "frame"])


def gray(r: Column, g: Column, b: Column) -> Column:
    """The mask's weighted channels; fixed values, the blue one isn't scaled."""
    return 0.299 / 255 * r + 0.587 / 255 * g + 0.0004 * b


def union_boxes(boxes: DataFrame) -> DataFrame:
    """(object, x1, y1, x2, y2): the box around all boxes (x, y, w, h) of an object with any positive value."""
    corners = boxes.where("x > 0 OR y > 0 OR x + w > 0 OR y + h > 0").groupBy("object").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.expr("x + w")).alias("x2"), F.max(F.expr("y + h")).alias("y2"))
    return corners.where("x2 > x1 AND y2 > y1")


def window_boxes(boxes: DataFrame, windows: DataFrame) -> DataFrame:
    """(clip, window_index, x1, y1, x2, y2): the union of the boxes of a window's new frames; windows without are out.

    boxes: clip, frame, x1, y1, x2, y2. Windows name their frames, so this is an equi-join with partial sums.
    """
    named = windows.where("deal_length > 0").select("clip", "window_index", F.explode(F.expr("sequence(deal_start, deal_start + deal_length - 1)")).alias("frame"))
    hit = named.join(boxes.where("x2 > x1 AND y2 > y1"), ["clip", "frame"])
    return hit.groupBy("clip", "window_index").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def boxes_or_frames(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """boxes (object, frame, x, y, w, h) with the whole frame where a box is null or has no area."""
    none = F.coalesce((F.col("w") <= 0) | (F.col("h") <= 0), F.lit(True)) | F.col("x").isNull() | F.col("y").isNull()
    whole = {"x": 0, "y": 0, "w": width, "h": height}
    return boxes.select("object", "frame", *[F.when(none, F.lit(v).cast("long")).otherwise(F.col(c)).alias(c) for c, v in whole.items()])


def aligned_boxes(boxes: DataFrame, width: int, height: int, align: int, min_pixels: int = 256 * 256, max_pixels: int = 1920 * 1088, ratio: float = 1.0) -> DataFrame:
    """Boxes (x, y, w, h) scaled by ratio, but to at least min_pixels, aligned, and moved to lie in the frame.

    After alignment the longer side shrinks again to what min_pixels asks for, though not below the box itself. A box
    or result of more than max_pixels (0: no bound) raises. A negative ratio takes the largest box of the frame's
    longer fit with max_pixels. Boxes without an area are left out.
    """
    if 0 <= ratio < 1:
        raise ValueError("a ratio from 0 to 1 isn't supported")
    w, h = F.col("w"), F.col("h")
    up = lambda c: F.ceil(c / align) * align
    if ratio >= 1:
        least = F.greatest(F.sqrt(F.lit(float(min_pixels)) / (w * h)), F.lit(1.0)) if min_pixels > 0 else F.lit(1.0)
        most = F.greatest(F.sqrt(F.lit(float(max_pixels)) / (w * h)), least) if max_pixels > 0 else F.lit(float("inf"))
        scale = F.greatest(least, F.least(F.lit(float(ratio)), most))
        size = F.least(F.ceil(w * scale), F.lit(width)), F.least(F.ceil(h * scale), F.lit(height))
    else:
        by_width = F.lit(width) / w < F.lit(height) / h
        size = F.when(by_width, width).otherwise(max_pixels // height), F.when(by_width, max_pixels // width).otherwise(height)
    sized = boxes.where("w > 0 AND h > 0").withColumn("tw", up(size[0])).withColumn("th", up(size[1]))
    if max_pixels > 0:
        large = F.raise_error(F.format_string("box of %d x %d exceeds %d pixels", w, h, F.lit(max_pixels)))
        sized = sized.withColumn("tw", F.when(w * h > max_pixels, large).otherwise(F.col("tw")))
    shrunk = lambda own, other, side: F.greatest(F.least(F.col(own), up(F.floor(F.lit(min_pixels) / F.col(other)))), F.least(up((side * F.lit(ratio)).cast("long")), up(side)))
    wide = F.col("tw") > F.col("th")
    sized = sized.select("*", F.when(wide, shrunk("tw", "th", w)).otherwise(F.col("tw")).alias("sw"), F.when(wide, F.col("th")).otherwise(shrunk("th", "tw", h)).alias("sh"))
    if max_pixels > 0:
        large = F.raise_error(F.format_string("scaled box of %d x %d exceeds %d pixels", F.col("sw"), F.col("sh"), F.lit(max_pixels)))
        sized = sized.withColumn("sw", F.when(F.col("sw") * F.col("sh") > max_pixels, large).otherwise(F.col("sw")))
    grown = sized.withColumn("sw", F.least("sw", F.lit(width // align * align))).withColumn("sh", F.least("sh", F.lit(height // align * align)))
    place = lambda at, side, target, cap: F.least(F.greatest(F.lit(0).cast("long"), F.floor((2 * F.col(at) + side) / 2) - F.floor(F.col(target) / 2)), cap - F.col(target))
    return grown.select("object", "frame", place("x", w, "sw", width).alias("bx"), place("y", h, "sh", height).alias("by"), F.col("sw").alias("bw"), F.col("sh").alias("bh"))


def pooled(pixels: DataFrame, factor: int) -> DataFrame:
    """(clip, frame, y, x, mask) at 1 / factor: 1 where any pixel of a factor x factor block is above 0. Blocks that the
    frame (height, width) doesn't fill are left out."""
    whole = pixels.where(f"y < height div {factor} * {factor} AND x < width div {factor} * {factor}")
    return whole.groupBy("clip", "frame", F.expr(f"y div {factor}").alias("y"), F.expr(f"x div {factor}").alias("x")).agg(F.max((F.col("mask") > 0).cast("double")).alias("mask"))


def encoded(pixels: DataFrame, clips: DataFrame, height: int, width: int, frames: int, pool: bool = False) -> DataFrame:
    """(clip, part, y, x, mask): masks (clip, frame, height, width, y, x, channel, mask) as a model's latents take them.

    Of the channels the largest counts. Space: height x width places, each the pixel at floor(place * size / places), or,
    with pool, whether a block of ceil(size / places) pixels has any. Time: a clip's first frame alone, the others of clips
    (clip, num_frames) in frames - 1 equal groups, the largest of each; a clip whose frames can't be dealt so raises.
    Only maxima: partial sums and equi-joins.
    """
    flat = pixels.groupBy("clip", "frame", "height", "width", "y", "x").agg(F.max("mask").alias("mask"))
    if pool:
        factor = "greatest(1, ceil(height / {0}), ceil(width / {1}))".format(height, width)
        blocks = flat.withColumn("_f", F.expr(factor)).where("y < height div _f * _f AND x < width div _f * _f")
        small = blocks.groupBy("clip", "frame", F.expr("y div _f").alias("y"), F.expr("x div _f").alias("x")).agg(F.max((F.col("mask") > 0).cast("double")).alias("mask"))
    else:
        # a pixel stands at the places whose floor it is
        at = lambda v, size, n: F.explode(F.expr(f"filter(sequence(CAST({v} * {n} div {size} AS bigint), CAST(({v} + 1) * {n} div {size} AS bigint)), p -> p < {n} AND p * {size} div {n} = {v})"))
        small = flat.withColumn("_y", at("y", "height", height)).withColumn("_x", at("x", "width", width)).select("clip", "frame", F.col("_y").alias("y"), F.col("_x").alias("x"), "mask")
    fits = (F.col("num_frames") - 1) % max(frames - 1, 1) == 0
    bad = F.raise_error(F.concat_ws(" ", F.lit("the frames of clip"), "clip", F.lit("don't make equal groups"))).cast("long")
    size = clips.select("clip", F.when(fits, F.expr(f"(num_frames - 1) div {max(frames - 1, 1)}")).otherwise(bad).alias("_size"))
    part = F.when(F.col("frame") == 0, F.lit(0).cast("long")).otherwise(F.expr("(frame - 1) div _size + 1"))
    return small.join(size, "clip").groupBy("clip", part.alias("part"), "y", "x").agg(F.max("mask").alias("mask"))
