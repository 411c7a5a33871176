"""Window plans over ordered frames: which frames a window loads, deals with and may emit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whole_clips(clips: DataFrame) -> DataFrame:
    """One scene for each clip (clip, num_frames)."""
    return clips.select("clip", F.col("num_frames").cast("long").alias("num_frames"), F.lit(0).cast("long").alias("scene_index"), F.lit(0).cast("long").alias("scene_start"), F.col("num_frames").cast("long").alias("scene_end"))


def normalized_scenes(scenes: DataFrame) -> DataFrame:
    """Scenes (clip, num_frames, start, length) cut to their clips.

    Null, empty and later ones go, a negative start becomes 0, the length is cut at the clip's end; a clip left without
    scenes is one scene as a whole. Scenes are numbered by start.
    """
    clean = scenes.where("start IS NOT NULL AND length > 0 AND start < num_frames").select("clip", "num_frames", F.greatest("start", F.lit(0)).alias("scene_start"), F.col("length"))
    cut = clean.select("clip", "num_frames", "scene_start", F.least(F.col("scene_start") + F.col("length"), "num_frames").alias("scene_end")).where("scene_end > scene_start")
    bare = scenes.select("clip", "num_frames").distinct().join(cut.select("clip").distinct(), "clip", "left_anti")
    every = cut.unionByName(bare.select("clip", "num_frames", F.lit(0).cast("long").alias("scene_start"), F.col("num_frames").alias("scene_end")))
    index = F.row_number().over(Window.partitionBy("clip").orderBy("scene_start", "scene_end")) - 1
    return every.withColumn("scene_index", index.cast("long"))


def window_plan(scenes: DataFrame, infer_len: int, overlap: int) -> DataFrame:
    """The windows of scenes (clip, num_frames, scene_index, scene_start, scene_end).

    Windows of infer_len frames follow each other with overlap common frames; the last one of a scene deals with what
    is left of it, but may load the clip's frames after the scene. window_index runs on over a clip's scenes. The plan
    is a projection and an explode; only the numbering looks at the scenes of a clip together.
    """
    if not 0 <= overlap < infer_len:
        raise ValueError("overlap must be in [0, infer_len)")
    step = infer_len - overlap
    length = F.col("scene_end") - F.col("scene_start")
    count = 1 + F.greatest(F.ceil((length - infer_len) / step), F.lit(0))
    before = F.sum("windows").over(Window.partitionBy("clip").orderBy("scene_index").rowsBetween(Window.unboundedPreceding, -1))
    rows = scenes.withColumn("windows", count).withColumn("base", F.coalesce(before, F.lit(0))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1)))
    i, left = F.col("i"), F.when(F.col("i") == 0, 0).otherwise(overlap)
    deal = F.when(i == 0, F.col("scene_start")).otherwise(F.col("scene_start") + infer_len + (i - 1) * step)
    rows = rows.withColumn("deal_start", deal).withColumn("overlap_left", left.cast("long")).withColumn("need", infer_len - F.col("overlap_left"))
    rows = rows.withColumn("deal_length", F.least("need", F.col("scene_end") - F.col("deal_start"))).withColumn("load_length", F.least(F.col("num_frames") - F.col("deal_start"), "need"))
    right = F.when(F.col("deal_start") + F.col("deal_length") < F.col("scene_end"), overlap).otherwise(0)
    return rows.select("clip", (F.col("base") + i).alias("window_index"), "scene_index", "scene_start", "scene_end", (F.col("deal_start") - F.col("overlap_left")).alias("load_start"), (F.col("deal_start") + F.col("load_length")).alias("load_end"), "deal_start", "deal_length", "load_length", "overlap_left", right.cast("long").alias("overlap_right"))


def stable_ranges(windows: DataFrame) -> DataFrame:
    """What each window may emit for good: [stable_start, stable_end). A clip's ranges follow without gap."""
    return windows.select("clip", "window_index", F.col("load_start").alias("stable_start"), (F.col("deal_start") + F.col("deal_length") - F.col("overlap_right")).alias("stable_end"))


def frame_windows(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Frames (clip, frame, ...) with each window that loads them.

    The range join is an equi-join on (clip, frame): a window names its frames, at most infer_len of them, so Spark can
    shuffle or broadcast it like any other.
    """
    named = windows.where("load_end > load_start").select("clip", "window_index", "load_start", F.explode(F.expr("sequence(load_start, load_end - 1)")).alias("frame"))
    return frames.join(named, ["clip", "frame"]).withColumn("place", F.col("frame") - F.col("load_start")).drop("load_start")


def pad_plan(n: Column, head: Column, infer_len: int, shift: int) -> tuple[Column, Column]:
    """(batches, padded frames) for n frames of a window; head: the clip's first window."""
    wrap = infer_len - shift
    batches = F.when(head, F.greatest(F.lit(1), F.ceil((n - shift) / wrap))).otherwise(F.ceil(n / wrap))
    return batches, F.when(head, batches * wrap + shift - n).otherwise(batches * wrap - n)


def compact_length(n: Column, head: Column, infer_len: int, overlap: int) -> Column:
    """The shorter window for the last n new frames."""
    return F.when(head, F.lit(infer_len)).otherwise(F.least(F.lit(infer_len), overlap + F.greatest(F.lit(8), F.floor((n + 7) / 8) * 8)))


def mirror_source(place: Column, n: Column) -> Column:
    """The frame that stands at a place of a clip of n frames which is continued by its mirror image, ends once."""
    period = F.greatest(2 * n - 2, F.lit(1))
    at = place % period
    return F.when(at < n, at).otherwise(period - at)


def repeated_frames(clips: DataFrame, length: int) -> DataFrame:
    """(clip, place, last_source, mirror_source) of clips stretched to length, by the last frame or back and forth."""
    rows = clips.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))))
    turned = F.when(F.col("num_frames") < 2, F.lit(0)).otherwise(mirror_turned(F.col("place"), F.col("num_frames")))
    return rows.select("clip", "place", F.least(F.col("place"), F.col("num_frames") - 1).alias("last_source"), turned.alias("mirror_source"))


def mirror_turned(place: Column, n: Column) -> Column:
    """Back and forth: after the last frame the sequence steps back from it, the last frame itself first."""
    back = place - n
    period = 2 * n - 2
    at = back % period
    return F.when(place < n, place).otherwise(F.when(at < n, n - 1 - at).otherwise(at - n + 1))


def passthrough(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """Frames that no stable range covers, which are emitted as they came."""
    covered = ranges.where("stable_end > stable_start").select("clip", F.explode(F.expr("sequence(stable_start, stable_end - 1)")).alias("frame"))
    return frames.join(covered, ["clip", "frame"], "left_anti")


def around(frames: DataFrame, size: int) -> DataFrame:
    """frames (clip, frame, num_frames) with start and frames: the window of up to size frames around each, not before the
    clip's first."""
    n = F.greatest(F.least(F.lit(size), F.col("num_frames")), F.lit(0)).cast("long")
    return frames.withColumns({"start": F.greatest(F.col("frame") - F.floor(n / 2), F.lit(0)), "frames": n})
