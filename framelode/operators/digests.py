"""Sequences of frames compared by digests, without an order between tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_digests(frames: DataFrame) -> DataFrame:
    """(clip, frame, digest): the SHA-256 of each frame's bytes; null pixels are empty."""
    return frames.select("clip", "frame", F.sha2(F.coalesce("pixels", F.lit(b"")), 256).alias("digest"))


def sequence_digests(digests: DataFrame) -> DataFrame:
    """(clip, frames, first, last, total) of frames (clip, frame, digest): a sum of hashes of place and digest together.

    Equal sequences have equal sums in whatever order their frames are added; a frame that moved, changed, went or came
    twice changes them. One partial aggregate, no sort. A sum is of two 64-bit hashes in 38 digits, so it doesn't overflow
    below 10**18 frames.
    """
    mark = lambda seed: F.xxhash64(F.lit(seed), "frame", "digest").cast("decimal(20,0)")
    sums = [F.sum(mark(s)).cast("string") for s in (1, 2)]
    return digests.groupBy("clip").agg(F.count("*").alias("frames"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.concat_ws(":", *sums).alias("total"))


def compared_sequences(left: DataFrame, right: DataFrame, skip: int = 0) -> DataFrame:
    """(clip, frames, other_frames, equal, first_difference) of two sequences (clip, frame, digest) for each clip.

    skip: right begins skip frames later, so its frame i stands against left's i + skip, and left's first skip frames
    don't count. first_difference is the first of left's frames that is missing on a side, different, or there twice.
    Clips of equal sums are equal; the others are joined frame by frame, which finds the place and proves the difference.
    """
    here = left.where(F.col("frame") >= skip).select("clip", "frame", "digest")
    there = right.select("clip", (F.col("frame") + skip).alias("frame"), "digest")
    a, b = sequence_digests(here), sequence_digests(there)
    sums = a.select("clip", "frames", "total").join(b.select("clip", F.col("frames").alias("other_frames"), F.col("total").alias("other")), "clip", "full")
    sums = sums.select("clip", F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("other_frames", F.lit(0)).alias("other_frames"), F.coalesce(F.col("total") == F.col("other"), F.lit(False)).alias("same"))
    open_ = sums.where("NOT same").select("clip")
    each = lambda side, name: side.join(open_, "clip", "left_semi").groupBy("clip", "frame").agg(F.count("*").alias(f"{name}_n"), F.min("digest").alias(name))
    both = each(here, "x").join(each(there, "y"), ["clip", "frame"], "full")
    differs = both.where("NOT (x_n <=> y_n AND x <=> y) OR x_n > 1").groupBy("clip").agg(F.min("frame").alias("first_difference"))
    return sums.join(differs, "clip", "left").select("clip", "frames", "other_frames", F.col("first_difference").isNull().alias("equal"), "first_difference")
