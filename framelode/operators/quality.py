"""Comparing a candidate sequence with a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelode.operators.images import MEASURES


def pixel_quality(pixels: DataFrame, peak: float = 255.0) -> DataFrame:
    """Per (clip, frame) of pixels (clip, frame, reference, candidate, mask): errors inside and outside the mask.

    mae, mse, ssim (one window over the whole frame), mask_pixels, mask_mae, outside_mae; a region without pixels is
    null. All of it is one partial aggregation.
    """
    a, b, d = F.col("reference"), F.col("candidate"), F.abs(F.col("reference") - F.col("candidate"))
    on = F.col("mask") > 0
    sums = pixels.groupBy("clip", "frame").agg(F.avg(d).alias("mae"), F.avg(d * d).alias("mse"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(a * a).alias("aa"), F.avg(b * b).alias("bb"), F.avg(a * b).alias("ab"), F.count_if(on).alias("mask_pixels"), F.avg(F.when(on, d)).alias("mask_mae"), F.avg(F.when(~on, d)).alias("outside_mae"))
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    ma, mb = F.col("ma"), F.col("mb")
    va, vb, cov = F.col("aa") - ma * ma, F.col("bb") - mb * mb, F.col("ab") - ma * mb
    ssim = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return sums.select("clip", "frame", ssim.alias("ssim"), "mae", "mse", "mask_pixels", "mask_mae", "outside_mae")


def temporal_delta(pixels: DataFrame) -> DataFrame:
    """(clip, frame, mae, temporal_delta) of pixels (clip, frame, place, reference, candidate).

    temporal_delta: the mean over pixels of how much a pixel's error differs from its error in the frame before; null
    for a clip's first frame. A window follows one pixel of a clip, so a long clip is spread over its pixels.
    """
    past = Window.partitionBy("clip", "place").orderBy("frame")
    error = F.col("candidate") - F.col("reference")
    rows = pixels.select("clip", "frame", "place", error.alias("e")).withColumn("d", F.abs(F.col("e") - F.lag("e").over(past)))
    return rows.groupBy("clip", "frame").agg(F.avg(F.abs("e")).alias("mae"), F.avg("d").alias("temporal_delta"))


def summary(quality: DataFrame) -> DataFrame:
    """One row a clip: means (nulls left out), the smallest ssim and its first frame, and the number of frames."""
    worst = F.min(F.struct("ssim", "frame"))
    return quality.groupBy("clip").agg(F.count("*").alias("frames"), F.avg("ssim").alias("ssim"), F.avg("mae").alias("mae"), F.avg("mask_mae").alias("mask_mae"), F.avg("outside_mae").alias("outside_mae"), worst.alias("worst")).select("clip", "frames", "ssim", "mae", "mask_mae", "outside_mae", F.col("worst.ssim").alias("min_ssim"), F.col("worst.frame").alias("min_frame"))


def report(quality: DataFrame) -> DataFrame:
    """One row a clip of quality (clip, frame, and the measures of images.compared): frames, mask_frames (those with a
    masked pixel), the mean of each measure over the frames that have it, the smallest ssim and mask_ssim, and the first
    frames that have them."""
    means = [F.avg(m).alias(m) for m in MEASURES]
    worst = F.min(F.struct("ssim", "frame"))
    masked = F.min(F.when(F.col("mask_ssim").isNotNull(), F.struct("mask_ssim", "frame")))
    sums = quality.groupBy("clip").agg(F.count("*").alias("frames"), F.count("mask_ssim").alias("mask_frames"), *means, worst.alias("worst"), masked.alias("masked"))
    return sums.select("clip", "frames", "mask_frames", *MEASURES, F.col("worst.ssim").alias("min_ssim"), F.col("masked.mask_ssim").alias("min_mask_ssim"), F.col("worst.frame").alias("worst_frame"), F.col("masked.frame").alias("worst_mask_frame"))
