"""Channel statistics, their transfer, and distances between sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def channel_stats(values: DataFrame, eps: float = 1e-5) -> DataFrame:
    """(channel, n, mean, std) of values (channel, x): std is sqrt(sample variance + eps), NaN for one value."""
    sums = values.groupBy("channel").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))
    return sums.select("channel", "n", "mean", F.when(F.col("n") == 1, F.lit(float("nan"))).otherwise(F.sqrt(F.col("var") + eps)).alias("std"))


def masked_stats(values: DataFrame, eps: float = 1e-8) -> DataFrame:
    """The same over the rows with mask > 0; a channel without any has mean 0 and std eps."""
    on = F.when(F.col("mask") > 0, F.col("x"))
    sums = values.groupBy("channel").agg(F.count(on).alias("n"), F.avg(on).alias("mean"), F.var_samp(on).alias("var"))
    std = F.when(F.col("n") == 0, F.lit(eps)).when(F.col("n") == 1, F.lit(float("nan"))).otherwise(F.sqrt("var"))
    return sums.select("channel", "n", F.coalesce("mean", F.lit(0.0)).alias("mean"), std.alias("std"))


def transferred(content: DataFrame, style: DataFrame, eps: float = 1e-5) -> DataFrame:
    """content (channel, id, x) with the mean and spread of style's channels: y.

    Statistics are one row a channel and joined back by it.
    """
    own = channel_stats(content, eps).select("channel", F.col("mean").alias("mc"), F.col("std").alias("sc"))
    aim = channel_stats(style, eps).select("channel", F.col("mean").alias("ms"), F.col("std").alias("ss"))
    return content.join(own.join(aim, "channel"), "channel").withColumn("y", (F.col("x") - F.col("mc")) / F.col("sc") * F.col("ss") + F.col("ms")).drop("mc", "sc", "ms", "ss")


def region_sums(pairs: DataFrame) -> DataFrame:
    """(clip, part, region, num, den) of pairs (clip, part, now, before, mask): changes and sizes, all and masked."""
    change, size = F.abs(F.col("now") - F.col("before")), F.abs("before")
    regions = F.explode(F.when(F.col("mask") > 0, F.array(F.lit("all"), F.lit("mask"))).otherwise(F.array(F.lit("all"), F.lit("background"))))
    return pairs.withColumn("region", regions).groupBy("clip", "part", "region").agg(F.sum(change).alias("num"), F.sum(size).alias("den"))


def region_distance(sums: DataFrame) -> DataFrame:
    """(clip, distance): the largest num / den of any part and region."""
    return sums.groupBy("clip").agg(F.max(F.col("num") / F.greatest("den", F.lit(1e-12))).alias("distance"))


def guided(branches: DataFrame, scale: float) -> DataFrame:
    """(id, y) = plain + scale * (prompted - plain) of two branches' values (id, plain, prompted)."""
    return branches.select("id", (F.col("plain") + scale * (F.col("prompted") - F.col("plain"))).alias("y"))


def merged_softmax(parts: DataFrame) -> DataFrame:
    """(id, value, norm) of partial softmax sums (id, top, norm, value): one exact softmax over all parts.

    top is the part's largest score, norm its sum of exp(score - top), value its sum of exp(score - top) * v.
    """
    tops = parts.groupBy("id").agg(F.max("top").alias("whole"))
    scaled = parts.join(tops, "id").withColumn("f", F.exp(F.col("top") - F.col("whole")))
    sums = scaled.groupBy("id").agg(F.sum(F.col("norm") * F.col("f")).alias("norm"), F.sum(F.col("value") * F.col("f")).alias("sum"))
    return sums.select("id", (F.col("sum") / F.col("norm")).alias("value"), "norm")


def masked_tensor_stats(values: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(tensor, n, mean, std) of values (tensor, x, mask) over all channels where mask > 0; without any, both are eps.

    std is sqrt(sample variance + eps), NaN for one value.
    """
    on = F.when(F.col("mask") > 0, F.col("x"))
    sums = values.groupBy("tensor").agg(F.count(on).alias("n"), F.avg(on).alias("mean"), F.var_samp(on).alias("var"))
    std = F.when(F.col("n") == 0, F.lit(eps)).when(F.col("n") == 1, F.lit(float("nan"))).otherwise(F.sqrt(F.col("var") + eps))
    return sums.select("tensor", "n", F.coalesce("mean", F.lit(eps)).alias("mean"), std.alias("std"))


def run_summary(runs: DataFrame, measure: str, checks: list[str], output: str) -> DataFrame:
    """Per group: runs, mean, min, max and sample deviation of measure (null for one run), whether each check holds in
    every run, and whether all outputs are the same."""
    m = F.col(measure)
    return runs.groupBy("group").agg(F.count("*").alias("runs"), F.avg(m).alias("mean"), F.min(m).alias("min"), F.max(m).alias("max"), F.stddev_samp(m).alias("std"), *[F.every(F.col(c)).alias(c) for c in checks], (F.min(output) == F.max(output)).alias("same_output"))
