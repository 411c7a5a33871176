"""Timings: sums by stage, spreads over requests, counts over a fixed domain, first errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_sums(timings: DataFrame) -> DataFrame:
    """(request, stage, ms, calls) of timings (request, stage, ms)."""
    return timings.groupBy("request", "stage").agg(F.sum("ms").alias("ms"), F.count("*").alias("calls"))


def spread(timings: DataFrame) -> DataFrame:
    """Per stage: mean, median (of the middle two), min, max and sample deviation (null for one) of requests' sums."""
    return stage_sums(timings).groupBy("stage").agg(F.count("*").alias("requests"), F.avg("ms").alias("mean_ms"), F.median("ms").alias("median_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.stddev_samp("ms").alias("std_ms"))


def pure_seconds(timings: DataFrame, stages: list[str]) -> DataFrame:
    """(request, seconds) of the listed stages only; null where a request has none of them."""
    return timings.groupBy("request").agg((F.sum(F.when(F.col("stage").isin(stages), F.col("ms"))) / 1000).alias("seconds"))


def counted_over(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """(column, n) for every value of the domain, absent ones with 0."""
    spark = rows.sparkSession
    values = spark.createDataFrame([(v,) for v in domain], f"{column} string")
    return values.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def collective_profile(calls: DataFrame) -> DataFrame:
    """Per (kind, clip) of calls (kind, clip, seq, bytes, error): calls, bytes, failures and the first error."""
    first = F.min(F.when(F.col("error").isNotNull(), F.struct("seq", "error")))
    return calls.groupBy("kind", "clip").agg(F.count("*").alias("calls"), F.sum("bytes").alias("bytes"), F.count("error").alias("failures"), first.alias("first")).select("kind", "clip", "calls", "bytes", "failures", F.col("first.error").alias("first_error"))


def clipped(values: DataFrame, limit: float) -> DataFrame:
    """Per layer and for all (layer null) of values (layer, x): elements, largest size, clipped, non-finite, share."""
    x = F.col("x")
    finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    out = values.rollup("layer").agg(F.count("*").alias("elements"), F.max(F.when(finite, F.abs(x))).alias("max_abs"), F.count_if(finite & (F.abs(x) > limit)).alias("clipped"), F.count_if(~finite).alias("nonfinite"))
    return out.withColumn("clipped_share", F.try_divide(F.col("clipped"), F.col("elements")))
