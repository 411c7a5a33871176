"""Task plans as rows (plan, task_id, rank, cost): validation, flat encoding, its inverse and its digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.functions import arrays as ar

VERSION = 1
HEAD = 3


def validated(tasks: DataFrame) -> DataFrame:
    """(plan, tasks, rounds, fine): fine if task ids are 0, 1, ... each once, ranks not negative and costs positive.

    rounds is the largest number of tasks of a rank. Two partial aggregations, by (plan, rank) and by plan.
    """
    ranks = tasks.groupBy("plan", "rank").agg(F.count("*").alias("n"), F.min("task_id").alias("low"), F.max("task_id").alias("high"), F.sum("task_id").alias("total"), F.sum(F.col("task_id") * F.col("task_id")).alias("squares"), F.min("cost").alias("cost"))
    sums = ranks.groupBy("plan").agg(F.sum("n").alias("tasks"), F.max("n").alias("rounds"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("rank").alias("rank"), F.min("cost").alias("cost"))
    n = F.col("tasks")
    # n whole numbers within 0..n - 1 that have the sum and the square sum of all of them are all of them
    fine = (F.col("low") == 0) & (F.col("high") == n - 1) & (2 * F.col("total") == n * (n - 1)) & (6 * F.col("squares") == n * (n - 1) * (2 * n - 1)) & (F.col("rank") >= 0) & (F.col("cost") > 0)
    return sums.select("plan", "tasks", "rounds", fine.alias("fine"))


def encoded(tasks: DataFrame) -> DataFrame:
    """(plan, values): version, number of tasks and rounds, then id, rank and cost of each task in order."""
    own = tasks.groupBy("plan").agg(F.sort_array(F.collect_list(F.struct("task_id", "rank", "cost"))).alias("t"))
    rows = own.join(validated(tasks).where("fine"), "plan")
    flat = F.flatten(F.transform("t", lambda t: F.array(t.task_id, t.rank, t.cost)))
    return rows.select("plan", F.concat(F.array(F.lit(VERSION).cast("long"), F.col("tasks"), F.col("rounds")), flat).alias("values"))


def decoded(plans: DataFrame) -> DataFrame:
    """(plan, task_id, rank, cost) of encoded plans; another version and a wrong length raise."""
    v = F.col("values")
    good = (F.get(v, F.lit(0)) == VERSION) & (F.size(v) == HEAD + 3 * F.get(v, F.lit(1)))
    at = F.when(good, F.sequence(F.lit(0), ((F.size(v) - HEAD) / 3 - 1).cast("int"))).otherwise(F.raise_error(F.lit("no task plan")).cast("array<int>"))
    rows = plans.select("plan", "values", F.explode(at).alias("i"))
    return rows.select("plan", *[F.get(v, HEAD + 3 * F.col("i") + k).alias(name) for k, name in enumerate(("task_id", "rank", "cost"))])


def digests(plans: DataFrame) -> DataFrame:
    """(plan, digest): SHA-256 over the values as little-endian 64-bit integers."""
    return plans.select("plan", F.sha2(ar.bytes_of(F.col("values")), 256).alias("digest"))
