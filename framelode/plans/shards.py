"""Partition plans: who holds which part of a sequence, a task list or a set of ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task of islands() orders, about.
ROWS = 1_000_000


def padded_shards(rows: DataFrame, degree: int) -> DataFrame:
    """Equal shards of sequences (id, length): rank, first, last (exclusive), padding up to the common size."""
    size = F.ceil(F.col("length") / degree)
    parts = rows.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(degree - 1).cast("long")))).withColumn("first", F.least(F.col("rank") * size, "length"))
    parts = parts.withColumn("last", F.least(F.col("first") + size, "length"))
    return parts.select("id", "rank", "first", "last", (size - (F.col("last") - F.col("first"))).alias("padding"))


def uneven_shards(rows: DataFrame, degree: int) -> DataFrame:
    """Shards [length * rank div degree, length * (rank + 1) div degree) without padding."""
    parts = rows.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(degree - 1).cast("long"))))
    return parts.select("id", "rank", F.expr(f"length * rank div {degree}").alias("first"), F.expr(f"length * (rank + 1) div {degree}").alias("last"))


def strided(index: Column, degree: int) -> tuple[Column, Column]:
    """(worker, round) of task number index when workers take turns."""
    return F.pmod(index, F.lit(degree)), F.floor(index / degree)


def topology(ranks: DataFrame, sp: int, cfg: int) -> DataFrame:
    """Ranks (rank) in sp neighbouring groups and cfg strided ones; sp * cfg ranks make a replica."""
    r = F.col("rank")
    return ranks.select("rank", F.floor(r / sp).alias("sp_group"), (r % sp).alias("sp_rank"), (F.floor(r / (sp * cfg)) * sp + r % sp).alias("cfg_group"), (F.floor(r / sp) % cfg).alias("cfg_rank"))


def islands(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Sets of integers as runs: (group, runs) such as "0-3,7,9-10". Nulls count for nothing; of them alone runs is null.

    A run begins where the value before is missing and ends where the next one is; only its ends are collected. Groups
    are dealt to tasks of about ROWS rows, so that what a task orders doesn't grow with the table.
    """
    order = Window.partitionBy(group).orderBy(value)
    at = F.col(value)
    dealt = rows.select(group, value).distinct().repartition(max(1, -(-rows.count() // ROWS)), group)
    first, last = F.coalesce(F.lag(at).over(order) < at - 1, F.lit(True)), F.coalesce(F.lead(at).over(order) > at + 1, F.lit(True))
    ends = dealt.select(group, value, first.alias("first"), last.alias("last")).where("first OR last")
    runs = ends.select(group, "first", at.alias("a"), F.when(F.col("last"), at).otherwise(F.lead(at).over(order)).alias("b")).where("first")
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    listed = runs.groupBy(group).agg(F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", text.alias("t"))))).alias("l"))
    return listed.select(group, F.when(F.size("l") > 0, F.array_join(F.transform("l", lambda x: x["t"]), ",")).alias("runs"))


def cpu_map(rows: DataFrame, world: int) -> DataFrame:
    """(id, rank, cpu) of maps (id, text) such as "0=0-3;1=4,6": each rank of 0..world - 1 once, no CPU in two ranks.

    What breaks these rules raises when it is read.
    """
    parts = rows.select("id", F.explode(F.filter(F.split("text", ";"), lambda p: F.trim(p) != "")).alias("part"))
    good = F.col("part").rlike(r"^\s*\d+\s*=\s*\d+(-\d+)?(\s*,\s*\d+(-\d+)?)*\s*$")
    split = parts.select("id", F.when(good, F.split("part", "=")).otherwise(F.raise_error(F.concat(F.lit("invalid CPU assignment "), "part")).cast("array<string>")).alias("p"))
    listed = split.select("id", F.trim(F.get("p", F.lit(0))).cast("long").alias("rank"), F.explode(F.split(F.get("p", F.lit(1)), ",")).alias("run"))
    ends = F.transform(F.split("run", "-"), lambda t: F.trim(t).cast("long"))
    cpus = listed.select("id", "rank", F.explode(F.sequence(F.get(ends, F.lit(0)), F.element_at(ends, -1))).alias("cpu"))
    each = Window.partitionBy("id")
    faults = F.when(F.max("rank").over(each) >= world, "a rank is outside the world").when(F.size(F.collect_set("rank").over(each)) < world, "a rank is missing").when(F.count("cpu").over(each) > F.size(F.collect_set("cpu").over(each)), "a CPU belongs to two ranks")
    return cpus.withColumn("fault", faults).select("id", "rank", F.when(F.col("fault").isNull(), F.col("cpu")).otherwise(F.raise_error(F.col("fault")).cast("long")).alias("cpu"))


def sharded(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (id, place, ...) with the rank that holds them by a plan (id, rank, first, last)."""
    held = plan.where("last > first").select("id", "rank", F.explode(F.expr("sequence(first, last - 1)")).alias("place"))
    return rows.join(held, ["id", "place"])


def gathered(shards: DataFrame) -> DataFrame:
    """(id, values) of sharded rows (id, rank, place, value): each rank's part in order, then the parts in rank order."""
    parts = shards.groupBy("id", "rank").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("part"))
    whole = parts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "part"))).alias("parts"))
    return whole.select("id", F.flatten(F.transform("parts", lambda p: F.transform(p.part, lambda x: x.value))).alias("values"))
