"""Service tasks: pages, queues, expiry, progress and states. A task is (task_id, status, created_at, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ["queued", "running", "completed", "failed", "cancelled"]
TERMINAL = ["completed", "failed", "cancelled"]
#: From status to status.
TRANSITIONS = [("queued", "running"), ("queued", "cancelled"), ("running", "completed"), ("running", "failed"), ("running", "cancelled")]


def page(tasks: DataFrame, limit: int, after: tuple | None = None, ascending: bool = True) -> DataFrame:
    """limit tasks in order of (created_at, task_id), behind the cursor after, with has_more on each row."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be in 1..100")
    keys = ["created_at", "task_id"]
    if after is not None:
        at, name = (F.lit(v) for v in after)
        behind = (F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("task_id") > name))
        before = (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("task_id") < name))
        tasks = tasks.where(behind if ascending else before)
    order = [F.asc(k) if ascending else F.desc(k) for k in keys]
    # limit + 1 rows at most from here on
    top = tasks.orderBy(*order).limit(limit + 1)
    number = F.row_number().over(Window.orderBy(*order))
    seen = top.withColumn("place", number).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
    return seen.where(F.col("place") <= limit)


def queue_positions(tasks: DataFrame, by: str) -> DataFrame:
    """(task_id, position): places of queued tasks, from 0, in each queue by."""
    order = Window.partitionBy(by).orderBy("created_at", "task_id")
    return tasks.where("status = 'queued'").select(by, "task_id", (F.row_number().over(order) - 1).cast("long").alias("position"))


def expired(tasks: DataFrame, now: int, ttl: int, keep: int, by: str) -> DataFrame:
    """Terminal tasks to purge: older than ttl, or behind the keep latest of their owner by."""
    ended = tasks.where(F.col("status").isin(TERMINAL))
    number = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("task_id")))
    reason = F.when(F.col("created_at") + ttl <= now, "ttl").when(F.col("number") > keep, "overflow")
    return ended.withColumn("number", number).withColumn("reason", reason).where("reason IS NOT NULL").select(by, "task_id", "reason")


def latest_completed(tasks: DataFrame, by: str) -> DataFrame:
    """(by, task_id, price) of the latest completed task of each owner, ties to the larger id."""
    last = F.max(F.struct("created_at", "task_id", "price"))
    return tasks.where("status = 'completed'").groupBy(by).agg(last.alias("last")).select(by, "last.task_id", "last.price")


def progress(events: DataFrame) -> DataFrame:
    """events (clip, frame, value) with progress: the running maximum of value cut to 0..99."""
    past = Window.partitionBy("clip").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("progress", F.max(F.least(F.greatest(F.floor("value"), F.lit(0)), F.lit(99))).over(past))


def pipeline_progress(completed: Column, total: Column) -> Column:
    """5 at the start, 94 at the end."""
    return F.least(F.lit(94), 5 + F.floor(F.lit(89) * completed / total))


def public(tasks: DataFrame) -> DataFrame:
    """What a client may see: the content path only of completed tasks."""
    path = F.when(F.col("status") == "completed", F.concat(F.lit("/v1/videos/"), F.col("task_id"), F.lit("/content")))
    return tasks.select("task_id", "status", F.col("created_at").cast("long").alias("created_at"), path.alias("content_url"), F.col("status").isin(TERMINAL).alias("ended"))


def valid_history(changes: DataFrame) -> DataFrame:
    """Per task of changes (clip, frame, status): last status if each step is allowed, and the number of bad steps."""
    spark = changes.sparkSession
    allowed = F.broadcast(spark.createDataFrame(TRANSITIONS, "before string, status string").withColumn("fine", F.lit(True)))
    order = Window.partitionBy("clip").orderBy("frame")
    steps = changes.withColumn("before", F.coalesce(F.lag("status").over(order), F.lit("queued")))
    judged = steps.join(allowed, ["before", "status"], "left")
    return judged.groupBy("clip").agg(F.count("*").alias("steps"), F.count_if(F.col("fine").isNull()).alias("bad_steps"), F.max(F.struct("frame", "status")).alias("last")).select("clip", "steps", "bad_steps", F.col("last.status").alias("last_status"))


def upserted(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The latest row of each key of changes (keys, seq, ...): a history of updates as the table they leave."""
    names = [c for c in changes.columns if c not in keys]
    last = F.max(F.struct("seq", *[n for n in names if n != "seq"])).alias("last")
    return changes.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{n}").alias(n) for n in names])


def recorded(events: DataFrame, payload: list[str]) -> DataFrame:
    """Events (seq, event, ids, ...) with the payload columns as one JSON object; null ones are left out."""
    held = [c for c in events.columns if c not in payload]
    return events.select(*held, F.to_json(F.struct(*payload)).alias("payload"))


def defaulted(rows: DataFrame, defaults: dict) -> DataFrame:
    """rows with each null replaced by the default of its column."""
    return rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})
