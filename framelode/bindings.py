"""How tables of rows play the parts of clips, frames, masks, boxes, tasks and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, frame, value, kind, ts: each user's events in time order are the frames of a clip."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    return rows.select(F.col("user_id").alias("clip"), (F.row_number().over(order) - 1).cast("long").alias("frame"), "value", F.col("event_type").alias("kind"), "ts")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, num_frames, by partial counts: no frame is ordered for it."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("clip")).agg(F.count("*").alias("num_frames"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and the embedding in double precision."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, status, created_at (epoch seconds), price: orders as service tasks."""
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), status.alias("status"), F.unix_timestamp("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("owner"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object (the order), frame (the line), x, y, w, h."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("object"), F.col("l_linenumber").cast("long").alias("frame"), F.col("l_linenumber").cast("long").alias("x"), F.expr("l_suppkey % 200").alias("y"), F.col("l_quantity").cast("long").alias("w"), F.expr("CAST(l_quantity AS BIGINT) * l_linenumber % 97").cast("long").alias("h"))


#: The same bindings in DuckDB, to stand in a WITH clause.
SQL = {
    "frames": "frames AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, event_type AS kind, ts FROM events)",
    "clips": "clips AS (SELECT user_id AS clip, count(*) AS num_frames FROM events GROUP BY user_id)",
    "vectors": "vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
    "tasks": "tasks AS (SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, CAST(epoch(o_orderdate) AS BIGINT) AS created_at, o_totalprice AS price, o_custkey AS owner FROM orders)",
    "boxes": "boxes AS (SELECT l_orderkey AS object, CAST(l_linenumber AS BIGINT) AS frame, CAST(l_linenumber AS BIGINT) AS x, l_suppkey % 200 AS y, CAST(trunc(l_quantity) AS BIGINT) AS w, CAST(trunc(l_quantity) AS BIGINT) * l_linenumber % 97 AS h FROM lineitem)",
}


def with_sql(query: str, *names: str) -> str:
    """A DuckDB query over some of the bindings."""
    return f"WITH {', '.join(SQL[n] for n in names)} {query}"
