"""Tracks, task lists and reports from CSV, JSON and log text, by Spark's own readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "array<double>"


def corners(box: Column) -> Column:
    """[x, y, w, h] as a struct of whole x1, y1, x2, y2."""
    at = lambda i: F.get(box, F.lit(i))
    return F.struct(at(0).cast("long").alias("x1"), at(1).cast("long").alias("y1"), (at(0) + at(2)).cast("long").alias("x2"), (at(1) + at(3)).cast("long").alias("y2"))


def csv_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(object, frame, x1, y1, x2, y2) from a CSV with frame and bboxes ([[x, y, w, h], ...]) or x, y, w, h columns.

    A frame with another number of objects than frame 0 raises when it is read.
    """
    rows = spark.read.csv(path, header=True, escape='"')
    if "bboxes" in rows.columns:
        boxes = rows.select(F.col("frame").cast("long").alias("frame"), F.from_json("bboxes", f"array<{BOX}>").alias("boxes"))
        # one row, whether there is a frame 0, several of it, or none
        count = boxes.where("frame = 0").agg(F.min(F.size("boxes")).alias("objects"), F.max(F.size("boxes")).alias("most"))
        checked = boxes.join(F.broadcast(count), F.expr("true"), "left").withColumn("boxes", F.expr("CASE WHEN objects IS NULL OR size(boxes) = objects AND objects = most THEN boxes ELSE raise_error(concat('frame ', frame, ' has another number of objects')) END"))
        out = checked.select("frame", F.posexplode("boxes").alias("object", "box"))
    else:
        out = rows.select(F.col("frame").cast("long").alias("frame"), F.lit(0).alias("object"), F.array(*[F.col(c).cast("double") for c in ("x", "y", "w", "h")]).alias("box"))
    return out.select("object", "frame", corners(F.col("box")).alias("c")).select("object", "frame", "c.*")


def finished_tracks(tracks: DataFrame, num_frames: int) -> DataFrame:
    """Tracks with a box for each of num_frames frames: gaps and the end take the last box before; zeros if there is none."""
    from pyspark.sql import Window

    every = tracks.select("object").distinct().withColumn("frame", F.explode(F.expr(f"sequence(0L, {num_frames - 1}L)")))
    past = Window.partitionBy("object").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    joined = every.join(tracks.where(F.col("frame") < num_frames), ["object", "frame"], "left")
    return joined.select("object", "frame", *[F.coalesce(F.last(c, ignorenulls=True).over(past), F.lit(0)).alias(c) for c in ("x1", "y1", "x2", "y2")])


def tasks_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of tasks with an explicit schema; what doesn't fit it raises."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def report_tail(spark: SparkSession, path: str, schema: str, separator: str | None = None) -> DataFrame:
    """The last report, an object that starts with "tasks", from each mixed log: (path, report).

    A log is a file. separator: a file holds many logs, each of which ends with it, and Spark splits files between them.
    """
    read = spark.read.text(path, wholetext=True) if separator is None else spark.read.text(path, lineSep=separator)
    logs = read.select(F.input_file_name().alias("path"), "value")
    mark = '{\n  "tasks"'
    tail = F.concat(F.lit(mark), F.substring_index("value", mark, -1))
    return logs.where(F.instr("value", mark) > 0).select("path", F.from_json(tail, schema).alias("report"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def pack_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of files that lie in packs: Parquet files of (name, content), a row for each, whatever bytes it holds."""
    return spark.read.schema("name string, content binary").parquet(path).select("name", F.sha2("content", 256).alias("sha256"))


def overlaid(base: DataFrame, patch: DataFrame) -> DataFrame:
    """Frames (clip, frame, value) with those that patch has taken from there: commits over a source."""
    over = patch.select("clip", "frame", F.col("value").alias("_new"))
    return base.join(over, ["clip", "frame"], "left").withColumn("value", F.coalesce("_new", "value")).drop("_new")


def encoder_arguments(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with arguments: -name value for each of the columns that isn't null, in order."""
    pairs = [F.when(F.col(n).isNotNull(), F.array(F.lit(f"-{n}"), F.col(n).cast("string"))) for n in names]
    return rows.withColumn("arguments", F.flatten(F.filter(F.array(*pairs), lambda p: p.isNotNull())))
