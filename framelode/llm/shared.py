"""The folder that driver and executors share, and joins that a hot key can't skew."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that attach() broadcasts, whatever the size of the data, and the rows that each of them has more of.
HEAVY_KEYS, HEAVY_ROWS = 1000, 100
#: Rows that in_tasks() gives a task, and the tasks that it leaves at least.
TASK_ROWS, LEAST_TASKS = 10_000, 32
#: Folders that written() has made and nobody has released.
_held: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under a local folder on one machine and an error on
    a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="framelode-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession, name)
    _held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df in as many tasks as so many rows ask for, never in more than it has: rounds on few rows write a file for each
    task. Shuffles before it are dealt over as many partitions as ever, and neighbours are read one after the other."""
    return df.coalesce(max(LEAST_TASKS, ceil(rows / TASK_ROWS)))


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that written() has made inside: what was made of them must be stored by then."""
    before = len(_held)
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _held[before:]:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        del _held[before:]


def attach(rows: DataFrame, facts: DataFrame, key: str, count: str, spread: str) -> DataFrame:
    """rows left-joined with facts (one row a key, count: the key's rows), even if a key holds a third of all rows.

    The HEAVY_KEYS most frequent keys of more than HEAVY_ROWS rows are broadcast: a bound that doesn't grow, and nothing
    where no key is frequent. Rows they answer are dealt by the column spread, the others by their key, of which none can
    have more than 1 / HEAVY_KEYS of the rows or HEAVY_ROWS. The others are always merged: the driver builds a table of
    pages for each broadcast, however small, and callers come here in every round.
    """
    names = [c for c in facts.columns if c not in (key, count)]
    top = F.broadcast(facts.where(F.col(count) > HEAVY_ROWS).orderBy(F.desc(count), key).limit(HEAVY_KEYS).select(F.col(key).alias("_top"), F.struct(*names).alias("_near")))
    dealt = rows.join(top, F.col(key) == F.col("_top"), "left").withColumn("_key", F.when(F.col("_top").isNull(), F.struct(F.col(key).alias("k"), F.lit(0).cast("long").alias("s"))).otherwise(F.struct(F.lit(None).cast(dict(rows.dtypes)[key]).alias("k"), F.xxhash64(spread).alias("s"))))
    far = facts.select(F.struct(F.col(key).alias("k"), F.lit(0).cast("long").alias("s")).alias("_key"), F.struct(*names).alias("_far"))
    return dealt.join(far.hint("merge"), "_key", "left").withColumn("_all", F.coalesce("_near", "_far")).select(*rows.columns, *[F.col(f"_all.{c}").alias(c) for c in names])
