"""One ordered output from many tasks, as a Spark data source: format "frameblocks".

Writing has two phases. A task writes its frames behind each other into a data file, with an index of its runs (clip,
first frame, count, offset, size), under names of its own; nothing of it can be seen. When all tasks have ended, the
driver publishes one manifest that lists the parts in order of their first frame; a failed job removes its folder, and
what a lost attempt has left is removed with the publication. A task writes into the folder that its job has made, so one
that runs on when its job has been aborted leaves nothing. write_ordered() also checks between the phases that every
clip is there once, from frame 0 and without a gap: a Spark job over the indexes.

Parts are read in the manifest's order, so a clip larger than a task comes back in order without a sort. Paths are
opened with pyarrow.fs, which takes local paths and remote URIs; they must lie where driver and executors both reach.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, InputPartition, WriterCommitMessage

from framelode.sources.rawframes import opened

SCHEMA = "clip long, frame long, pixels binary"
INDEX = pa.schema([("clip", pa.int64()), ("first", pa.int64()), ("count", pa.int64()), ("offset", pa.int64()), ("size", pa.int64())])
#: Bytes that a reader or a copy holds at once, and frames that a reader gives at once.
CHUNK, ROWS = 8 << 20, 10_000


class Part(WriterCommitMessage):
    """A task's files and the first and last (clip, frame) in them; name is None for a task without rows."""

    def __init__(self, name=None, rows=0, low=None, high=None):
        self.name, self.rows, self.low, self.high = name, rows, low, high


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Buffer | None]:
    """Clips, frames, sizes of the pixels and their bytes behind each other; null pixels are empty."""
    clip, frame = batch.column("clip"), batch.column("frame")
    if clip.null_count or frame.null_count:
        raise ValueError("a frame without clip or number")
    pixels = batch.column("pixels").fill_null(b"").cast(pa.large_binary())
    ends = np.frombuffer(pixels.buffers()[1], np.int64)[pixels.offset :][: len(pixels) + 1]
    data = pixels.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])) if ends[-1] > ends[0] else None
    return clip.to_numpy(), frame.to_numpy(), np.diff(ends), data


def _check_order(clip: np.ndarray, frame: np.ndarray, last: tuple[int, int] | None) -> None:
    before = (np.r_[clip[0] if last is None else last[0], clip[:-1]], np.r_[frame[0] - 1 if last is None else last[1], frame[:-1]])
    wrong = np.flatnonzero((clip < before[0]) | (clip == before[0]) & (frame <= before[1]))
    if len(wrong):
        i = wrong[0]
        raise ValueError(f"frame {frame[i]} of clip {clip[i]} comes after frame {before[1][i]} of clip {before[0][i]}")


def _runs(clip: np.ndarray, frame: np.ndarray, at: int, sizes: np.ndarray) -> list[np.ndarray]:
    """The columns of INDEX for frames whose bytes follow each other from at on."""
    starts = np.r_[0, np.flatnonzero((clip[1:] != clip[:-1]) | (frame[1:] != frame[:-1] + 1) | (sizes[1:] != sizes[:-1])) + 1]
    return [clip[starts], frame[starts], np.diff(np.r_[starts, len(clip)]), at + np.r_[0, np.cumsum(sizes)][starts], sizes[starts]]


def _joined(runs: list[list[np.ndarray]]) -> pa.Table:
    """The runs of all batches; what a batch has cut is one run again."""
    clip, first, count, offset, size = (np.concatenate(c) for c in zip(*runs, strict=True))
    starts = np.r_[0, np.flatnonzero((clip[1:] != clip[:-1]) | (first[1:] != first[:-1] + count[:-1]) | (size[1:] != size[:-1])) + 1]
    return pa.table([clip[starts], first[starts], np.add.reduceat(count, starts), offset[starts], size[starts]], schema=INDEX)


class Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.staged = options.get("staged", "false").lower() == "true"
        self.job = options.get("job") or uuid.uuid4().hex
        files, root = opened(self.path)
        files.create_dir(f"{root}/_data/{self.job}", recursive=True)

    def write(self, iterator):
        files, root = opened(self.path)
        name, runs, out, at, rows, low, last = uuid.uuid4().hex, [], None, 0, 0, None, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    # the folder is the driver's: a task that outlives its job finds none, and leaves nothing
                    out = files.open_output_stream(f"{root}/_data/{self.job}/{name}.bin", compression=None)
                clip, frame, sizes, data = _columns(batch)
                _check_order(clip, frame, last)
                runs.append(_runs(clip, frame, at, sizes))
                if data is not None:
                    out.write(data)
                low = low or [int(clip[0]), int(frame[0])]
                at, rows, last = at + int(sizes.sum()), rows + len(clip), (int(clip[-1]), int(frame[-1]))
        finally:
            if out is not None:
                out.close()
        if not rows:
            return Part()
        with files.open_output_stream(f"{root}/_data/{self.job}/{name}.idx", compression=None) as f:
            pq.write_table(_joined(runs), f)
        return Part(name, rows, low, list(last))

    def commit(self, messages):
        files, root = opened(self.path)
        parts = sorted(({"job": self.job, "name": m.name, "rows": m.rows, "low": m.low, "high": m.high} for m in messages if m and m.name), key=lambda p: p["low"])
        kept = {f"{p['name']}.{k}" for p in parts for k in ("bin", "idx")}
        if parts:
            for f in files.get_file_info(fs.FileSelector(f"{root}/_data/{self.job}")):
                if f.base_name not in kept:
                    files.delete_file(f.path)
        else:
            files.delete_dir(f"{root}/_data/{self.job}")
        files.create_dir(f"{root}/_manifest", recursive=True)
        staged = f"{root}/_manifest/_{self.job}.json"
        with files.open_output_stream(staged, compression=None) as out:
            out.write(json.dumps({"overwrite": self.overwrite, "parts": parts}).encode())
        if not self.staged:
            publish(self.path, self.job)

    def abort(self, messages):
        withdraw(self.path, self.job)


def publish(path: str, job: str) -> None:
    """Makes a staged job's parts the ones that are read; an overwriting job's predecessors go after that."""
    files, root = opened(path)
    older = [f for f in _manifests(files, root)]
    files.move(f"{root}/_manifest/_{job}.json", f"{root}/_manifest/{job}.json")
    if _read(files, f"{root}/_manifest/{job}.json")["overwrite"]:
        for f in older:
            jobs = {p["job"] for p in _read(files, f)["parts"]}
            files.delete_file(f)
            for j in jobs - {job}:
                files.delete_dir(f"{root}/_data/{j}")


def withdraw(path: str, job: str) -> None:
    """Removes what a job has written and not published."""
    files, root = opened(path)
    if files.get_file_info(f"{root}/_manifest/_{job}.json").type == fs.FileType.File:
        files.delete_file(f"{root}/_manifest/_{job}.json")
    if files.get_file_info(f"{root}/_data/{job}").type == fs.FileType.Directory:
        files.delete_dir(f"{root}/_data/{job}")


def _manifests(files, root: str, staged: str | None = None) -> list[str]:
    if staged:
        return [f"{root}/_manifest/_{staged}.json"]
    found = files.get_file_info(fs.FileSelector(f"{root}/_manifest", allow_not_found=True))
    return [f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith("_")]


def _read(files, name: str) -> dict:
    with files.open_input_stream(name, compression=None) as f:
        return json.loads(f.read())


def parts(path: str, staged: str | None = None) -> list[dict]:
    """The parts of all published manifests (or of one staged job) in order of their first frame; a part is a task."""
    files, root = opened(path)
    return sorted((p for m in _manifests(files, root, staged) for p in _read(files, m)["parts"]), key=lambda p: p["low"])


class Run(InputPartition):
    def __init__(self, job: str, name: str):
        self.job, self.name = job, name


class Reader(DataSourceReader):
    """A partition for each part; a filter on clip leaves parts out whose range doesn't hold it."""

    def __init__(self, options):
        self.path, self.clip = options["path"], None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and tuple(f.attribute) == ("clip",):
                self.clip = f.value
            yield f  # Spark filters the rows of the parts that are left

    def partitions(self):
        found = [p for p in parts(self.path) if self.clip is None or p["low"][0] <= self.clip <= p["high"][0]]
        return [Run(p["job"], p["name"]) for p in found] or [Run("", "")]

    def read(self, part: Run):
        if not part.name:
            return
        files, root = opened(self.path)
        stem = f"{root}/_data/{part.job}/{part.name}"
        clip, first, count, offset, size = (c.to_numpy() for c in read_index(files, f"{stem}.idx").columns)
        if self.clip is not None:  # a clip's runs follow each other
            own = clip == self.clip
            clip, first, count, offset, size = (c[own] for c in (clip, first, count, offset, size))
        before = np.r_[0, np.cumsum(count)]
        with files.open_input_file(f"{stem}.bin") as f:
            row = 0
            while row < before[-1]:
                # as many frames of one run or of many as ROWS and CHUNK let pass, one at least
                a, b = np.searchsorted(before, [row, min(row + ROWS, before[-1]) - 1], "right") - 1
                rows = np.minimum(before[a + 1 : b + 2], row + ROWS) - np.maximum(before[a : b + 1], row)
                ends = np.r_[0, np.cumsum(np.repeat(size[a : b + 1], rows))]
                n = max(1, int(np.searchsorted(ends, CHUNK, "right")) - 1)
                f.seek(int(offset[a] + (row - before[a]) * size[a]))
                raw = f.read_buffer(int(ends[n]))
                if raw.size != ends[n]:
                    raise ValueError(f"{stem}.bin ends inside clip {clip[a]}")
                frames = np.arange(row, row + n) + np.repeat(first[a : b + 1] - before[a : b + 1], rows)[:n]
                pixels = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends[: n + 1].astype(np.int32)), raw])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(clip[a : b + 1], rows)[:n]), pa.array(frames), pixels], ["clip", "frame", "pixels"])
                row += n


def read_index(files, name: str) -> pa.Table:
    with files.open_input_file(name) as f:
        return pq.read_table(f, schema=INDEX)


class FrameBlocks(DataSource):
    @classmethod
    def name(cls):
        return "frameblocks"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameBlocks)


def index(spark: SparkSession, path: str, staged: str | None = None) -> DataFrame:
    """(place, clip, first, count, offset, size, job, name): every run of every part, place: the part's number."""
    found = [(i, p["job"], p["name"]) for i, p in enumerate(parts(path, staged))]

    def runs(batches):
        files, root = opened(path)
        for batch in batches:
            for place, job, name in zip(*(batch.column(c).to_pylist() for c in ("place", "job", "name")), strict=True):
                t = read_index(files, f"{root}/_data/{job}/{name}.idx")
                n = t.num_rows
                yield from t.append_column("place", pa.array([place] * n, pa.int64())).append_column("job", pa.array([job] * n)).append_column("name", pa.array([name] * n)).to_batches()

    listed = spark.createDataFrame(found, "place long, job string, name string").repartition(max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism)))
    return listed.mapInArrow(runs, "clip long, first long, count long, offset long, size long, place long, job string, name string")


def faults(runs: DataFrame) -> DataFrame:
    """Runs that don't begin where their clip's run before has ended (its first at 0): (clip, expected, first)."""
    before = Window.partitionBy("clip").orderBy("first", "count")
    expected = F.coalesce(F.lag(F.col("first") + F.col("count")).over(before), F.lit(0).cast("long"))
    return runs.withColumn("expected", expected).where("expected <> first").select("clip", "expected", "first")


def write_ordered(frames: DataFrame, path: str, tasks: int, overwrite: bool = True) -> None:
    """Writes frames (clip, frame, pixels) as one ordered output, all or nothing.

    Frames are dealt by ranges of (clip, frame), so a clip of any size is spread over tasks. Each clip must have frames 0
    to n - 1 once; else it raises, and what was there before stays. Null clips and frames raise; null pixels are empty.
    """
    spark = frames.sparkSession
    register(spark)
    bad = F.raise_error(F.lit("a frame without clip or number"))
    rows = frames.select(F.coalesce(F.col("clip").cast("long"), bad.cast("long")).alias("clip"), F.coalesce(F.col("frame").cast("long"), bad.cast("long")).alias("frame"), F.col("pixels").cast("binary").alias("pixels"))
    job = uuid.uuid4().hex
    dealt = rows.repartitionByRange(tasks, "clip", "frame").sortWithinPartitions("clip", "frame")
    dealt.write.format("frameblocks").option("staged", "true").option("job", job).mode("overwrite" if overwrite else "append").save(path)
    runs = index(spark, path, job)
    runs = runs if overwrite else runs.unionByName(index(spark, path))
    wrong = faults(runs).orderBy("clip", "first").limit(3).collect()
    if wrong:
        withdraw(path, job)
        raise ValueError("; ".join(f"clip {w.clip} has frame {w.first} where {w.expected} was due" for w in wrong))
    publish(path, job)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """(clip, frame, pixels); partitions follow each other in order of (clip, frame)."""
    register(spark)
    return spark.read.format("frameblocks").load(path)


def composed(spark: SparkSession, path: str, out: str) -> DataFrame:
    """One file for each clip, out/<clip>.raw, copied from the parts in order: (clip, frames, bytes).

    A clip is copied by one task, CHUNK bytes at a time; a group holds a clip's runs, which are as many as its parts.
    """

    def copy(key: tuple[pa.Scalar, ...], runs: pa.Table) -> pa.Table:
        source, root = opened(path)
        target, folder = opened(out)
        target.create_dir(folder, recursive=True)
        rows, clip = runs.sort_by("first").to_pylist(), key[0].as_py()
        draft = f"{folder}/_{clip}-{uuid.uuid4().hex}"
        with target.open_output_stream(draft, compression=None) as to:
            for r in rows:
                with source.open_input_file(f"{root}/_data/{r['job']}/{r['name']}.bin") as f:
                    f.seek(r["offset"])
                    left = r["count"] * r["size"]
                    while left:
                        raw = f.read(min(left, CHUNK))
                        if not raw:
                            raise ValueError(f"{r['name']} ends inside clip {clip}")
                        to.write(raw)
                        left -= len(raw)
        target.move(draft, f"{folder}/{clip}.raw")
        return pa.table({"clip": [clip], "frames": [sum(r["count"] for r in rows)], "bytes": [sum(r["count"] * r["size"] for r in rows)]})

    return index(spark, path).groupBy("clip").applyInArrow(copy, "clip long, frames long, bytes long")
