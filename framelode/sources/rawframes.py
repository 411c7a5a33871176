"""Raw frame files as a Spark data source: format "rawframes", one row for each frame.

A file holds frames of width x height x channels bytes behind each other. Byte ranges of whole frames are partitions,
so large files split; `channels_kept` reads one plane only. Writing gives a file for each clip and task, with the
frames of a task in order. Paths are opened with pyarrow.fs, which takes local paths and remote URIs.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "path string, frame_index int, height int, width int, channels int, pixels binary"
PARTITION_BYTES = 64 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if urlsplit(path).scheme else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.width, self.height, self.channels = (int(options.get(k, d)) for k, d in (("width", 0), ("height", 0), ("channels", 3)))
        self.kept = options.get("channels_kept")
        self.size = self.width * self.height * self.channels
        if self.size <= 0:
            raise ValueError("rawframes needs width, height and channels")

    def partitions(self):
        files, name = opened(self.path)
        info = files.get_file_info(name)
        found = [info] if info.type == fs.FileType.File else [f for f in files.get_file_info(fs.FileSelector(name, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        per = max(1, PARTITION_BYTES // self.size)
        out = []
        for f in found:
            if f.size % self.size:
                raise ValueError(f"{f.path} has {f.size} bytes, not a multiple of {self.size}")
            out += [Range(f.path, at, min(per, f.size // self.size - at)) for at in range(0, f.size // self.size, per)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range):
        if not part.count:
            return
        files, _ = opened(self.path)
        with files.open_input_file(part.path) as f:
            f.seek(part.first * self.size)
            for i in range(part.first, part.first + part.count):
                raw = f.read(self.size)
                if len(raw) != self.size:
                    raise ValueError(f"{part.path} ends inside frame {i}")
                if self.kept is not None:
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, self.channels)[:, int(self.kept)].tobytes()
                yield part.path, i, self.height, self.width, 1 if self.kept is not None else self.channels, raw


class Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Writer(DataSourceArrowWriter):
    """Each task writes files of its own, one after the other; those of a failed job are deleted.

    A task's rows come in order of (path, frame_index), as sortWithinPartitions leaves them; others raise. Nothing is held
    but a batch.
    """

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        files, name = opened(self.path)
        paths, out, last = [], None, None
        try:
            for batch in iterator:
                for clip, frame, raw in zip(*(batch.column(c).to_pylist() for c in ("path", "frame_index", "pixels")), strict=True):
                    clip = clip or "clip"
                    if last is not None and (clip, frame) <= last:
                        raise ValueError(f"frame {frame} of {clip} comes after frame {last[1]} of {last[0]}")
                    if last is None or clip != last[0]:
                        if out is not None:
                            out.close()
                        files.create_dir(name, recursive=True)
                        paths.append(f"{name}/{clip.rsplit('/', 1)[-1]}-{uuid.uuid4().hex}.raw")
                        out = files.open_output_stream(paths[-1], compression=None)
                    out.write(raw)
                    last = clip, frame
        except Exception:
            if out is not None:
                out.close()
            for p in paths:
                files.delete_file(p)
            raise
        if out is not None:
            out.close()
        return Written(paths)

    def abort(self, messages):
        files, _ = opened(self.path)
        for m in messages:
            for p in m.paths if m else []:
                files.delete_file(p)


class RawFrames(DataSource):
    @classmethod
    def name(cls):
        return "rawframes"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options)


def register(spark) -> None:
    spark.dataSource.register(RawFrames)
