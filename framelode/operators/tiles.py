"""Work on overlapping tiles whose results are blended, in order, over their seams.

An image is rows of pixels, a clip frames. Each row goes to the tiles that hold it, a task works on one tile, and the
result's first places along an axis are mixed with the last ones of the tile before, which by then has been mixed with
its own neighbours: down first, then to the right. What a tile takes from one that is d tiles before lies d strides or
more behind that one's start, so only the tiles up to ceil(extent / stride) before it matter, and of those only that
rest. It is what tiles of an image send; a task mixes a tile's neighbourhood in order and returns the tile's own part.
Tiles of time are many and small: a task works on a run of them, and on those again that reach into it, so that nothing
is sent. There is no order between tasks, and no image or clip is ever in one row or task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tiles of time that a task works on one after the other, for each that it works on twice and one more.
RUN = 64


def mixed(before: np.ndarray, tile: np.ndarray, extent: int, axis: int) -> np.ndarray:
    """tile with its first places along an axis mixed with the last ones of before; place 0 is all before's."""
    n = min(extent, before.shape[axis], tile.shape[axis])
    if not n:
        return tile
    share = (np.arange(n) / n).reshape([-1 if a == axis else 1 for a in range(tile.ndim)])
    out = tile.copy()
    head = [slice(None)] * tile.ndim
    tail = head.copy()
    head[axis], tail[axis] = slice(0, n), slice(before.shape[axis] - n, None)
    out[tuple(head)] = before[tuple(tail)] * (1 - share) + tile[tuple(head)] * share
    return out


def _first(at: str, tile: int, stride: int) -> str:
    """SQL for the number of the first tile that holds a place."""
    return f"greatest((CAST({at} AS bigint) - {tile}) div {stride} + IF({at} >= {tile}, 1, 0), 0L)"


def _holding(at: str, tile: int, stride: int) -> str:
    """SQL for the numbers of the tiles that hold a place."""
    return f"sequence({_first(at, tile, stride)}, CAST({at} AS bigint) div {stride})"


def _whole(n: Fraction) -> int:
    if n.denominator != 1:
        raise ValueError("tiles and strides must be whole on both sides of the scale")
    return int(n)


def _neighbourhood(rows: list[dict], own: tuple, extents: tuple, axes: int) -> np.ndarray | None:
    """The own tile of a neighbourhood, mixed in order; rows: place, shape, offset and values of what was sent."""
    raw = {}
    for r in rows:
        tile = np.zeros(r["shape"])
        part = np.frombuffer(r["values"], np.float64)
        tile[tuple(slice(o, None) for o in r["offset"])] = part.reshape([max(n - o, 0) for n, o in zip(r["shape"], r["offset"], strict=True)])
        raw[tuple(r["place"])] = tile
    if own not in raw:
        return None
    done = {}
    for place in sorted(raw):
        tile = raw[place]
        for axis in range(axes):
            before = tuple(p - (a == axis) for a, p in enumerate(place))
            if before in done:
                tile = mixed(done[before], tile, extents[axis], axis)
        done[place] = tile
    return done[own]


SENT = "place array<int>, shape array<int>, offset array<int>, values binary"


def _sent(key: dict, place: tuple, out: np.ndarray, strides: tuple, reach: tuple, axes: int) -> list[dict]:
    """A tile's result for itself and, cut to what they need, for the tiles behind it."""
    rows = []
    for step in np.ndindex(*[r + 1 for r in reach]):
        offset = [s * n for s, n in zip(step, strides, strict=True)] + [0] * (out.ndim - axes)
        if all(o < n or not any(step) for o, n in zip(offset, out.shape, strict=True)):
            rest = np.ascontiguousarray(out[tuple(slice(o, None) for o in offset)])
            rows.append({**key, **{f"to{a}": place[a] + step[a] for a in range(axes)}, "place": list(place), "shape": list(out.shape), "offset": offset, "values": rest.tobytes()})
    return rows


def tiled(rows: DataFrame, work: Callable, tile: tuple[int, int], stride: tuple[int, int], scale: Fraction = Fraction(1)) -> DataFrame:
    """(id, y, x, pixels): images (id, y, pixels: an array of numbers, one row for each y from 0 on) worked on in tiles.

    work(tile as an array height x width) returns one scale times as large (cut tiles at the lower and right end rounded
    down). Tiles begin at multiples of stride; x is the first place of a piece of a row. The seams are tile - stride wide,
    times scale; where a tile is cut, what it has. Rows of one image of different lengths, or a missing row, raise.
    """
    if any(not 0 < s <= t for s, t in zip(stride, tile, strict=True)):
        raise ValueError("a stride must be in (0, tile]")
    strides, sizes = (tuple(_whole(n * scale) for n in x) for x in (stride, tile))
    extents = tuple(t - s for t, s in zip(sizes, strides, strict=True))
    reach = tuple(-(-e // s) for e, s in zip(extents, strides, strict=True))
    kind = dict(rows.dtypes)["id"]
    wide = F.col("pixels").cast("array<double>")
    down = rows.select("id", F.col("y").cast("long").alias("y"), wide.alias("pixels")).withColumn("i", F.explode(F.expr(_holding("y", tile[0], stride[0]))))
    across = down.where("size(pixels) > 0").withColumn("j", F.explode(F.expr(f"sequence(0L, (size(pixels) - 1) div {stride[1]})")))
    pieces = across.select("id", "i", "j", "y", F.size("pixels").alias("width"), F.slice("pixels", (F.col("j") * stride[1] + 1).cast("int"), F.lit(tile[1])).alias("pixels"))
    schema = pa.schema([("id", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), ("to0", pa.int64()), ("to1", pa.int64()), ("place", pa.list_(pa.int32())), ("shape", pa.list_(pa.int32())), ("offset", pa.list_(pa.int32())), ("values", pa.binary())])

    def apply(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        image, i, j = (k.as_py() for k in key)
        held = held.sort_by("y")
        y = held.column("y").to_numpy()
        if len(np.unique(held.column("width").to_numpy())) != 1 or (y != i * stride[0] + np.arange(len(y))).any():
            raise ValueError(f"image {image} has a missing row, one twice, or rows of different lengths")
        source = held.column("pixels").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        height, width = (int(n * scale) for n in source.shape)
        out = np.asarray(work(source), np.float64)[:height, :width]
        if out.shape != (height, width):
            raise ValueError(f"a tile of {source.shape} gave {out.shape}")
        return pa.Table.from_pylist(_sent({"id": image}, (i, j), out, strides, reach, 2), schema)

    def mix(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        image, i, j = (k.as_py() for k in key)
        out = _neighbourhood(held.to_pylist(), (i, j), extents, 2)
        if out is None:
            return pa.table({"id": pa.array([], schema.field("id").type), "y": pa.array([], pa.int64()), "x": pa.array([], pa.int64()), "pixels": pa.array([], pa.list_(pa.float64()))})
        own = out[: strides[0], : strides[1]]
        return pa.table({"id": pa.array([image] * len(own), schema.field("id").type), "y": i * strides[0] + np.arange(len(own)), "x": [j * strides[1]] * len(own), "pixels": pa.array(list(own), pa.list_(pa.float64()))})

    made = pieces.groupBy("id", "i", "j").applyInArrow(apply, f"id {kind}, to0 long, to1 long, {SENT}")
    return made.groupBy("id", "to0", "to1").applyInArrow(mix, f"id {kind}, y long, x long, pixels array<double>").where("size(pixels) > 0")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows (clip, part, frame, pixels) in order as (clip, part, frames, frames x pixels), cut where the part changes."""
    for batch in batches:
        if not len(batch):
            continue
        names = batch.column("clip").dictionary_encode()
        code, part, frame = names.indices.fill_null(-1).to_numpy(zero_copy_only=False), batch.column("part").to_numpy(), batch.column("frame").to_numpy()
        lists = batch.column("pixels")
        if lists.null_count:
            raise ValueError("a frame of a tile has no pixels")
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        wide = np.diff(ends)
        cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(batch)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if (wide[i:j] != wide[i]).any():
                raise ValueError("frames of a clip have different lengths")
            yield None if code[i] < 0 else names.dictionary[int(code[i])].as_py(), int(part[i]), frame[i:j], values[ends[i] : ends[j]].reshape(j - i, -1)
        yield None  # a batch has ended


def tiled_frames(frames: DataFrame, work: Callable, tile: int, stride: int, ratio: int) -> DataFrame:
    """(clip, frame, pixels): clips (clip, frame from 0 on, pixels) worked on in tiles of time, ratio frames to one.

    A tile takes tile + 1 frames from a multiple of stride on; work(frames x pixels) returns 1 + (n - 1) // ratio frames
    for n. Behind the first tile the first frame of a result goes, which the tile before has given. The seams are
    (tile - stride) / ratio frames. A clip is cut into parts of RUN tiles, and a task reads a part's frames in order; it
    works again on the tiles before the part that reach into it. Of a part it holds the frames of one tile and a batch.
    """
    if not 0 < stride <= tile or tile % ratio or stride % ratio:
        raise ValueError("a stride must be in (0, tile], and both multiples of ratio")
    step, extent = stride // ratio, (tile - stride) // ratio
    # a later tile's result begins one frame behind its start, so it lies step frames behind the one before
    reach = -(-extent // step)
    run = RUN * (1 + reach)
    kind = dict(frames.dtypes)["clip"]
    first, last = _first("frame", tile + 1, stride), f"CAST(frame AS bigint) div {stride}"
    parts = F.expr(f"sequence({first} div {run}, greatest({last} + {reach}, 0L) div {run})")
    placed = frames.select("clip", F.col("frame").cast("long").alias("frame"), F.col("pixels").cast("array<double>").alias("pixels")).withColumn("part", F.explode(parts))
    schema = pa.schema([("clip", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), ("frame", pa.int64()), ("pixels", pa.list_(pa.float64()))])

    class Part:
        """A part's frames that are still needed, the next tile and what the tile before became."""

        def __init__(self, clip, part: int):
            self.key, self.clip, self.own = (clip, part), clip, part * run
            self.tile = max(self.own - reach, 0)
            self.start, self.held, self.before = self.tile * stride, None, None

        def add(self, at: np.ndarray, pixels: np.ndarray) -> None:
            due = self.start + (0 if self.held is None else len(self.held))
            if (at != due + np.arange(len(at))).any() or self.held is not None and self.held.shape[1] != pixels.shape[1]:
                raise ValueError(f"clip {self.clip} has a missing frame, one twice, or frames of different lengths")
            self.held = pixels if self.held is None else np.concatenate([self.held, pixels])

        def made(self, ended: bool) -> Iterator[tuple]:
            """(clip, first frame, pixels) of the tiles whose frames are there; ended: no more will come."""
            used = 0
            while self.tile < self.own + run and (len(self.held) - used > tile or ended and len(self.held) > used):
                source = self.held[used : used + tile + 1]
                out = np.asarray(work(source), np.float64)
                if len(out) != 1 + (len(source) - 1) // ratio:
                    raise ValueError(f"a tile of {len(source)} frames gave {len(out)}")
                i, out = self.tile, out[1:] if self.tile else out
                self.before = out if self.before is None else mixed(self.before, out, extent, 0)
                if i >= self.own and len(out):
                    yield self.clip, i * step + (i > 0), self.before[: step + (i == 0)]
                used, self.tile = used + stride, i + 1
            # a copy, so that the batch can go
            self.start, self.held = self.start + min(used, len(self.held)), self.held[used:].copy()

    def table(made: list[tuple]) -> Iterator[pa.RecordBatch]:
        if made:
            sizes = [len(m[2]) for m in made]
            clips = pa.array([m[0] for m in made], schema.field("clip").type).take(pa.array(np.repeat(np.arange(len(made)), sizes)))
            at = np.concatenate([m[1] + np.arange(n) for m, n in zip(made, sizes, strict=True)])
            wide = np.repeat([m[2].shape[1] for m in made], sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(wide)].astype(np.int32)), pa.array(np.concatenate([m[2].ravel() for m in made])))
            yield pa.RecordBatch.from_arrays([clips, pa.array(at, pa.int64()), lists], schema=schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, made = None, []
        for piece in _pieces(batches):
            if piece is None:
                made += open_.made(False)
                yield from table(made)
                made = []
                continue
            if open_ is not None and open_.key != piece[:2]:
                made += open_.made(True)
                open_ = None
            open_ = open_ or Part(*piece[:2])
            open_.add(*piece[2:])
        if open_ is not None:
            yield from table([*open_.made(True)])

    dealt = placed.repartition("clip", "part").sortWithinPartitions("clip", "part", "frame")
    return dealt.mapInArrow(apply, f"clip {kind}, frame long, pixels array<double>")
