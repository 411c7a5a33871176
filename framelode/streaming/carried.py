"""Windows that change frames and carry their overlap: keyed state with lists of frames.

A window loads its frames, changes them and commits them. What it commits beyond its stable end, the right overlap, is
held back: it stands in place of the raw frames when the next window loads, and is blended with what that window makes
of it. A scene's last window has no right overlap, so the list is empty where a new scene begins. A window without a
masked frame in its deal range is skipped: its frames pass as they came in, the overlap of the window before too.

The plan of windows is a table; each frame brings along the windows that it is the last frame of, by one join on
(clip, frame). State holds a clip's loaded frames that the next window still needs, so at most infer_len of them and
what has arrived ahead of a missing frame. A table's frames come in order, so there the state is the memory of one task. Frames may arrive in any order; one that windows load and that is behind its
clip's frontier, or arrives twice, raises. Frames that no window loads pass when they come, without state.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that transformWithState needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "clip long, frame long, pixels array<double>, window_index long, changed boolean"
PARTS = ("window_index", "load_start", "load_end", "deal_start", "deal_length", "overlap_left", "overlap_right", "next_start")
#: What a plan may say besides: whether a window is worked on (1, else 0), and the box that it changes of frames so wide.
BOX = ("live", "x1", "y1", "x2", "y2", "width")


def ramp_values(n: int, mode: str) -> np.ndarray:
    """functions.numbers.ramp for all places of an overlap of n frames."""
    name, _, share = mode.strip().lower().partition(":")
    t = np.arange(n) / max(n - 1, 1)
    if name == "before":
        return np.ones(n)
    if name == "after" or n <= 1:
        return np.zeros(n)
    if name == "value" and 0 <= float(share) <= 1:
        return np.full(n, float(share))
    if name not in ("linear", "cosine", "sigmoid"):
        raise ValueError(f"unknown overlap mode {mode!r}")
    return {"linear": 1 - t, "cosine": np.cos(t * (math.pi / 2)), "sigmoid": 1 / (1 + np.exp(12 * t - 6))}[name]


def with_windows(frames: DataFrame, plan: DataFrame) -> DataFrame:
    """frames (clip, frame, ...; a table or a stream) with loaded (some window loads the frame) and closes (the windows
    it is the last frame of). One equi-join: a window names its frames."""
    order = Window.partitionBy("clip").orderBy("window_index")
    told = plan if "live" in plan.columns else plan.withColumns({c: F.lit(None).cast("long") for c in BOX})
    whole = told.withColumn("next_start", F.lead("load_start").over(order)).select("clip", F.struct(*[F.col(c).cast("long").alias(c) for c in PARTS + BOX]).alias("w"))
    named = whole.where("w.load_end > w.load_start").withColumn("frame", F.explode(F.expr("sequence(w.load_start, w.load_end - 1)")))
    named = named.groupBy("clip", "frame").agg(F.collect_list(F.when(F.col("frame") == F.col("w.load_end") - 1, F.col("w"))).alias("closes"))
    return frames.join(named.withColumn("loaded", F.lit(True)), ["clip", "frame"], "left").withColumn("loaded", F.coalesce("loaded", F.lit(False)))


class Clip:
    """A clip's state: its frontier and next window, frames that windows still need, the overlap left, windows that wait."""

    def __init__(self, start: int = 0, window: int = 0):
        self.start, self.window, self.held, self.carried, self.open = start, window, {}, {}, {}


class Commit(StatefulProcessor):
    """Commits each window as its last missing frame arrives."""

    def __init__(self, edit: Callable, mode: str, whole: bool):
        self.edit, self.mode, self.whole = edit, mode, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frontier = handle.getValueState("frontier", "frame long, window long")
        self.held = handle.getListState("held", "frame long, pixels binary, masked boolean")
        self.carried = handle.getListState("carried", "frame long, pixels binary")
        self.open = handle.getListState("open", ", ".join(f"{c} long" for c in PARTS + BOX))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        clip = int(key[0])
        state = Clip(*(self.frontier.get() if self.frontier.exists() else (0, 0)))
        state.held = {f: (np.frombuffer(p, np.float64), m) for f, p, m in self.held.get()}
        state.carried = {f: np.frombuffer(p, np.float64) for f, p in self.carried.get()}
        state.open = {w[0]: dict(zip(PARTS + BOX, w, strict=True)) for w in self.open.get()}
        for part in rows:
            told = zip(part["frame"], part["pixels"], part["masked"], part["loaded"], part["closes"], strict=True)
            if out := self.advanced(clip, state, told):
                yield pd.DataFrame(out, columns=["clip", "frame", "pixels", "window_index", "changed"]).astype({"window_index": "Int64"})
        self.frontier.update((state.start, state.window))
        for kept, values in ((self.held, [(f, p.tobytes(), m) for f, (p, m) in state.held.items()]), (self.carried, [(f, p.tobytes()) for f, p in state.carried.items()]), (self.open, [tuple(w[c] for c in PARTS + BOX) for w in state.open.values()])):
            kept.put(values) if values else kept.clear()

    def advanced(self, clip: int, state: Clip, rows: Iterable) -> list[tuple]:
        """What rows (frame, pixels, masked, loaded, closes) of a clip let it commit; the state goes on."""
        out = []
        for frame, pixels, masked, loaded, closes in rows:
            frame, pixels = int(frame), np.asarray(pixels, np.float64)
            if not loaded:
                out.append((clip, frame, pixels, None, False))
                continue
            if frame < state.start or frame in state.held:
                raise ValueError(f"frame {frame} of clip {clip} is late or arrived twice")
            state.held[frame] = pixels, bool(masked)
            for w in closes if closes is not None else ():
                w = {c: None if pd.isna(w[c]) else int(w[c]) for c in PARTS + BOX}
                state.open[w["window_index"]] = w
        # a window needs the one before, which has left its overlap
        while (w := state.open.get(state.window)) and all(f in state.held for f in range(w["load_start"], w["load_end"])):
            made, state.carried, state.start = self._committed(w, state.held, state.carried)
            out += [(clip, *x) for x in made]
            del state.open[state.window]
            state.window += 1
            for f in [f for f in state.held if f < state.start]:
                del state.held[f]
        return out

    def _committed(self, w: dict, held: dict, carried: dict) -> tuple[list, dict, int]:
        """What a window gives out, carries and leaves behind: (frame, pixels, window_index, changed) of its stable range
        and of the frames before the next window, its right overlap, and the new frontier."""
        first, end = w["load_start"], w["deal_start"] + w["deal_length"]
        stable = end - w["overlap_right"]
        # behind the last window pass the frames that it has loaded beyond its scene
        start = w["next_start"] if w["next_start"] is not None else w["load_end"]
        passed = [(f, held[f][0], None, False) for f in range(end, start) if f in held]
        live = any(held[f][1] for f in range(w["deal_start"], end)) if w["live"] is None else w["live"] > 0
        if not live:
            made = [(f, held[f][0], w["window_index"], False) for f in range(first, stable)]
            return made + passed, {f: held[f][0] for f in range(stable, end)}, start
        left = w["overlap_left"]
        source = np.stack([carried.get(f, held[f][0]) if f < first + left else held[f][0] for f in range(first, w["load_end"])])
        changed = np.asarray(self.edit(source, w["window_index"]), np.float64)
        if changed.shape != source.shape:
            raise ValueError(f"an edit of {source.shape} gave {changed.shape}")
        changed = changed.copy()
        if w["x1"] is not None:  # only the box is taken over
            place = np.arange(source.shape[1])
            y, x = np.divmod(place, w["width"])
            outside = (y < w["y1"]) | (y >= w["y2"]) | (x < w["x1"]) | (x >= w["x2"])
            changed[:, outside] = source[:, outside]
        share = ramp_values(left, self.mode)[:, None]
        changed[:left] = share * source[:left] + (1 - share) * changed[:left]
        if self.whole:
            changed = np.rint(changed.clip(0, 255))
        made = [(f, changed[f - first], w["window_index"], True) for f in range(first, stable)]
        return made + passed, {f: changed[f - first] for f in range(stable, end)}, start

    def close(self) -> None:
        pass


def _table_of(out: list[tuple]) -> pa.RecordBatch:
    clip, frame, pixels, window, changed = zip(*out, strict=True)
    sizes = np.cumsum([0, *map(len, pixels)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(pixels)))
    return pa.RecordBatch.from_arrays([pa.array(clip, pa.int64()), pa.array(frame, pa.int64()), lists, pa.array(window, pa.int64()), pa.array(changed, pa.bool_())], ["clip", "frame", "pixels", "window_index", "changed"])


def _in_order(commit: Commit) -> Callable:
    """For mapInArrow: a table's rows in order of clip and frame. Only the clip at hand has a state, the task's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column("pixels")
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            clips = batch.column("clip").to_numpy()
            rows = list(zip(batch.column("frame").to_pylist(), (values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)), *(batch.column(c).to_pylist() for c in ("masked", "loaded", "closes")), strict=True))
            cuts, out = [0, *(np.flatnonzero(clips[1:] != clips[:-1]) + 1).tolist(), len(rows)], []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if at != clips[i]:
                    at, state = clips[i], Clip()
                out += commit.advanced(int(at), state, rows[i:j])
            if out:
                yield _table_of(out)

    return run


def carried_windows(frames: DataFrame, plan: DataFrame, edit: Callable, mode: str = "before", whole: bool = False) -> DataFrame:
    """(clip, frame, pixels, window_index, changed) of frames (clip, frame, pixels array<double>, masked), each once.

    frames is a stream or a table; plan is that of window_plan(). edit(pixels of a window's frames as an array of frames
    x pixels, window_index) gives as many; its first overlap_left frames are those that the window before has carried
    over, and come out as ramp(mode) * carried + (1 - ramp(mode)) * edited. whole: values are bytes, clipped to 0..255 and
    rounded half to even. window_index is null where a frame was in no window's commit range, changed false where it
    passed as it came. A plan with the columns of BOX says itself which windows are worked on, whatever masked is, and which
box of the pixels (row after row, width to a row) they change. A window waits for all its frames and for the windows before it; what a missing frame holds up
    stays in the state.
    """
    rows = with_windows(frames.select(F.col("clip").cast("long"), F.col("frame").cast("long"), F.col("pixels").cast("array<double>"), "masked"), plan)
    if not frames.isStreaming:  # no state outlives a table: its frames come in order
        dealt = rows.select("clip", "frame", "pixels", "masked", "loaded", "closes").repartition("clip").sortWithinPartitions("clip", "frame")
        return dealt.mapInArrow(_in_order(Commit(edit, mode, whole)), OUT)
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy("clip").transformWithStateInPandas(statefulProcessor=Commit(edit, mode, whole), outputStructType=OUT, outputMode="Append", timeMode="None")
