"""Structured Streaming twins of batch operators over ordered frames: windows that fire, tasks that change state.

State is a few numbers for each clip or task. Frames of a clip must arrive in order from batch to batch; inside a
batch they are sorted. A frame behind what its clip has seen is late, which raises and is never dropped in silence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelode.operators.tasks import TRANSITIONS

ALLOWED = [f"{a}>{b}" for a, b in TRANSITIONS]


def fired_windows(frames: DataFrame, infer_len: int, overlap: int) -> DataFrame:
    """(clip, window_index, load_start, load_end, stable_start, stable_end) of windows as their last frame arrives.

    frames: a stream of clip and ts, one row a frame, and perhaps num_frames, the length of the clip. With it load_end is
    cut to the clip's end, so a clip's last window fires with the clip's last frame and keeps nothing back: the windows
    are those of window_plan(). A frame beyond num_frames raises. Without it, or where it is null, no window is known to
    be the last, and a tail shorter than a window stays in the state.
    """
    step = infer_len - overlap
    rows = frames if "num_frames" in frames.columns else frames.withColumn("num_frames", F.lit(None).cast("long"))

    def fire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, done, last = state.get if state.exists else (0, 0, None)
        first, until, length = None, last, None
        for b in batches:  # a hot clip's batch comes in parts
            if len(b):
                seen += len(b)
                low, high = b["ts"].min().value, b["ts"].max().value
                first = low if first is None else min(first, low)
                until = high if until is None else max(until, high)
                length = b["num_frames"].max() if b["num_frames"].notna().any() else length
        if last is not None and first is not None and first < last:
            raise ValueError(f"late frame of clip {key[0]}")
        if length is not None and seen > length:
            raise ValueError(f"clip {key[0]} has more than {length} frames")
        fired = []
        while True:
            start = done * step
            end = start + infer_len if length is None else min(start + infer_len, int(length))
            # behind the first window, one that has no new frame isn't there
            if end > seen or end <= start + (overlap if done else 0):
                break
            fired.append((key[0], done, start, end, start, end if end == length else end - overlap))
            done += 1
        state.update((seen, done, until))
        yield pd.DataFrame(fired, columns=["clip", "window_index", "load_start", "load_end", "stable_start", "stable_end"])

    return rows.groupBy("clip").applyInPandasWithState(fire, "clip long, window_index long, load_start long, load_end long, stable_start long, stable_end long", "seen long, done long, last long", "append", GroupStateTimeout.NoTimeout)


def task_states(changes: DataFrame) -> DataFrame:
    """(clip, steps, bad_steps, last_status) of tasks after each batch of changes (clip, ts, event_id, status)."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, bad, status = state.get if state.exists else (0, 0, "queued")
        new = pd.concat(list(batches)).sort_values(["ts", "event_id"])["status"]
        bad += int((~(new.shift(fill_value=status) + ">" + new).isin(ALLOWED)).sum())
        status, steps = new.iloc[-1], steps + len(new)
        state.update((steps, bad, status))
        yield pd.DataFrame([(key[0], steps, bad, status)], columns=["clip", "steps", "bad_steps", "last_status"])

    return changes.groupBy("clip").applyInPandasWithState(follow, "clip long, steps long, bad_steps long, last_status string", "steps long, bad long, status string", "update", GroupStateTimeout.NoTimeout)


def daily_sums(events: DataFrame, delay: str) -> DataFrame:
    """(day, kind, n, value): tumbling days by event time behind a watermark of delay."""
    days = F.window("ts", "1 day")
    return events.withWatermark("ts", delay).groupBy(days.alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("day"), "kind", "n", "value")


def collected(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now and returns the rows it gave, batch by batch, from Parquet in folder.

    A batch writes its own subfolder, overwriting, so a repeated batch gives the same rows.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/b={number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("b")
