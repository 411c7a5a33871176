"""When a cached result may stand for a computed one: order-dependent decisions, folded over each branch's steps.

A decision depends on those before it, so a branch is read in order. Branches are dealt by key and sorted inside their
partition; a task passes over the sorted rows with the state of one branch, a few numbers. No branch is gathered, so one
of any length takes time in proportion and no memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Branch:
    """What decides about a branch's next step: the step and layout before, the skips in a row and their summed rise."""

    def __init__(self):
        self.step = self.layout = None
        self.run, self.rise = 0, 0.0

    def forced(self, step: int, layout, last: int, early: int, end_guard: int, most_skips: int) -> str | None:
        """Why a step is computed whatever its distance, if it is."""
        if step < early:
            return "early"
        if step >= last + 1 - end_guard:
            return "late"
        if self.step is None:
            return "first"
        if None not in (self.layout, layout) and layout != self.layout:
            return "layout"
        if step != self.step + 1:
            return "gap"
        return "run" if self.run >= most_skips else None

    def took(self, step: int, layout, skipped: bool, rise: float) -> None:
        self.step, self.layout = step, layout
        self.run, self.rise = (self.run + 1, self.rise + rise) if skipped else (0, 0.0)


def _decided(probes: DataFrame, early: int, end_guard: int, most_skips: int, rise: Callable[[float], float], keeps: Callable[[float, float], bool]) -> DataFrame:
    """(branch, step, skip, reason): a step that nothing forces is skipped if keeps(summed rise before, its own rise)."""
    lasts = probes.groupBy("branch").agg(F.max("step").alias("last"))
    rows = probes.select("branch", "step", "distance", "layout").join(lasts, "branch").repartition("branch").sortWithinPartitions("branch", "step")
    kind = dict(probes.dtypes)["branch"]

    def fold(batches):
        name, state = object(), None
        for batch in batches:
            reasons = []
            for branch, step, distance, layout, last in zip(*(batch.column(c).to_pylist() for c in ("branch", "step", "distance", "layout", "last")), strict=True):
                if branch != name:
                    name, state = branch, Branch()
                reason = state.forced(step, layout, last, early, end_guard, most_skips)
                own = math.nan if distance is None else rise(distance)
                if reason is None:
                    reason = "skip" if keeps(state.rise, own) else "distance"
                state.took(step, layout, reason == "skip", own)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([batch.column("branch"), batch.column("step").cast(pa.int64()), pa.array([r == "skip" for r in reasons], pa.bool_()), pa.array(reasons, pa.string())], ["branch", "step", "skip", "reason"])

    return rows.mapInArrow(fold, f"branch {kind}, step long, skip boolean, reason string")


def accumulated(probes: DataFrame, threshold: float, coefficients: list[float], first_skip: int, end_guard: int, most_skips: int) -> DataFrame:
    """(branch, step, skip, reason) of probes (branch, step, distance, layout).

    A step is skipped while the sum of the polynomial of its distance and those of the skips before stays below the
    threshold. Computed anyway: steps before first_skip, the last end_guard ones, a branch's first, one after a change
    of layout or a gap, and one after most_skips skips in a row. Computing sets the sum to zero. A null or NaN distance
    is never below the threshold.
    """

    def rise(distance: float) -> float:
        out = 0.0
        for c in coefficients:
            out = out * distance + c
        return out

    return _decided(probes, first_skip, end_guard, most_skips, rise, lambda before, own: before + own < threshold)


def residual(probes: DataFrame, threshold: float, warmup: int, end_guard: int, most_skips: int) -> DataFrame:
    """(branch, step, skip, reason): skips while the distance itself is below the threshold; nothing accumulates.

    Computed anyway: warm-up and last steps, the first, one after a change of layout or a gap, and after most_skips
    skips in a row.
    """
    return _decided(probes, warmup, end_guard, most_skips, lambda distance: distance, lambda before, own: own < threshold)


def report(decisions: DataFrame) -> DataFrame:
    """Per branch: computed and skipped steps, hit rate and the speed-up that blocks could have."""
    sums = decisions.groupBy("branch").agg(F.count_if(~F.col("skip")).alias("computed"), F.count_if("skip").alias("skipped"))
    whole = F.col("computed") + F.col("skipped")
    return sums.withColumn("hit_rate", F.coalesce(F.try_divide("skipped", whole), F.lit(0.0))).withColumn("speedup", F.coalesce(F.try_divide(whole, F.col("computed")), F.lit(0.0)))


def leaders(reports: DataFrame, degree: int) -> DataFrame:
    """Sums over the first rank of every degree of reports (rank, grp, computed, skipped)."""
    kept = reports.where(F.col("rank") % degree == 0)
    sums = kept.groupBy("grp").agg(F.sum("computed").alias("computed"), F.sum("skipped").alias("skipped"))
    return sums.withColumn("hit_rate", F.col("skipped") / F.greatest(F.lit(1), F.col("computed") + F.col("skipped")))


def broadcast_steps(steps: DataFrame, between: tuple[float, float], every: int) -> DataFrame:
    """(branch, step, computed, value) of steps (branch, step from 0 on, t, value): between two time steps (both out) only
    every every-th step is computed, the others give the value computed last.

    The first step is always computed, so a step's last computed one is at most every - 1 before it or outside the range:
    one ordered pass over a branch, its rows as they are.
    """
    inside = (F.col("t") > between[0]) & (F.col("t") < between[1])
    computed = (F.col("step") % every == 0) | ~inside
    past = Window.partitionBy("branch").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.withColumn("computed", computed)
    return rows.select("branch", "step", "computed", F.last(F.when(F.col("computed"), F.col("value")), ignorenulls=True).over(past).alias("value"))
