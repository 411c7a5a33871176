"""Small cases with known answers, invariants of plans, and equal results under another partitioning."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelode.functions import arrays as ar
from framelode.functions import numbers as nb
from framelode.operators import masks, overlap, quality, reuse, statistics, tasks, tensors, timing
from framelode.plans import shards, windows
from framelode.streaming import frames as streams


def test_window_plan_of_145_frames(spark):
    clips = spark.createDataFrame([("c", 145)], "clip string, num_frames long")
    plan = windows.window_plan(windows.whole_clips(clips), 121, 9).orderBy("window_index").collect()
    assert len(plan) == 2 and plan[0].load_start == 0 and plan[-1].load_end == 145


@pytest.mark.parametrize(("infer_len", "overlap_len"), [(9, 0), (9, 1), (17, 8), (121, 9)])
def test_stable_ranges_partition_every_clip(spark, infer_len, overlap_len):
    clips = spark.range(1, 300).select(F.col("id").alias("clip"), F.col("id").alias("num_frames"))
    plan = windows.window_plan(windows.whole_clips(clips), infer_len, overlap_len)
    frames = windows.stable_ranges(plan).select("clip", F.explode(F.expr("sequence(stable_start, stable_end - 1)")).alias("f"))
    got = frames.groupBy("clip").agg(F.count("*").alias("n"), F.count_distinct("f").alias("d"), F.max("f").alias("m"))
    assert got.where("n <> clip OR d <> clip OR m <> clip - 1").count() == 0 and got.count() == 299


def test_scenes_are_cut_to_their_clip(spark):
    rows = [("a", 10, -3, 5), ("a", 10, 7, 100), ("a", 10, 20, 5), ("b", 4, None, 3), ("b", 4, 1, 0)]
    got = windows.normalized_scenes(spark.createDataFrame(rows, "clip string, num_frames long, start long, length long"))
    assert sorted((r.clip, r.scene_index, r.scene_start, r.scene_end) for r in got.collect()) == [("a", 0, 0, 5), ("a", 1, 7, 10), ("b", 0, 0, 4)]


def test_every_byte_against_thresholds(spark):
    values = spark.range(256).select(F.col("id").cast("double").alias("x"))
    for t in (-math.inf, -1.0, 0.0, 38.25, 127.5, 255.0, math.inf, math.nan):
        got = [r.m for r in values.select("x", masks.thresholded(F.col("x"), F.lit(t)).alias("m")).orderBy("x").collect()]
        assert got == [0 if x <= t else 255 for x in range(256)]


def test_ramps_end_where_they_should(spark):
    places = spark.range(5)
    weights = {m: [r[0] for r in places.orderBy("id").select(nb.ramp(F.col("id"), F.lit(5), m)).collect()] for m in ("before", "after", "linear", "cosine", "sigmoid", "value:0.3")}
    assert weights["before"] == [1] * 5 and weights["after"] == [0] * 5 and weights["linear"] == [1, 0.75, 0.5, 0.25, 0]
    assert weights["cosine"][0] == 1 and abs(weights["cosine"][-1]) < 1e-12 and weights["value:0.3"] == [0.3] * 5
    assert weights["sigmoid"][2] == 0.5
    assert places.select(nb.ramp(F.lit(0), F.lit(1), "linear")).first()[0] == 0
    with pytest.raises(ValueError):
        nb.ramp(F.lit(0), F.lit(1), "value:2")
    with pytest.raises(ValueError):
        nb.ramp(F.lit(0), F.lit(1), "other")


def test_blend_is_the_same_under_any_partitioning(spark):
    clips = spark.createDataFrame([(c, 40 + c) for c in range(6)], "clip long, num_frames long")
    plan = windows.window_plan(windows.whole_clips(clips), 9, 3)
    frames = clips.select("clip", F.explode(F.expr("sequence(0L, num_frames - 1)")).alias("frame")).withColumn("value", (F.col("frame") * 3 % 50).cast("double"))
    placed = windows.frame_windows(frames, plan).withColumn("value", F.col("value") + F.col("window_index"))
    a = sorted(map(tuple, overlap.blended(placed, plan, "cosine").collect()))
    b = sorted(map(tuple, overlap.blended(placed.repartition(5), plan.repartition(2), "cosine").collect()))
    assert a == b and len(a) == sum(40 + c for c in range(6))


def test_quality_of_equal_and_damaged_frames(spark):
    rows = [("c", f, 100.0, 100.0 if f == 0 or p else 0.0, int(p == 0)) for f in range(2) for p in range(16)]
    got = quality.pixel_quality(spark.createDataFrame(rows, "clip string, frame long, reference double, candidate double, mask int")).orderBy("frame").collect()
    assert got[0].ssim == 1 and got[0].mae == 0 and got[1].mask_mae == 100 and got[1].outside_mae == 0 and got[1].mask_pixels == 1
    empty = quality.pixel_quality(spark.createDataFrame([("c", 0, 1.0, 2.0, 0)], "clip string, frame long, reference double, candidate double, mask int")).first()
    assert empty.mask_mae is None and empty.mae == 1


def test_summary_takes_the_first_of_equal_minima(spark):
    rows = [("c", f, s, 0.0, 0.0, 0, None, 0.0) for f, s in ((3, 0.5), (1, 0.5), (2, 0.9))]
    got = quality.summary(spark.createDataFrame(rows, "clip string, frame long, ssim double, mae double, mse double, mask_pixels long, mask_mae double, outside_mae double")).first()
    assert got.min_frame == 1 and got.mask_mae is None


def test_statistics_of_empty_and_single_selections(spark):
    rows = [(0, 1.0, 0), (0, 2.0, 0), (1, 5.0, 1), (1, 9.0, 0), (2, 1.0, 1), (2, 3.0, 1)]
    got = {r.channel: r for r in statistics.masked_stats(spark.createDataFrame(rows, "channel int, x double, mask int")).collect()}
    assert (got[0].n, got[0].mean, got[0].std) == (0, 0, 1e-8)
    assert got[1].n == 1 and got[1].mean == 5 and math.isnan(got[1].std)
    assert got[2].mean == 2 and abs(got[2].std - 2**0.5) < 1e-12


def test_region_sums_do_not_depend_on_shards(spark):
    rows = [("c", i // 7, float(i % 11), float(i % 5), i % 3 % 2) for i in range(105)]
    pairs = spark.createDataFrame(rows, "clip string, part int, now double, before double, mask int")
    one, many = (sorted(map(tuple, statistics.region_sums(pairs.repartition(n)).collect())) for n in (1, 4))
    assert one == many


def test_cache_decisions_follow_their_guards(spark):
    rows = [("b", s, 0.0, "x" if s < 6 else "y") for s in range(12) if s != 9]
    probes = spark.createDataFrame(rows, "branch string, step long, distance double, layout string")
    got = {r.step: r.reason for r in reuse.residual(probes, 0.1, 2, 1, 2).collect()}
    assert got == {0: "early", 1: "early", 2: "skip", 3: "skip", 4: "run", 5: "skip", 6: "layout", 7: "skip", 8: "skip", 10: "gap", 11: "late"}
    acc = {r.step: r.skip for r in reuse.accumulated(probes, 0.25, [0.0, 0.1], 2, 1, 9).collect()}
    assert acc[2] and acc[3] and not acc[4] and acc[5] and not acc[6]


def test_rank_reports_pick_leaders(spark):
    reports = spark.createDataFrame([(0, "g", 3, 1), (1, "g", 3, 1)], "rank long, grp string, computed long, skipped long")
    assert [tuple(r) for r in reuse.leaders(reports, 1).collect()] == [("g", 6, 2, 0.25)]
    assert reuse.leaders(reports, 2).first().computed == 3


def test_tasks_take_turns(spark):
    worker, turn = shards.strided(F.col("id"), 2)
    got = spark.range(7).select("id", worker.alias("w"), turn.alias("t")).collect()
    assert [r.id for r in got if r.w == 0] == [0, 2, 4, 6] and [r.id for r in got if r.w == 1] == [1, 3, 5]


def test_pages_follow_each_other(spark):
    rows = spark.createDataFrame([(i, "queued", i // 2) for i in range(5)], "task_id long, status string, created_at long")
    one = tasks.page(rows, 2).collect()
    assert [r.task_id for r in one] == [0, 1] and all(r.has_more for r in one)
    last = tasks.page(rows, 3, (0, 1)).collect()
    assert [r.task_id for r in last] == [2, 3, 4] and not any(r.has_more for r in last)
    assert [r.task_id for r in tasks.page(rows, 2, (2, 4), ascending=False).collect()] == [3, 2]
    with pytest.raises(ValueError):
        tasks.page(rows, 0)


def test_counts_over_a_domain_have_zeros(spark):
    rows = spark.createDataFrame([("queued",)], "status string")
    assert {r.status: r.n for r in timing.counted_over(rows, "status", tasks.STATUSES).collect()} == {s: int(s == "queued") for s in tasks.STATUSES}


def test_activation_audit(spark):
    values = spark.createDataFrame([("l", x) for x in (-100.0, -56.0, -1.0, 0.0, 56.0, 100.0, math.nan, math.inf)], "layer string, x double")
    got = timing.clipped(values, 56).where("layer IS NULL").first()
    assert (got.elements, got.max_abs, got.clipped, got.nonfinite) == (8, 100, 2, 2)


def test_islands(spark):
    rows = spark.createDataFrame([("a", v) for v in (3, 1, 2, 7, 7, 9, 10)], "g string, v long")
    assert shards.islands(rows, "g", "v").first().runs == "1-3,7,9-10"


def test_islands_of_many_groups_and_nulls_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(shards, "ROWS", 10, raising=False)
    sets = {g: sorted(random.Random(g).sample(range(-9, 40), 1 + g % 30)) for g in range(60)}
    rows = [(g, v) for g, vs in sets.items() for v in vs * 2] + [(1, None), (None, 5), (None, 6), (99, None)]
    want = {None: "5-6", 99: None}
    for g, vs in sets.items():
        runs = [[v for v in vs if v - vs.index(v) == d] for d in sorted({v - i for i, v in enumerate(vs)})]
        want[g] = ",".join(str(r[0]) if len(r) == 1 else f"{r[0]}-{r[-1]}" for r in runs)
    out = shards.islands(spark.createDataFrame(rows, "g int, v long"), "g", "v")
    assert {r.g: r.runs for r in out.collect()} == want
    # what a task orders was a share of the table before, whatever its size
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_array_columns(spark):
    row = spark.createDataFrame([([3.0, 4.0, 0.0, -8.0], [0.0] * 4)], "v array<double>, z array<double>")
    v = F.col("v")
    got = row.select(ar.int8(v, ar.int8_scale(v)).alias("q"), ar.int8_scale(F.col("z")).alias("s"), ar.rotary(v, F.lit(0)).alias("r"), ar.rms_norm(v, 0.0).alias("n")).first()
    assert got.q == [48, 64, 0, -127] and got.s == 1 and got.r == [3, 4, 0, -8]
    assert abs(sum(x * x for x in got.n) / 4 - 1) < 1e-12
    assert [r[0] for r in spark.createDataFrame([("24000/1001",), ("25",), ("1/0",), ("x",), (None,)], "t string").select(nb.safe_fraction(F.col("t"))).collect()] == [24000 / 1001, 25, 0, 0, 0]


def test_attention_in_strips_of_small_memory(spark, monkeypatch):
    assert tensors.BLOCK * tensors.STRIP * 8 <= 8 << 20  # bytes of scores at once, in each of an executor's workers
    monkeypatch.setattr(tensors, "STRIP", 7)
    v = np.random.default_rng(4).normal(size=(40, 5))
    rows = spark.createDataFrame([(i, x.tolist(), (x * 2).tolist()) for i, x in enumerate(v)], "k long, v array<double>, value array<double>")
    got = {(r.q, r.place): r.y for r in tensors.attention(rows.select(F.col("k").alias("q"), "v"), rows, 3.0).collect()}
    w = np.exp(v @ v.T * 3 - (v @ v.T * 3).max(1, keepdims=True))
    want = w @ (v * 2) / w.sum(1, keepdims=True)
    assert len(got) == 200 and np.allclose([got[i, p] for i in range(40) for p in range(5)], want.ravel())


def test_attention_takes_all_keys_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(tensors, "BLOCK", 7, raising=False)
    monkeypatch.setattr(tensors, "BROADCAST_ROWS", 7)
    rng = np.random.default_rng(4)
    q, k, value = rng.normal(size=(20, 3)), rng.normal(size=(50, 3)), rng.normal(size=(50, 2))
    k[3] *= 100
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q long, v array<double>")
    keys = spark.createDataFrame([(i, v.tolist(), x.tolist()) for i, (v, x) in enumerate(zip(k, value, strict=True))], "k long, v array<double>, value array<double>")
    score = q @ k.T * 8
    w = np.exp(score - score.max(1, keepdims=True))
    want = w @ value / w.sum(1, keepdims=True)
    got = {(r.q, r.place): r.y for r in tensors.attention(queries, keys, 8.0).collect()}
    assert len(got) == 40 and all(abs(y - want[i]) < 1e-9 for i, y in got.items())
    assert tensors.attention(queries, keys.limit(0), 8.0).collect() == []


def test_streamed_windows_of_clips_are_those_of_the_plan(spark, tmp_path):
    clips = spark.createDataFrame([(n, n) for n in (1, 3, 4, 16, 17, 18, 31, 32, 45, 46, 100)], "clip long, num_frames long")
    frames = clips.select("*", F.explode(F.expr("sequence(1L, num_frames)")).alias("f")).select("clip", F.timestamp_seconds("f").alias("ts"), "num_frames", "f")
    for n, half in enumerate((frames.where("f <= 20"), frames.where("f > 20"))):
        half.drop("f").coalesce(1).write.parquet(str(tmp_path / f"in/b={n}"))
    source = spark.readStream.schema("clip long, ts timestamp, num_frames long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/b=*"))
    got = streams.collected(streams.fired_windows(source, 17, 3), str(tmp_path / "out"), "append")
    plan = windows.window_plan(windows.whole_clips(clips), 17, 3)
    want = plan.join(windows.stable_ranges(plan), ["clip", "window_index"]).select("clip", "window_index", "load_start", "load_end", "stable_start", "stable_end")
    assert sorted(map(tuple, got.drop("batch").collect())) == sorted(map(tuple, want.collect()))


def test_rounds_number_a_hot_rank_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(tensors, "RANGE", 7)
    plan = [(t * t % 1009, 0 if t % 3 else t % 5) for t in range(200)] + [(None, 0), (5000, None)]
    got = tensors.rounds(spark.createDataFrame(plan, "task long, rank long"), spark.range(6).select(F.col("id").alias("rank"))).collect()
    want = {}
    for rank in range(6):
        mine = sorted((t for t, r in plan if r == rank), key=lambda t: (t is not None, t))
        want[rank] = mine
    longest = max(map(len, want.values()))
    assert sorted((r.rank, r.round) for r in got) == [(rank, i) for rank in range(6) for i in range(longest)]
    for r in got:
        assert r.task == (want[r.rank][r.round] if r.round < len(want[r.rank]) else None)
    assert tensors.rounds(spark.createDataFrame([], "task long, rank long"), spark.range(2).select(F.col("id").alias("rank"))).collect() == []


def test_decisions_of_a_long_branch_and_of_many(spark):
    steps = spark.range(40_000).select(F.lit("long").alias("branch"), F.col("id").alias("step"), (F.col("id") % 7 / 10).alias("distance"), F.when(F.col("id") % 1000 == 0, "b").otherwise("a").alias("layout"))
    more = steps.where("step < 50").withColumn("branch", F.explode(F.array(*[F.lit(f"b{i}") for i in range(20)])))
    both = steps.union(more).repartition(5, "distance")
    got = {(r.branch, r.step): r.reason for r in reuse.accumulated(both, 0.9, [1.0, 0.0], 2, 3, 4).collect()}
    assert len(got) == 41_000 and {s for (b, s), r in got.items() if b == "long" and r == "late"} == {39_997, 39_998, 39_999}
    state, run, want = 0.0, 0, []
    for s in range(50):
        layout, before = ("b" if s % 1000 == 0 else "a"), ("b" if (s - 1) % 1000 == 0 else "a")
        reason = "early" if s < 2 else "late" if s >= 47 else "layout" if layout != before else "run" if run >= 4 else "skip" if state + s % 7 / 10 < 0.9 else "distance"
        state, run = (state + s % 7 / 10, run + 1) if reason == "skip" else (0.0, 0)
        want.append(reason)
    assert all([got[f"b{i}", s] for s in range(50)] == want for i in range(20))
