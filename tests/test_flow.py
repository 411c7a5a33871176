"""Windows that commit, stores by ranges and ordered outputs: brute force, order of arrival, failures."""

import glob
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from framelode.operators import rangestore as rs
from framelode.plans import windows
from framelode.sources import frameblocks as fb
from framelode.streaming import carried

# --- windows that commit ------------------------------------------------------------------------------------------


def plan_of(spark, clips, scenes, infer_len, overlap):
    rows = [(c, n, s, ln) for c, n in clips for s, ln in scenes]
    return windows.window_plan(windows.normalized_scenes(spark.createDataFrame(rows, "clip long, num_frames long, start long, length long")), infer_len, overlap)


def committed_by_hand(frames, plan, edit, mode, whole=False):
    """The same, window after window, on dicts frame -> pixels of one clip; masked: a set of frames."""
    pixels, masked = frames
    out, carry = {}, {}
    for w in plan:
        end = w.deal_start + w.deal_length
        stable = end - w.overlap_right
        if not any(f in masked for f in range(w.deal_start, end)):
            out |= {f: (pixels[f], w.window_index, False) for f in range(w.load_start, stable)}
            carry = {f: pixels[f] for f in range(stable, end)}
            continue
        src = np.array([carry[f] if f in carry and f < w.load_start + w.overlap_left else pixels[f] for f in range(w.load_start, w.load_end)])
        new = edit(src, w.window_index).astype(float)
        share = carried.ramp_values(w.overlap_left, mode)[:, None]
        new[: w.overlap_left] = share * src[: w.overlap_left] + (1 - share) * new[: w.overlap_left]
        new = np.rint(new.clip(0, 255)) if whole else new
        out |= {f: (new[f - w.load_start], w.window_index, True) for f in range(w.load_start, stable)}
        carry = {f: new[f - w.load_start] for f in range(stable, end)}
    return {f: out.get(f, (p, None, False)) for f, p in pixels.items()}


def an_edit(pixels, window_index):
    # depends on the whole window, so a wrong source is seen everywhere
    return pixels * 0.75 + pixels.mean() * 0.25 + 3 * window_index + np.arange(len(pixels))[:, None]


@pytest.mark.parametrize(("infer_len", "overlap", "mode", "whole"), [(9, 2, "linear", False), (8, 5, "cosine", False), (7, 1, "sigmoid", True), (6, 3, "value:0.25", False), (5, 0, "before", False)])
def test_carried_windows_equal_one_after_the_other(spark, infer_len, overlap, mode, whole):
    rng = np.random.default_rng(infer_len)
    clips = [(1, 40), (2, 23), (3, 6), (4, 1)]
    rows, want = [], {}
    plan = plan_of(spark, clips, [(0, 11), (14, 9), (30, 99)], infer_len, overlap)
    for c, n in clips:
        pixels = {f: rng.uniform(0, 255, 3).round(2) for f in range(n)}
        masked = {f for f in range(n) if f % 13 < 4}
        mine = plan.where(F.col("clip") == c).orderBy("window_index").collect()
        want |= {(c, f): v for f, v in committed_by_hand((pixels, masked), mine, an_edit, mode, whole).items()}
        rows += [(c, f, [float(x) for x in p], f in masked) for f, p in pixels.items()]
    random.Random(1).shuffle(rows)
    frames = spark.createDataFrame(rows, "clip long, frame long, pixels array<double>, masked boolean").repartition(3)
    got = carried.carried_windows(frames, plan, an_edit, mode, whole).collect()
    assert len(got) == len(want) == len({(r.clip, r.frame) for r in got})
    for r in got:
        p, k, changed = want[r.clip, r.frame]
        assert np.allclose(r.pixels, p) and r.window_index == k and r.changed == changed, r

def test_a_table_needs_no_state_store(spark):
    rows = [(c, f, [float(f), 1.0], f == 3) for c in range(40) for f in range(9)]
    frames = spark.createDataFrame(rows, "clip long, frame long, pixels array<double>, masked boolean").repartition(5)
    out = carried.carried_windows(frames, plan_of(spark, [(c, 9) for c in range(40)], [(0, 9)], 5, 2), an_edit, "linear")
    assert "TransformWithState" not in out._jdf.queryExecution().toString()
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)  # clips go on from batch to batch
    try:
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted((r.clip, r.frame) for r in got) == [(c, f) for c in range(40) for f in range(9)]


def batches(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in glob.glob(str(tmp_path / "in" / "part-*")):
            if not os.path.basename(f).startswith("part-b"):
                os.rename(f, tmp_path / "in" / f"part-b{i}.parquet")
                os.utime(tmp_path / "in" / f"part-b{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(stream, tmp_path, sink):
    def keep(df, number):
        sink.append(df.collect())

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()


SCHEMA = "clip long, frame long, pixels array<double>, masked boolean"


def test_stream_commits_a_window_with_its_last_frame_whatever_the_order(spark, tmp_path):
    plan = plan_of(spark, [(1, 14)], [(0, 14)], 6, 2)
    row = lambda f: (1, f, [float(f)], True)
    order = [[row(0), row(1), row(2)], [row(5), row(4)], [row(3)], [row(f) for f in (13, 12, 11, 10)], [row(f) for f in (6, 7, 9, 8)]]
    seen = []
    run(carried.carried_windows(batches(spark, tmp_path, order, SCHEMA), plan, an_edit, "linear"), tmp_path, seen)
    # windows 0-5, 4-9, 8-13; a batch without a whole window gives nothing
    assert [sorted(r.frame for r in b) for b in seen] == [[], [], [0, 1, 2, 3], [], list(range(4, 14))]
    want = committed_by_hand(({f: np.array([float(f)]) for f in range(14)}, set(range(14))), plan.orderBy("window_index").collect(), an_edit, "linear")
    assert all(np.allclose(r.pixels, want[r.frame][0]) for b in seen for r in b)


@pytest.mark.parametrize("late", [1, 4])
def test_late_and_repeated_frames_raise(spark, tmp_path, late):
    plan = plan_of(spark, [(1, 14)], [(0, 14)], 6, 2)
    row = lambda f: (1, f, [float(f)], True)
    stream = carried.carried_windows(batches(spark, tmp_path, [[row(f) for f in range(6)], [row(late)]], SCHEMA), plan, an_edit, "linear")
    with pytest.raises(Exception, match="late or arrived twice"):
        run(stream, tmp_path, [])


# --- stores by ranges ---------------------------------------------------------------------------------------------


def commits_of(rng, n, clips, length):
    return [(int(rng.integers(clips)), v, int(s), int(s + rng.integers(0, length))) for v, s in enumerate(rng.integers(0, 3 * length, n))]


def owners_by_hand(rows):
    own = {}
    for c, v, s, e in sorted(rows, key=lambda r: r[1]):
        own |= {(c, f): v for f in range(s, e)}
    return own


@pytest.mark.parametrize(("n", "length", "strip"), [(400, 60, 16), (150, 1000, 4096), (30, 5, 2), (1, 9, 4)])
def test_ranges_after_many_overlapping_commits(spark, monkeypatch, n, length, strip):
    monkeypatch.setattr(rs, "STRIP", strip)
    rows = commits_of(np.random.default_rng(n), n, 3, length)
    commits = spark.createDataFrame(rows, "clip long, version long, start long, end long").repartition(3)
    got = rs.committed(commits)
    want = owners_by_hand(rows)
    spans = sorted((r.clip, r.start, r.end, r.version) for r in got.collect())
    assert {(c, f): v for c, s, e, v in spans for f in range(s, e)} == want
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))
    frames = spark.range(4 * length + 3).select("id", F.explode(F.expr("sequence(0L, 3L)")).alias("clip")).select("clip", F.col("id").alias("frame"))
    held = {(r.clip, r.frame): r.version for r in rs.owned(frames, got).collect()}
    assert held == {k: want.get(k) for k in held} and len(held) == 4 * (4 * length + 3)

@pytest.mark.parametrize("long", [5, 40, 10**6])
def test_strips_are_painted_across_batches_and_only_long_commits_use_nodes(spark, monkeypatch, long):
    monkeypatch.setattr(rs, "STRIP", 8)
    monkeypatch.setattr(rs, "LONG", long)
    monkeypatch.setattr(rs, "SIDE_BY_SIDE", 3)
    asked, covering = [], rs.covering
    monkeypatch.setattr(rs, "covering", lambda ranges: asked.append(1) or covering(ranges))
    rows = commits_of(np.random.default_rng(12), 300, 3, 60)
    commits = spark.createDataFrame(rows + rows[:5], "clip long, version long, start long, end long").repartition(4)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted((r.clip, r.start, r.end, r.version) for r in rs.committed(commits).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    own = owners_by_hand(rows)
    want = []
    for clip in {r[0] for r in rows}:
        points = sorted({p for c, _, s, e in rows if c == clip and e > s for p in (s, e)})
        want += [(clip, a, b, own[clip, a]) for a, b in zip(points, points[1:], strict=False) if (clip, a) in own]
    assert got == sorted(want)
    assert bool(asked) == (long < 60)


def test_each_point_meets_each_range_that_holds_it_once(spark):
    rows = commits_of(np.random.default_rng(8), 60, 2, 40)
    ranges = spark.createDataFrame(rows, "clip long, version long, start long, end long")
    points = spark.range(170).select(F.lit(1).cast("long").alias("clip"), F.col("id").alias("frame"))
    got = sorted((r.frame, r.version) for r in rs.stabbed(points, ranges).collect())
    assert got == sorted((f, v) for c, v, s, e in rows for f in range(s, e) if c == 1)
    assert rs.covering(ranges).count() <= 2 * 6 * len(rows)
    assert rs.stabbed(points, ranges.where("end <= start")).count() == 0 and rs.committed(ranges.limit(0)).count() == 0
    with pytest.raises(ValueError, match="starts at -1"):
        rs.covering(spark.createDataFrame([(1, 1, -1, 4)], "clip long, version long, start long, end long"))


def test_no_row_for_each_frame_of_a_commit(spark):
    # two commits of a million million frames
    rows = [(1, 1, 5, 10**12), (1, 2, 7, 10**12 - 3)]
    got = rs.committed(spark.createDataFrame(rows, "clip long, version long, start long, end long")).orderBy("start").collect()
    assert [(r.start, r.end, r.version) for r in got] == [(5, 7, 1), (7, 10**12 - 3, 2), (10**12 - 3, 10**12, 1)]


def test_resets_and_appends(spark):
    schema = "clip long, version long, start long, end long"
    commits = spark.createDataFrame([(1, 1, 0, 10), (1, 3, 5, 20), (1, 5, 0, 4), (2, 1, 0, 3), (1, 4, 0, 2)], schema)
    resets = spark.createDataFrame([(1, 2, 2, 9), (1, 4, 3, 12)], schema)
    got = sorted((r.clip, r.version, r.start, r.end) for r in rs.after_resets(commits, resets).collect())
    assert got == [(1, 1, 3, 9), (1, 3, 5, 12), (1, 4, 0, 2), (1, 5, 0, 4), (2, 1, 0, 3)]
    fine = spark.createDataFrame([(1, 1, 0, 4), (1, 2, 4, 4), (1, 3, 4, 9), (2, 1, 0, 1)], schema)
    assert rs.appended(fine).count() == 3
    for start in (5, 3):
        with pytest.raises(Exception, match=r"contiguous write at 4 was given \[%d, 9\)" % start):
            rs.appended(fine.withColumn("start", F.when(F.col("version") == 3, start).otherwise(F.col("start")))).collect()


def test_patches_in_order_of_version(spark):
    rng = np.random.default_rng(9)
    frames = {(c, f): rng.integers(0, 256, (3, 4)).astype(np.uint8) for c in (1, 2) for f in range(12)}
    rows, commits = [(c, f, 3, 4, bytearray(x.tobytes())) for (c, f), x in frames.items()], []
    for v in range(40):
        c, s, n = int(rng.integers(1, 3)), int(rng.integers(0, 12)), int(rng.integers(0, 5))
        x, y = int(rng.integers(0, 4)), int(rng.integers(0, 3))
        w, h = int(rng.integers(0, 5 - x)), int(rng.integers(0, 4 - y))
        whole = v % 7 == 0
        data = rng.integers(0, 256, (n, 3, 4) if whole else (n, h, w)).astype(np.uint8)
        commits.append((c, v, s, s + n, *((None,) * 4 if whole else (x, y, w, h)), bytearray(data.tobytes())))
        for i in range(n):
            if (c, s + i) in frames:
                target = frames[c, s + i]
                target[...] = data[i] if whole else target
                if not whole:
                    target[y : y + h, x : x + w] = data[i]
    df = spark.createDataFrame(rows, "clip long, frame long, height int, width int, pixels binary")
    laid = spark.createDataFrame(commits, "clip long, version long, start long, end long, x int, y int, w int, h int, patch binary").repartition(3)
    got = {(r.clip, r.frame): bytes(r.pixels) for r in rs.patched(df, laid).collect()}
    assert got == {k: x.tobytes() for k, x in frames.items()}
    with pytest.raises(Exception, match="exceeds frame"):
        rs.patched(df, laid.withColumn("x", F.when(F.col("x").isNotNull(), 3)).withColumn("w", F.lit(2)).withColumn("h", F.lit(1)).withColumn("patch", F.lit(b"\x01" * 40))).collect()


# --- ordered outputs ----------------------------------------------------------------------------------------------


def pictures(spark, sizes):
    rows = spark.createDataFrame([(c, n) for c, n in sizes], "clip long, n long").withColumn("frame", F.explode(F.expr("sequence(0L, n - 1)")))
    return rows.select("clip", "frame", F.format_string("%d:%05d;", "clip", "frame").cast("binary").alias("pixels"))


def whole(spark, path):
    return [(r.clip, r.frame, bytes(r.pixels)) for r in fb.read_ordered(spark, path).collect()]


def want(sizes):
    return [(c, f, b"%d:%05d;" % (c, f)) for c, n in sorted(sizes) for f in range(n)]


def test_a_clip_larger_than_a_task_comes_back_in_order(spark, tmp_path):
    sizes = [(7, 4000), (2, 3), (9, 1)]
    path = str(tmp_path / "o")
    fb.write_ordered(pictures(spark, sizes).repartition(5), path, 6)
    assert len(fb.parts(path)) >= 4 and sum(p["low"][0] == 7 for p in fb.parts(path)) >= 3
    assert whole(spark, path) == want(sizes)
    # only the parts that can hold the clip are read
    one = fb.read_ordered(spark, path).where("clip = 2")
    assert one.rdd.getNumPartitions() < len(fb.parts(path)) and one.count() == 3
    made = {r.clip: (r.frames, r.bytes) for r in fb.composed(spark, path, str(tmp_path / "files")).collect()}
    assert made == {7: (4000, 32000), 2: (3, 24), 9: (1, 8)}
    assert (tmp_path / "files" / "7.raw").read_bytes() == b"".join(x for c, _, x in want(sizes) if c == 7)
    # an overwriting job leaves nothing of its predecessor
    fb.write_ordered(pictures(spark, [(1, 5)]), path, 2)
    assert whole(spark, path) == want([(1, 5)]) and len(os.listdir(f"{path}/_data")) == len(os.listdir(f"{path}/_manifest")) == 1


def test_a_failing_task_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "o")
    fb.write_ordered(pictures(spark, [(1, 50)]), path, 3)
    broken = pictures(spark, [(3, 900)]).withColumn("pixels", F.when(F.col("frame") == 700, F.raise_error(F.lit("no such frame")).cast("binary")).otherwise(F.col("pixels")))
    with pytest.raises(Exception, match="no such frame"):
        fb.write_ordered(broken, path, 4)
    assert whole(spark, path) == want([(1, 50)])
    # a task that fails while it writes, after others have written their parts
    late = pictures(spark, [(3, 900)]).repartition(1).sortWithinPartitions(F.desc("frame"))
    with pytest.raises(Exception, match="comes after"):
        late.union(pictures(spark, [(4, 5)])).write.format("frameblocks").mode("append").save(path)
    assert whole(spark, path) == want([(1, 50)]) and len(os.listdir(f"{path}/_data")) == 1


@pytest.mark.parametrize("fault", ["gap", "twice", "tail"])
def test_gaps_and_repeats_are_not_published(spark, tmp_path, fault):
    path = str(tmp_path / "o")
    rows = pictures(spark, [(1, 30), (2, 4)])
    bad = {"gap": rows.where("clip <> 1 OR frame <> 17"), "twice": rows.union(rows.where("frame = 9").withColumn("frame", F.col("frame") + 20)), "tail": rows.where("frame > 0")}[fault]
    with pytest.raises(Exception, match="was due|comes after"):
        fb.write_ordered(bad, path, 3)
    assert whole(spark, path) == [] and (not os.path.exists(f"{path}/_data") or os.listdir(f"{path}/_data") == [])
    fb.write_ordered(rows.where("clip = 1 AND frame < 20"), path, 2)
    fb.write_ordered(rows.where("clip = 1 AND frame >= 20"), path, 2, overwrite=False)
    assert whole(spark, path) == want([(1, 30)])


def test_what_a_lost_attempt_wrote_goes_with_the_publication(spark, tmp_path):
    batches = pictures(spark, [(1, 9)]).toArrow().to_batches()
    writer = fb.Writer({"path": str(tmp_path)}, True)
    writer.write(iter(batches))  # its message never arrives
    writer.commit([writer.write(iter(batches)), writer.write(iter([])), None])
    assert len(fs.LocalFileSystem().get_file_info(fs.FileSelector(f"{tmp_path}/_data/{writer.job}"))) == 2
    assert whole(spark, str(tmp_path)) == want([(1, 9)])


def test_a_task_that_outlives_its_job_leaves_nothing(spark, tmp_path):
    batches = pictures(spark, [(1, 9)]).toArrow().to_batches()
    fb.write_ordered(pictures(spark, [(2, 4)]), str(tmp_path), 2)
    writer = fb.Writer({"path": str(tmp_path)}, True)
    writer.abort([])
    with pytest.raises(FileNotFoundError):
        writer.write(iter(batches))
    assert len(os.listdir(f"{tmp_path}/_data")) == 1 and whole(spark, str(tmp_path)) == want([(2, 4)])


@pytest.mark.parametrize(("rows", "chunk"), [(10_000, 8 << 20), (7, 8 << 20), (10_000, 50), (3, 2)])
def test_frames_of_changing_sizes_are_read_many_at_once(spark, tmp_path, monkeypatch, rows, chunk):
    monkeypatch.setattr(fb, "ROWS", rows, raising=False)
    monkeypatch.setattr(fb, "CHUNK", chunk)
    made = [(c, f, b"x" * ((c * f * f) % 5)) for c in (1, 2, 5) for f in range(40)]
    table = pa.table([pa.array(x, k) for x, k in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["clip", "frame", "pixels"])
    writer = fb.Writer({"path": str(tmp_path)}, True)
    # batches that are slices, one of them empty
    writer.commit([writer.write(iter([*table.slice(0, 33).to_batches(), *table.slice(33, 0).to_batches(), table.slice(33).to_batches()[0]]))])
    reader = fb.Reader({"path": str(tmp_path)})
    read = [b for p in reader.partitions() for b in reader.read(p)]
    assert [tuple(r.values()) for b in read for r in b.to_pylist()] == made
    # a batch for each run of equal sizes before: most of the time of reading
    assert all(len(b) <= rows for b in read) and (len(read) == 1 if rows + chunk > 8 << 20 and rows > 7 else len(read) > 1)
    reader.clip = 2
    assert [r["pixels"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == [p for c, _, p in made if c == 2]
    with pytest.raises(ValueError, match="frame 0 of clip 1 comes after frame 39 of clip 5"):
        writer.write(iter([*table.to_batches(), *table.to_batches()]))
