"""Tiles, patches, colours, filled masks and digests: against plain loops over whole images."""

import colorsys
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelode.functions import colors
from framelode.operators import digests, images, patches, quality, tiles, transfer

# --- tiles --------------------------------------------------------------------------------------------------------


def seam(before, tile, extent, axis):
    """Mixes in place, as the tiles of one whole image are mixed one after the other."""
    a, b = np.moveaxis(before, axis, 0), np.moveaxis(tile, axis, 0)
    n = min(len(a), len(b), extent)
    for k in range(n):
        b[k] = a[len(a) - n + k] * (1 - k / n) + b[k] * (k / n)


def whole_image(x, work, tile, stride, scale):
    height, width = x.shape
    grid = [[np.array(work(x[i : i + tile[0], j : j + tile[1]]), float)[: int(min(tile[0], height - i) * scale), : int(min(tile[1], width - j) * scale)] for j in range(0, width, stride[1])] for i in range(0, height, stride[0])]
    extent, step = [int((t - s) * scale) for t, s in zip(tile, stride, strict=True)], [int(s * scale) for s in stride]
    for i, row in enumerate(grid):
        for j, t in enumerate(row):
            if i:
                seam(grid[i - 1][j], t, extent[0], 0)
            if j:
                seam(row[j - 1], t, extent[1], 1)
    return np.concatenate([np.concatenate([t[: step[0], : step[1]] for t in row], 1) for row in grid], 0)


def halved(t):
    even = t[: len(t) // 2 * 2, : t.shape[1] // 2 * 2]
    return even.reshape(len(even) // 2, 2, even.shape[1] // 2, 2).mean((1, 3)) - t.mean()


@pytest.mark.parametrize(
    ("shape", "tile", "stride", "scale", "work"),
    [((23, 17), (8, 8), (6, 5), Fraction(1), lambda t: t - 0.5 * t.mean()), ((21, 30), (8, 6), (2, 1), Fraction(1), lambda t: t * t.mean()), ((26, 20), (8, 12), (6, 8), Fraction(1, 2), halved), ((13, 9), (6, 4), (4, 3), Fraction(2), lambda t: np.kron(t, np.ones((2, 2))) + t.mean()), ((5, 5), (9, 9), (9, 9), Fraction(1), lambda t: t), ((1, 7), (4, 4), (1, 2), Fraction(1), lambda t: t + t.sum())],
)
def test_tiles_equal_those_of_a_whole_image(spark, shape, tile, stride, scale, work):
    x = {i: np.random.default_rng(i).normal(size=shape) for i in (1, 2)}
    rows = [(i, y, v[y].tolist()) for i, v in x.items() for y in range(shape[0])]
    random.Random(2).shuffle(rows)
    out = tiles.tiled(spark.createDataFrame(rows, "id long, y int, pixels array<double>").repartition(3), work, tile, stride, scale)
    want = {i: whole_image(v, work, tile, stride, scale) for i, v in x.items()}
    got = {i: np.full(w.shape, np.nan) for i, w in want.items()}
    for r in out.collect():
        assert np.isnan(got[r.id][r.y, r.x : r.x + len(r.pixels)]).all()
        got[r.id][r.y, r.x : r.x + len(r.pixels)] = r.pixels
    assert all(np.allclose(got[i], want[i]) for i in want)


def test_broken_images_and_strides_raise(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 2, [3.0, 4.0])], "id long, y int, pixels array<double>")
    with pytest.raises(Exception, match="missing row"):
        tiles.tiled(rows, lambda t: t, (4, 4), (2, 2)).collect()
    with pytest.raises(ValueError, match="stride"):
        tiles.tiled(rows, lambda t: t, (4, 4), (5, 2))
    with pytest.raises(ValueError, match="whole"):
        tiles.tiled(rows, lambda t: t, (4, 4), (3, 2), Fraction(1, 2))
    with pytest.raises(Exception, match="gave"):
        tiles.tiled(rows.where("y = 0"), lambda t: t[:0], (4, 4), (2, 2)).collect()
    assert tiles.tiled(rows.limit(0), lambda t: t, (4, 4), (2, 2)).collect() == []


def paired(t):
    n = (len(t) - 1) // 2
    return np.concatenate([t[:1], t[1 : 1 + 2 * n].reshape(n, 2, t.shape[1]).mean(1)]) - 0.3 * t.mean()


@pytest.mark.parametrize(("frames", "tile", "stride"), [(31, 10, 6), (40, 12, 4), (9, 8, 8), (3, 8, 2), (1, 4, 2), (26, 8, 2)])
def test_tiles_of_time(spark, frames, tile, stride):
    x = np.random.default_rng(frames).normal(size=(frames, 3))
    parts = [paired(x[i : i + tile + 1])[1 if i else 0 :] for i in range(0, frames, stride)]
    step, extent, rows = stride // 2, (tile - stride) // 2, []
    for i, t in enumerate(parts):
        if i:
            seam(parts[i - 1], t, extent, 0)
        rows.append(t[: step + (not i)])
    want = np.concatenate(rows)
    df = spark.createDataFrame([("c", f, x[f].tolist()) for f in range(frames)], "clip string, frame int, pixels array<double>").repartition(3)
    got = {r.frame: r.pixels for r in tiles.tiled_frames(df, paired, tile, stride, 2).collect()}
    assert sorted(got) == list(range(len(want))) and np.allclose([got[f] for f in sorted(got)], want)


@pytest.mark.parametrize(("run", "tile", "stride"), [(1, 10, 6), (2, 12, 4), (1, 8, 8), (3, 8, 2)])
def test_tiles_of_time_are_no_groups_and_parts_of_a_clip_meet(spark, monkeypatch, run, tile, stride):
    monkeypatch.setattr(tiles, "RUN", run, raising=False)
    clips = {c: np.random.default_rng(n).normal(size=(n, 2)) for c, n in (("a", 71), ("b", 1), (None, 40), ("d", 13))}
    want, step, extent = {}, stride // 2, (tile - stride) // 2
    for clip, x in clips.items():
        parts, rows = [paired(x[i : i + tile + 1])[1 if i else 0 :] for i in range(0, len(x), stride)], []
        for i, t in enumerate(parts):
            if i:
                seam(parts[i - 1], t, extent, 0)
            rows.append(t[: step + (not i)])
        want |= {(clip, f): v for f, v in enumerate(np.concatenate(rows))}
    df = spark.createDataFrame([(c, f, v.tolist()) for c, x in clips.items() for f, v in enumerate(x)], "clip string, frame long, pixels array<double>").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = tiles.tiled_frames(df, paired, tile, stride, 2)
        got = out.collect()
        with pytest.raises(Exception, match="missing frame"):
            tiles.tiled_frames(df.where("clip <> 'a' OR frame <> 50"), paired, tile, stride, 2).collect()
        with pytest.raises(Exception, match="missing frame"):
            tiles.tiled_frames(df.where("clip <> 'a' OR frame > 0"), paired, tile, stride, 2).collect()
        assert tiles.tiled_frames(df.limit(0), paired, tile, stride, 2).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(want) and all(np.allclose(r.pixels, want[r.clip, r.frame]) for r in got)
    # a group in Python for each tile took most of the time
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()


# --- patches ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("shape", "size", "stride", "padding"), [((8, 8), (2, 2), (2, 2), (0, 0)), ((7, 9), (3, 4), (2, 3), (1, 2)), ((5, 5), (3, 3), (1, 1), (1, 1)), ((4, 6), (1, 3), (3, 1), (0, 0)), ((2, 2), (5, 5), (1, 1), (1, 1))])
def test_patches_and_projection(spark, shape, size, stride, padding):
    rng = np.random.default_rng(3)
    x, w, bias = rng.normal(size=(2, 2, *shape)), rng.normal(size=(3, 2, *size)), rng.normal(size=3)
    rows = [(i, *shape, y, c, k, float(x[i, k, y, c])) for i in range(2) for k in range(2) for y in range(shape[0]) for c in range(shape[1])]
    pixels = spark.createDataFrame(rows, "id long, height int, width int, y int, x int, channel int, value double").repartition(3)
    weights = spark.createDataFrame([(n, w[n].ravel().tolist(), float(bias[n])) for n in range(3)], "n long, w array<double>, bias double")
    wide = np.pad(x, ((0, 0), (0, 0), (padding[0],) * 2, (padding[1],) * 2))
    want = {}
    for r in range(0, wide.shape[2] - size[0] + 1, stride[0]):
        for c in range(0, wide.shape[3] - size[1] + 1, stride[1]):
            for i in range(2):
                for n in range(3):
                    want[i, r // stride[0], c // stride[1], n] = float((wide[i, :, r : r + size[0], c : c + size[1]] * w[n]).sum() + bias[n])
    got = {(r.id, r.row, r.col, r.n): r.y for r in patches.projected(patches.patch_rows(pixels, size, stride, padding, 2), weights).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


# --- colours ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("space", list(colors.SPACES))
def test_spaces_and_back(spark, space):
    rng = np.random.default_rng(5)
    points = [*rng.random((200, 3)).tolist(), [0.0] * 3, [1.0] * 3, [0.5] * 3, [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [1.0, 1.0, 0.0], [0.2, 0.2, 0.9]]
    df = spark.createDataFrame([(p,) for p in points], "p array<double>")
    to, back = colors.SPACES[space]
    there = to(tuple(F.col("p")[i] for i in range(3)))
    rows = df.select("p", *[c.alias(f"c{i}") for i, c in enumerate(there)])
    rows = rows.select("p", "c0", "c1", "c2", *[c.alias(n) for n, c in zip("rgb", back(tuple(F.col(f"c{i}") for i in range(3))), strict=True)]).collect()
    for r in rows:
        assert np.allclose([r.r, r.g, r.b], r.p, atol=5e-3 if space == "YUV" else 2e-4), (space, r)
        if space in ("HSV", "HLS"):
            want = (colorsys.rgb_to_hsv if space == "HSV" else colorsys.rgb_to_hls)(*r.p)
            assert np.allclose([r.c0 / (2 * math.pi), r.c1, r.c2], want, atol=1e-6), r
    if space == "LAB":
        white = next(r for r in rows if r.p == [1.0] * 3)
        assert abs(white.c0 - 100) < 1e-3 and abs(white.c1) < 0.02 and abs(white.c2) < 0.02


@pytest.mark.parametrize("together", [False, True])
def test_colours_follow_the_referred_area(spark, together):
    rng = np.random.default_rng(6)
    made, source = rng.random((3, 50, 3)), rng.random((3, 50, 3))
    refer = [rng.random(50) < 0.6, np.zeros(50, bool), np.arange(50) == 4]
    rows = [(k, p, made[k, p].tolist(), source[k, p].tolist(), bool(refer[k][p])) for k in range(3) for p in range(50)]
    df = spark.createDataFrame(rows, "k long, place int, made array<double>, source array<double>, refer boolean").repartition(3)
    got = {(r.k, r.place): (r.r, r.g, r.b) for r in transfer.aligned(df, ["k"], per_channel=not together).collect()}
    cut = np.trunc(made * 255) / 255
    stat = lambda x: (x.mean(), math.sqrt(x.var(ddof=1) + 1e-8))
    for c in range(3):
        pick = (lambda a, m=None: a[:, c] if m is None else a[m][:, c]) if not together else (lambda a, m=None: a.ravel() if m is None else a[m].ravel())
        (m, s), (ml, sl), (mo, so) = stat(pick(cut[0])), stat(pick(cut[0], refer[0])), stat(pick(source[0], refer[0]))
        want = (cut[0, :, c] - m) / s * (so / sl * s) + mo / ml * m
        want = np.trunc((want + 1e-9).clip(0, 1) * 255) / 255
        assert np.allclose([got[0, p][c] for p in range(50)], want)
        # no referred pixel: nothing by channel, everything as it is together; one pixel has no variance alone
        assert [got[1, p][c] for p in range(50)] == ([None] * 50 if not together else pytest.approx(cut[1, :, c]))
        assert all((got[2, p][c] is None) == (not together) for p in range(50))

@pytest.mark.parametrize("together", [False, True])
def test_a_referred_area_without_light_has_no_colour(spark, together):
    # what is referred is cut to 0: its mean is no divisor, whatever the source shows there
    rows = [(k, p, [0.003 if p < lit else 0.5] * 3, [0.25 + 0.01 * p] * 3, p < 2) for k, lit in ((0, 2), (1, 1)) for p in range(6)]
    df = spark.createDataFrame(rows, "k long, place long, made array<double>, source array<double>, refer boolean")
    got = transfer.aligned(df, ["k"], per_channel=not together).collect()
    assert {(r.r, r.g, r.b) for r in got if r.k == 0} == {(None, None, None)}
    assert all(r.r is not None for r in got if r.k == 1)


# --- masks and quality --------------------------------------------------------------------------------------------


def stack(spark, frames, names="pixels"):
    rows = [(1, i, *a[0].shape, *(bytearray(x.astype(np.uint8).tobytes()) for x in a)) for i, a in enumerate(frames)]
    return spark.createDataFrame(rows, "clip long, frame int, height int, width int, " + ", ".join(f"{n} binary" for n in names.split())).repartition(2)


def blur_by_hand(a, sigma=0.8):
    k = images.gaussian_kernel(3, sigma)
    for axis in (0, 1):
        wide = np.pad(a, [(1, 1) if x == axis else (0, 0) for x in (0, 1)], mode="reflect")
        a = sum(w * np.take(wide, np.arange(i, i + a.shape[axis]), axis) for i, w in enumerate(k))
    return a


def test_masks_are_filled_by_as_many_steps_as_the_clip_needs(spark):
    masks = [np.full((9, 12), 255) for _ in range(3)]
    masks[0][0, 0], masks[1][4, 6], masks[2][:, :11] = 10, 0, 0
    left, steps = [1 - m / 255 for m in masks], 0
    while min(x.min() for x in left) <= 0:
        left, steps = [blur_by_hand(x) for x in left], steps + 1
    assert steps == 11
    got = {r.frame: np.array(r.filled).reshape(9, 12) for r in images.filled_masks(stack(spark, [[m] for m in masks])).collect()}
    assert all(np.allclose(got[i], 1 - x, atol=1e-12) for i, x in enumerate(left))
    with pytest.raises(Exception, match="the mask is full in frame 0 of clip 1"):
        images.filled_masks(stack(spark, [[np.full((3, 3), 255)]])).collect()
    assert images.filled_masks(stack(spark, [[m] for m in masks]).limit(0)).collect() == []


def test_frames_of_other_sizes_in_one_batch_and_wrong_sizes(spark):
    frames = [[np.arange(12).reshape(3, 4)], [np.arange(20).reshape(5, 4)], [np.arange(3).reshape(1, 3)]]
    got = {r.frame: bytes(r.pixels) for r in images.cropped(stack(spark, frames).coalesce(1), 1, 0, 2, 1).collect()}
    assert got == {0: b"\x01\x02", 1: b"\x01\x02", 2: b"\x01\x02"}
    with pytest.raises(Exception, match="expected"):
        images.padded(stack(spark, frames).withColumn("height", F.lit(2)), 4).collect()


def test_a_report_has_all_values(spark):
    a = np.full((64, 64), 100)
    b, m = a.copy(), np.zeros((64, 64))
    b[30:34, 30:34], m[30:34, 30:34] = 0, 1
    none = np.zeros((64, 64))
    frames = stack(spark, [[a, a, none], [a, b, m], [a, b, m], [a, a, m]], "pixels candidate mask")
    rows = {r.frame: r for r in images.compared(images.with_before(frames)).collect()}
    assert rows[0].temporal_delta is None and rows[0].mask_ssim is None and rows[0].ssim == pytest.approx(1)
    assert rows[1].temporal_delta == pytest.approx(rows[1].mae) and rows[2].temporal_delta == 0 and rows[3].temporal_delta == pytest.approx(rows[1].mae)
    assert rows[1].ssim > rows[1].mask_ssim and rows[1].mask_mae == 100 and rows[1].outside_mae == 0 and rows[1].edge_pixels > 0
    got = quality.report(images.compared(images.with_before(frames))).first()
    assert (got.frames, got.mask_frames, got.worst_frame, got.worst_mask_frame) == (4, 3, 1, 1)
    assert got.min_ssim == rows[1].ssim and got.min_mask_ssim == rows[1].mask_ssim and got.mse == pytest.approx(np.mean([rows[i].mse for i in range(4)]))
    # what isn't asked for isn't computed
    assert images.compared(frames, ("mae",)).columns[-1] == "mae" and "ssim" not in images.compared(frames, ("mae",)).columns


# --- digests ------------------------------------------------------------------------------------------------------


def test_sequences_that_differ_are_told_where(spark):
    rows = [(c, f, bytearray(b"%d" % (f * 7 % 5))) for c in range(8) for f in range(12)]
    left = digests.frame_digests(spark.createDataFrame(rows, "clip long, frame long, pixels binary").repartition(4))
    other = [(c, f, bytearray(b"%d" % (f * 7 % 5))) for c in range(8) for f in range(12)]
    change = {1: lambda r: [x for x in r if x[1] != 5], 2: lambda r: [(c, {3: 4, 4: 3}.get(f, f), p) for c, f, p in r], 3: lambda r: [(c, f, bytearray(b"!") if f == 11 else p) for c, f, p in r], 4: lambda r: [*r, r[2]], 5: lambda r: r[:-1], 6: lambda r: []}
    rows = [x for c in range(8) for x in change.get(c, lambda r: r)([r for r in other if r[0] == c])]
    right = digests.frame_digests(spark.createDataFrame(rows, "clip long, frame long, pixels binary").repartition(3))
    got = {r.clip: (r.frames, r.other_frames, r.equal, r.first_difference) for r in digests.compared_sequences(left, right).collect()}
    assert got == {0: (12, 12, True, None), 1: (12, 11, False, 5), 2: (12, 12, False, 3), 3: (12, 12, False, 11), 4: (12, 13, False, 2), 5: (12, 11, False, 11), 6: (12, 0, False, 0), 7: (12, 12, True, None)}
    cut = right.where("clip = 0 AND frame >= 4").withColumn("frame", F.col("frame") - 4)
    assert [(r.frames, r.equal) for r in digests.compared_sequences(left.where("clip = 0"), cut, 4).collect()] == [(8, True)]
