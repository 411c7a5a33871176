"""Chains of objects against one window after the other on whole clips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelode.operators import objects
from framelode.plans import windows
from framelode.streaming.carried import ramp_values

H, W = 3, 4


def edit(pixels, window_index, name):
    return pixels * 0.5 + window_index + (7 if name == "b" else 3)


def by_hand(pixels, mask, boxes, plan, names, mode):
    """One clip: frames x H x W arrays; boxes name -> {frame: (x1, y1, x2, y2)}."""
    pixels, mask, ranges = pixels.copy(), mask.copy(), []
    for name in names:
        out, carry, changed = pixels.copy(), {}, np.zeros(len(pixels), bool)
        live = []
        for w in plan:
            end = w.deal_start + w.deal_length
            stable = end - w.overlap_right
            mine = [boxes[name][f] for f in range(w.deal_start, end) if f in boxes[name]]
            box = (min(b[0] for b in mine), min(b[1] for b in mine), max(b[2] for b in mine), max(b[3] for b in mine)) if mine else None
            if box is None or not mask[w.deal_start : end, box[1] : box[3], box[0] : box[2]].any():
                out[w.load_start : stable] = pixels[w.load_start : stable]
                changed[w.load_start : stable] = False
                carry = {f: pixels[f] for f in range(stable, end)}
                continue
            live.append((w, box))
            src = np.array([carry[f] if f in carry and f < w.load_start + w.overlap_left else pixels[f] for f in range(w.load_start, w.load_end)])
            new = src.copy()
            part = (slice(None), slice(box[1], box[3]), slice(box[0], box[2]))
            new[part] = edit(src, w.window_index, name)[part]
            share = ramp_values(w.overlap_left, mode)[:, None, None]
            new[: w.overlap_left] = share * src[: w.overlap_left] + (1 - share) * new[: w.overlap_left]
            out[w.load_start : stable] = new[: stable - w.load_start]
            changed[w.load_start : stable] = True
            carry = {f: new[f - w.load_start] for f in range(stable, end)}
        for w, box in live:
            mask[w.deal_start : w.deal_start + w.deal_length, box[1] : box[3], box[0] : box[2]] = 0
        pixels = out
        cut = [0, *(np.flatnonzero(changed[1:] != changed[:-1]) + 1).tolist(), len(changed)]
        ranges += [(name, a, b, bool(changed[a])) for a, b in zip(cut, cut[1:], strict=False)]
    return pixels, mask, ranges


@pytest.fixture(scope="module")
def chain(spark):
    rng = np.random.default_rng(4)
    clips = [(1, 30), (2, 17), (3, 4)]
    scenes = spark.createDataFrame([(c, n, s, ln) for c, n in clips for s, ln in ((0, 12), (14, 99))], "clip long, num_frames long, start long, length long")
    plan = windows.window_plan(windows.normalized_scenes(scenes), 7, 2)
    data, rows, boxes = {}, [], []
    for c, n in clips:
        pixels, mask = rng.uniform(0, 9, (n, H, W)).round(1), (rng.random((n, H, W)) < 0.15).astype(float)
        own = {name: {f: (x := int(rng.integers(0, W)), y := int(rng.integers(0, H)), int(rng.integers(x + 1, W + 1)), int(rng.integers(y + 1, H + 1))) for f in range(n) if rng.random() < 0.3} for name in ("a", "b", "c")}
        own["c"] = {}
        data[c] = pixels, mask, own
        rows += [(c, f, H, W, pixels[f].ravel().tolist(), mask[f].ravel().tolist()) for f in range(n)]
        boxes += [(name, c, f, *b) for name, of in own.items() for f, b in of.items()]
    frames = spark.createDataFrame(rows, "clip long, frame long, height int, width int, pixels array<double>, mask array<double>").repartition(3)
    return data, frames, spark.createDataFrame(boxes, "object string, clip long, frame long, x1 long, y1 long, x2 long, y2 long"), plan


def test_each_object_takes_what_the_one_before_gave(chain, tmp_path):
    data, frames, boxes, plan = chain
    out, ranges = objects.chained(frames, boxes, plan, ["a", "b", "c", "a"], edit, str(tmp_path), "linear")
    got = {(r.clip, r.frame): r for r in out.collect()}
    assert len(got) == 51
    told = {}
    for r in ranges.orderBy("clip", "version").collect():
        told.setdefault(r.clip, []).append((r.object, r.start, r.end, r.changed))
    for c, (pixels, mask, own) in data.items():
        mine = plan.where(F.col("clip") == c).orderBy("window_index").collect()
        p, m, spans = by_hand(pixels, mask, own, mine, ["a", "b", "c", "a"], "linear")
        for f in range(len(p)):
            assert np.allclose(got[c, f].pixels, p[f].ravel()) and np.allclose(got[c, f].mask, m[f].ravel())
        assert sorted(told[c]) == sorted(spans)


def test_a_hole_in_what_is_passed_on_raises(chain, tmp_path):
    _, frames, boxes, plan = chain
    out, ranges = objects.chained(frames.where("clip <> 2 OR frame <> 13"), boxes, plan, ["a"], edit, str(tmp_path))
    with pytest.raises(Exception, match="contiguous write at 13"):
        ranges.collect()
