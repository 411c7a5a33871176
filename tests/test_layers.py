"""What the queries over layers, plans and shards can't show: refused inputs and shapes."""

import pytest
from pyspark.sql import functions as F

from framelode.functions import arrays as ar
from framelode.functions import numbers as nb
from framelode.operators import images, masks, overlap, tasks
from framelode.plans import shards, taskplans

PLAN = "plan string, task_id long, rank long, cost long"


def test_broken_task_plans(spark):
    rows = [("fine", 0, 0, 5), ("fine", 1, 1, 5), ("fine", 2, 0, 5), ("twice", 0, 0, 5), ("twice", 0, 1, 5), ("gap", 0, 0, 5), ("gap", 2, 0, 5), ("rank", 0, -1, 5), ("cost", 0, 0, 0)]
    rows += [("squares", i, 0, 5) for i in (0, 1, 1, 4, 4)]  # the sum of 0..4, but other numbers
    got = {r.plan: (r.tasks, r.rounds, r.fine) for r in taskplans.validated(spark.createDataFrame(rows, PLAN)).collect()}
    assert got["fine"] == (3, 2, True) and not any(got[p][2] for p in got if p != "fine")
    bad = spark.createDataFrame([("a", [2, 0, 0]), ("b", [1, 1, 1])], "plan string, values array<long>")
    for plan in ("a", "b"):
        with pytest.raises(Exception, match="no task plan"):
            taskplans.decoded(bad.where(F.col("plan") == plan)).collect()


@pytest.mark.parametrize("text, fault", [("0=1;1=x", "invalid CPU"), ("0=1", "missing"), ("0=1;1=1", "two ranks"), ("0=1;1=2;7=3", "outside")])
def test_refused_cpu_maps(spark, text, fault):
    rows = spark.createDataFrame([(1, text)], "id long, text string")
    with pytest.raises(Exception, match=fault):
        shards.cpu_map(rows, 2).collect()


def test_boxes_too_large_and_scaled(spark):
    box = lambda *b: spark.createDataFrame([(0, 0, *b)], "object long, frame long, x long, y long, w long, h long")
    with pytest.raises(Exception, match="exceeds"):
        masks.aligned_boxes(box(0, 0, 500, 500), 640, 360, 32, max_pixels=1000).collect()
    with pytest.raises(ValueError):
        masks.aligned_boxes(box(0, 0, 5, 5), 640, 360, 32, ratio=0.5)
    # 40 x 20 needs 64 x 64 for 4096 pixels; scaled by sqrt(4096 / 800) it is 91 x 46, aligned 96 x 64, shrunk 64 x 64
    r = masks.aligned_boxes(box(100, 100, 40, 20), 640, 360, 32, 4096).first()
    assert (r.bx, r.by, r.bw, r.bh) == (88, 78, 64, 64)
    assert masks.aligned_boxes(box(0, 0, 0, 5), 640, 360, 32).collect() == []


def test_patches_outside_the_frame(spark):
    rows = spark.createDataFrame([(0, 2, 2, bytearray(4), bytearray(4), 2, 2)], "frame long, height int, width int, pixels binary, candidate binary, patch_height int, patch_width int")
    with pytest.raises(Exception, match="exceeds frame"):
        images.spliced(rows, 1, 0).collect()


def test_seams_of_a_first_tile_and_of_wide_extents(spark):
    rows = spark.createDataFrame([(t, y, 10.0 * t) for t in (0, 1) for y in range(4)], "tile long, y long, value double")
    got = {(r.tile, r.y): r.value for r in overlap.seamed(rows, "y", [], 4, 9).collect()}
    assert [got[0, y] for y in range(4)] == [0.0] * 4 and [got[1, y] for y in range(4)] == [0.0, 2.5, 5.0, 7.5]


def test_small_columns(spark):
    one = spark.range(1)
    assert one.select(nb.picked(F.array(), F.lit(3)), nb.picked(F.array(F.lit(1)), F.lit(3))).first()[:] == (None, 1)
    assert one.select(nb.guidance_scale(F.lit(20), 4.0), nb.guidance_scale(F.lit(3), 4.0, dynamic=False)).first()[:] == (1.0, 4.0)
    assert one.select(nb.flow_sigma(F.lit(0), F.lit(1)), nb.flow_sigma(F.lit(1), F.lit(1))).first()[:] == (1.0, 0.0)
    assert one.select(nb.numbered_name(F.lit("a.b/c"), F.lit(2), F.lit(0)), nb.numbered_name(F.lit("a.mp4"), F.lit(1), F.lit(0))).first()[:] == ("a.b/c_0", "a.mp4")
    assert one.select(ar.bytes_of(F.array(F.lit(258).cast("long"), F.lit(-1).cast("long")))).first()[0] == b"\x02\x01" + bytes(6) + b"\xff" * 8
    with pytest.raises(Exception, match="unsupported degree"):
        one.select(nb.spatial_alignment(F.lit(3))).collect()
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y")], "k string, seq long, state string")
    assert [tuple(r) for r in tasks.upserted(rows, ["k"]).collect()] == [("a", 2, "x")]
