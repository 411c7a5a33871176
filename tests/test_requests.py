"""Profiles, calibrations, masks and scenes: what is refused, and odd values."""

import json

import pytest
from pyspark.sql import functions as F

from framelode.operators import requests as rq

GOOD = (1, "H264", "30000/1001", "tt", "N/A", "", "N/A")
NAMES = "id int, codec_name string, fps_fraction string, field_order string, bit_rate string, pix_fmt string, color_space string"


def test_profiles_are_normalised(spark):
    rows = [GOOD, (2, "prores", "50/2", None, "7", "yuv422p", "bt709"), (3, "h264", "25", "bb", None, None, None)]
    got = [tuple(r) for r in rq.encoding_profiles(spark.createDataFrame(rows, NAMES)).orderBy("id").collect()]
    assert got == [(1, "libx264", "30000/1001", "top_field_first", "10000000", "yuv420p", None), (2, "prores_ks", "25/1", "progressive", "7", "yuv422p", "bt709"), (3, "libx264", "25/1", "bottom_field_first", "10000000", "yuv420p", None)]


@pytest.mark.parametrize(("place", "value", "message"), [(1, "vp9", "unsupported source codec: vp9"), (1, None, "unsupported source codec: null"), (2, "0/1", "invalid rational frame rate: 0/1"), (2, "1/0", "invalid rational"), (2, "24.5", "invalid rational"), (2, "1/2/3", "invalid rational"), (2, None, "invalid rational"), (3, "sideways", "unsupported field_order: sideways")])
def test_profiles_that_are_refused(spark, place, value, message):
    row = [*GOOD]
    row[place] = value
    with pytest.raises(Exception, match=message):
        rq.encoding_profiles(spark.createDataFrame([tuple(row)], NAMES)).collect()


def calibration(**change):
    return {"completed": True, "holdout": True, "layers": [{"block": i, "scale": 0.5 + i} for i in range(3)]} | change


def test_calibrations_are_checked(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(calibration(), indent=2))
    assert sorted((r.block, r.scale) for r in rq.calibrations(spark, str(tmp_path / "a.json"), 3).collect()) == [(0, 0.5), (1, 1.5), (2, 2.5)]
    layers = calibration()["layers"]
    bad = [{"completed": False}, {"holdout": None}, {"layers": layers[:2]}, {"layers": [layers[1], layers[0], layers[2]]}, {"layers": [*layers[:2], {"block": 2, "scale": 0.0}]}, {"layers": [*layers[:2], {"block": 2, "scale": None}]}, {"layers": None}]
    for i, change in enumerate(bad):
        (tmp_path / f"b{i}.json").write_text(json.dumps(calibration(**change)))
        with pytest.raises(Exception, match="invalid calibration"):
            rq.calibrations(spark, str(tmp_path / f"b{i}.json"), 3).collect()


def test_static_masks_of_another_size_raise(spark):
    clips = spark.createDataFrame([(1, 3, 1, 2), (2, 1, 1, 1)], "clip int, num_frames long, height int, width int")
    pixels = spark.createDataFrame([(1, 1, 2, 0, 0, 200, 255), (1, 1, 2, 0, 1, 255, 128), (2, 1, 1, 0, 0, 9, 0)], "clip int, height int, width int, y int, x int, value int, alpha int")
    got = sorted((r.clip, r.frame, r.x, r.mask) for r in rq.static_masks(pixels, clips).collect())
    assert got == [(1, f, x, m) for f in range(3) for x, m in ((0, 200), (1, 128))] + [(2, 0, 0, 0)]
    with pytest.raises(Exception, match="mask of clip 2 has another size"):
        rq.static_masks(pixels, clips.withColumn("width", F.when(F.col("clip") == 2, 5).otherwise(F.col("width")))).collect()


def test_masks_are_held_and_scenes_picked(spark):
    rows = [(1, 0, 0.0), (1, 1, 9.0), (2, 0, -1.0), (2, 1, 0.0), (2, 2, 0.0)]
    held = rq.held_masks(spark.createDataFrame(rows, "clip int, frame long, value double"), 3, 0.5)
    assert sorted(map(tuple, held.collect())) == [(1, 0, 0), (1, 1, 255), (1, 2, 255), (2, 0, 0), (2, 1, 0), (2, 2, 0)]
    odd = [(1, f, float(f)) for f in range(9)] + [(2, -3, 1.0), (2, -2, 9.0), (None, 0, 1.0), (3, 0, 4.0), (3, 2, 1.0), (3, None, 9.0)]
    held = rq.held_masks(spark.createDataFrame(odd, "clip int, frame long, value double"), 4, 0.25)
    assert sorted(map(tuple, held.collect())) == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 255)] + [(2, p, 255) for p in range(4)] + [(3, 0, 255), (3, 2, 0), (3, 3, 0)]
    # frames were built twice and joined with their places
    assert "Join" not in held._jdf.queryExecution().executedPlan().toString()
    schema = "request int, objects int, scenes array<array<struct<start:long,length:long>>>"
    requests = spark.createDataFrame([(1, 3, [[(0, 5)], [(7, 2), (9, 1)]]), (2, 2, None), (3, 1, []), (4, 2, [None, [(1, 1)]])], schema)
    assert sorted(map(tuple, rq.scenes_of_objects(requests).collect())) == [(1, 0, 0, 5), (1, 1, 7, 2), (1, 1, 9, 1), (1, 2, 7, 2), (1, 2, 9, 1), (4, 1, 1, 1)]
