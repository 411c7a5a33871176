import hashlib
import json

import pytest
from pyspark.sql import functions as F

from framelode import catalog, catalog_media  # noqa: F401
from framelode.sources import rawframes, texts
from framelode.streaming import frames as streams


def write_frames(path, n, size=48):
    path.write_bytes(b"".join(bytes((i * 3 + k) % 256 for k in range(size)) for i in range(n)))


def test_raw_frames_are_read_in_parts(spark, tmp_path, monkeypatch):
    rawframes.register(spark)
    write_frames(tmp_path / "a.rgb", 17)
    read = spark.read.format("rawframes").options(width=4, height=4, channels=3)
    got = {r.frame_index: bytes(r.pixels) for r in read.load(str(tmp_path / "a.rgb")).collect()}
    assert len(got) == 17 and got[5] == bytes((15 + k) % 256 for k in range(48))
    red = read.option("channels_kept", 0).load(str(tmp_path)).where("frame_index = 2").first()
    assert red.channels == 1 and bytes(red.pixels) == bytes((6 + k) % 256 for k in range(0, 48, 3))


def test_short_frame_files_raise(spark, tmp_path):
    rawframes.register(spark)
    (tmp_path / "b.rgb").write_bytes(b"x" * 50)
    with pytest.raises(Exception, match="not a multiple"):
        spark.read.format("rawframes").options(width=4, height=4, channels=3).load(str(tmp_path / "b.rgb")).count()


def test_raw_frames_round_trip(spark, tmp_path):
    rawframes.register(spark)
    write_frames(tmp_path / "c.rgb", 9)
    options = {"width": 4, "height": 4, "channels": 3}
    frames = spark.read.format("rawframes").options(**options).load(str(tmp_path / "c.rgb"))
    frames.orderBy("frame_index").coalesce(1).write.format("rawframes").mode("append").save(str(tmp_path / "out"))
    again = spark.read.format("rawframes").options(**options).load(str(tmp_path / "out"))
    key = lambda df: [(r.frame_index, bytes(r.pixels)) for r in df.orderBy("frame_index").collect()]
    assert key(frames) == key(again)


def test_tracks_from_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('frame,bboxes\n0,"[[1,2,3,4],[0,0,5,5]]"\n2,"[[2,2,3,4],[1,0,5,5]]"\n')
    tracks = texts.csv_tracks(spark, str(tmp_path / "a.csv"))
    assert sorted(map(tuple, tracks.collect())) == [(0, 0, 1, 2, 4, 6), (0, 2, 2, 2, 5, 6), (1, 0, 0, 0, 5, 5), (1, 2, 1, 0, 6, 5)]
    whole = {(r.object, r.frame): r.x1 for r in texts.finished_tracks(tracks, 4).collect()}
    assert [whole[0, f] for f in range(4)] == [1, 1, 2, 2]
    (tmp_path / "b.csv").write_text("frame,x,y,w,h\n0,1.9,2,3,4\n")
    assert tuple(texts.csv_tracks(spark, str(tmp_path / "b.csv")).first()) == (0, 0, 1, 2, 4, 6)
    (tmp_path / "c.csv").write_text('frame,bboxes\n0,"[[1,2,3,4]]"\n1,"[]"\n')
    with pytest.raises(Exception, match="another number"):
        texts.csv_tracks(spark, str(tmp_path / "c.csv")).collect()


def test_reports_tasks_and_digests(spark, tmp_path):
    body = json.dumps({"tasks": [{"id": "a", "ms": 3}]}, indent=2)
    (tmp_path / "log.txt").write_text('noise\n{\n  "tasks": []}\nmore\n' + body)
    got = texts.report_tail(spark, str(tmp_path / "log.txt"), "tasks array<struct<id:string,ms:int>>").first()
    assert got.report.tasks[0].id == "a" and got.report.tasks[0].ms == 3
    (tmp_path / "t.json").write_text('[{"id": "x", "n": 1}, {"id": "y", "n": null}]')
    assert texts.tasks_json(spark, str(tmp_path / "t.json"), "id string, n int").count() == 2
    (tmp_path / "bad.json").write_text('[{"id": "x", "n": "five"}]')
    with pytest.raises(Exception):
        texts.tasks_json(spark, str(tmp_path / "bad.json"), "id string, n int").collect()
    assert len(texts.digests(spark, str(tmp_path / "t.json")).first().sha256) == 64


def test_overlays_and_arguments(spark):
    base = spark.createDataFrame([("c", i, float(i)) for i in range(4)], "clip string, frame long, value double")
    patch = spark.createDataFrame([("c", 2, 9.0)], "clip string, frame long, value double")
    assert [r.value for r in texts.overlaid(base, patch).orderBy("frame").collect()] == [0, 1, 9, 3]
    row = spark.createDataFrame([("h264", None, 3)], "codec string, profile string, crf int")
    assert texts.encoder_arguments(row, ["codec", "profile", "crf"]).first().arguments == ["-codec", "h264", "-crf", "3"]


def test_streams_give_the_batch_result_over_several_files(spark, tmp_path):
    for day in range(3):
        rows = spark.range(day * 10, day * 10 + 10).select(F.lit(1).cast("long").alias("clip"), F.timestamp_seconds(F.col("id") + 1_000_000).alias("ts"))
        rows.coalesce(1).write.parquet(str(tmp_path / "in" / f"d={day}"))
    stream = spark.readStream.schema("clip long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = streams.collected(streams.fired_windows(stream, 9, 2), str(tmp_path / "out"), "append")
    assert sorted((r.window_index, r.load_start, r.load_end, r.stable_end) for r in got.collect()) == [(i, i * 7, i * 7 + 9, i * 7 + 7) for i in range(4)]


def test_many_logs_of_a_file_and_many_files_of_a_pack(spark, tmp_path):
    report = 'a\n{\n  "tasks": 0}\nb\n{\n  "tasks": %s}'
    rows = spark.createDataFrame([(report % n,) for n in (1, 2, "null")] + [("no report",), (None,)], "value string")
    rows.repartition(2).write.option("lineSep", "\x1e").text(str(tmp_path / "logs"))
    got = texts.report_tail(spark, str(tmp_path / "logs"), "tasks long", "\x1e").collect()
    assert sorted((r.report.tasks for r in got), key=str) == [1, 2, None]
    odd = {"a": b"\x1e\n\x00\xff", "b": b"", "c": b"x\r\n"}
    spark.createDataFrame([(k, bytearray(v)) for k, v in odd.items()], "name string, content binary").coalesce(1).write.parquet(str(tmp_path / "pack"))
    assert {r.name: r.sha256 for r in texts.pack_digests(spark, str(tmp_path / "pack")).collect()} == {k: hashlib.sha256(v).hexdigest() for k, v in odd.items()}


@pytest.mark.parametrize("name", ["log_reports", "file_digests"])
def test_no_folder_for_each_key(spark, tmp_path, monkeypatch, name):
    events = spark.createDataFrame([(u, 0.5 * i) for u in (*range(30), None) for i in range(3)] + [(77, None)], "user_id long, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    turns = [(c, t, f"{c}\x1e\r\n{t}") for c in range(-3, 30) for t in range(3)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(catalog_media, "_folder", lambda spark, kind: str(tmp_path / kind))
    got = {r[0]: tuple(r)[1:] for r in getattr(catalog_media, name)(spark, str(tmp_path)).collect()}
    if name == "log_reports":
        assert got == {u: (3, 1.5) for u in (*range(30), None)} | {77: (1, None)}
    else:
        assert got == {c: (hashlib.sha256("\n".join(x for d, _, x in turns if d == c).encode() + b"\n").hexdigest(),) for c in range(-3, 30)}
    folder = tmp_path / ("logs" if name == "log_reports" else "files")
    assert not [p for p in folder.iterdir() if p.is_dir()]
