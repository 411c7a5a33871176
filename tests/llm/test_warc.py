import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from framelode.llm import warc
from framelode.llm.shared import shared_folder


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted(((r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()))
    first, want = {}, []
    for page, body in rows:
        head = first.setdefault(body, page)
        want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if head == page else "revisit", None if head == page else head))
    assert sorted(map(tuple, warc.op7_warc(spark, sf).collect())) == want


def pages(spark):
    rows = [(i, f"http://h/{i}\r\nX: y", "é<p>" * (i % 7 * 300)) for i in range(400)] + [(900, None, None)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)


@pytest.mark.parametrize("split", [64, 999, 20_000, 1 << 24])
def test_every_split_reads_every_record_once(spark, split):
    source = pages(spark)
    archives = warc.write_warc(source, shared_folder(spark, "t")).cache()
    got = warc.read_warc(spark, archives, split).collect()
    assert len(got) == 401 and len({r.record_id for r in got}) == 401
    want = {r.page_id: (r.html or "").encode() for r in source.collect()}
    for r in got:
        assert r.payload_bytes == len(want[r.record_id]) and r.payload_digest == warc.payload_digest(want[r.record_id])
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) == want[r.record_id])
        assert "\r" not in (r.target_uri or "")
    assert sum(r.record_type == "response" for r in got) == 7
    assert {r.refers_to for r in got if r.record_type == "revisit"} == set(range(7))


def test_small_payloads_can_stay_whole(spark):
    archives = warc.write_warc(pages(spark), shared_folder(spark, "t"), min_bytes=1)
    got = warc.read_warc(spark, archives)
    assert got.where("payload_bytes = 0 AND record_type <> 'response'").count() == 0


def test_members_that_hold_the_magic_are_not_taken_for_records(spark, tmp_path):
    inner = warc.member(warc.record_bytes(7, "http://inner", b"in", None))
    record = warc.record_bytes(1, "http://outer", inner * 3, None)
    path = tmp_path / "a.warc.gz"
    stored = gzip.compress(record, 0)  # stored blocks: the inner members are there to be seen
    path.write_bytes(stored + warc.member(warc.record_bytes(2, "http://b", b"x", None)))
    archives = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long")
    assert sorted(r.record_id for r in warc.read_warc(spark, archives, 1 << 20).collect()) == [1, 2]


def test_repeated_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(5, "u", "a"), (5, "u", "a"), (6, "u", "a"), (None, "u", "a")], "page_id long, url string, html string")
    got = warc.read_warc(spark, warc.write_warc(rows, shared_folder(spark, "t"))).select("record_id", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=repr) == [(5, "response", None), (5, "response", None), (6, "revisit", 5)]
    assert warc.read_warc(spark, warc.write_warc(rows.limit(0), shared_folder(spark, "t"))).count() == 0


def test_damaged_archives_raise(spark, tmp_path):
    raw = b"".join(warc.member(warc.record_bytes(i, "u", b"x" * 50, None)) for i in range(3))
    path = tmp_path / "b.warc.gz"
    path.write_bytes(raw[: len(raw) * 2 // 3] + b"\0" * 20 + raw[len(raw) * 2 // 3 :])
    archives = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long")
    with pytest.raises(Exception, match="no WARC record"):
        warc.read_warc(spark, archives).agg(F.count("*")).collect()


def test_ranges_are_read_by_many_tasks(spark):
    archives = warc.write_warc(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), shared_folder(spark, "warc"))
    out = warc.read_warc(spark, archives, 4000)
    ranges = sum(-(-r.bytes // 4000) for r in archives.collect())
    assert ranges > 8 and out.rdd.getNumPartitions() == min(ranges, warc.READERS * spark.sparkContext.defaultParallelism)
    readers = out.select(F.spark_partition_id().alias("task")).distinct().count()
    assert readers > 4
