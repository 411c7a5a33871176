"""The pipeline on documents with planted cases, and each stage against what it should decide."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from framelode.llm.shared import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The smoke tables with documents from 10,000 on: a copy, a near copy, a leak, a repeated passage, a clean one."""
    root = tmp_path_factory.mktemp("sf")
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", root / f"{t}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = [r.doc_id for r in cp.quality(spark, docs, SF).collect()]
    base = docs.where(F.col("doc_id").isin(good) & (F.length("text") > 1500)).orderBy("doc_id").first()
    words = base.text.split()
    rng = random.Random(6)
    fresh = lambda n: " ".join(rng.sample(words, min(n, len(words))))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    passage = fresh(70)
    near = list(words)
    near[len(near) // 2] = "zzz"
    rows = [(10_000, base.text), (10_001, " ".join(near)), (10_002, fresh(80) + ". " + item + " " + fresh(80)), (10_003, fresh(90) + " " + passage + " " + fresh(90)), (10_004, fresh(95) + " " + passage + " " + fresh(85)), (10_005, fresh(120))]
    extra = spark.createDataFrame([(i, t, base.lang, "planted", len(t)) for i, t in rows], docs.schema)
    docs.unionByName(extra).coalesce(2).write.parquet(str(root / "documents.parquet"))
    return str(root), passage


def test_planted_cases_are_caught_and_clean_ones_kept(spark, planted):
    sf, passage = planted
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf), name)
        found[name] = {r.doc_id: r.text for r in docs.where("doc_id >= 10000").collect()}
        if name != "mixture":
            assert docs.columns == before.columns
    assert set(found["quality"]) == set(range(10_000, 10_006))
    assert set(found["near_duplicates"]) == {10_002, 10_003, 10_004, 10_005}
    once, twice = found["repeated_passages"][10_003], found["repeated_passages"][10_004]
    assert passage in once and passage not in twice and len(twice.split()) >= 170
    assert set(found["benchmark_passages"]) == {10_003, 10_004, 10_005}
    assert set(found["mixture"]) <= {10_003, 10_004, 10_005}


def test_run_gives_the_last_stage(spark, planted):
    sf, _ = planted
    out = cp.run(spark, sf)
    assert {"doc_id", "text", "mix_epoch"} <= set(out.columns) and out.count() > 100


def test_run_leaves_nothing_but_what_the_stages_returned(spark, planted):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.iterdir())
    rows = cp.run(spark, planted[0]).count()
    assert rows and sorted(p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before) == sorted(name for name, _ in cp.STAGES)


def test_stages_leave_clean_texts_to_the_byte(spark):
    docs = spark.createDataFrame([(1, " a\tb \n c ", "en", "s", 9), (2, None, None, None, None), (None, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, cp.repeated_passages(spark, docs, SF).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    assert sorted(map(tuple, cp.near_duplicates(spark, docs, SF).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    assert cp.benchmark_passages(spark, docs, SF).count() == 3


CLASHES = ("score", "_id", "_row", "_kept", "kept", "c0", "tokens", "budget", "rest", "blocks", "epochs", "_source", "_copies", "h", "n", "key", "size", "count")


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
@pytest.mark.parametrize("shared", [False, True])
def test_stages_keep_columns_with_clashing_names_null_texts_and_repeated_rows(spark, name, shared):
    """Each extra column has the value that its row came with; the text of one row is unlike every other's."""
    fresh = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) BETWEEN 300 AND 3000").orderBy("doc_id").limit(6).collect()
    rows = [(r.doc_id, r.text) for r in fresh] + [(10**6, None), (10**6 + 1, "")]
    rows += [(rows[0][0], rows[0][1]), (None, None)] if shared else []
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHES})
    out = dict(cp.STAGES)[name](spark, docs, SF)
    assert [c for c in out.columns if not c.startswith("mix_")] == docs.columns
    found = out.collect()
    assert all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for r in found for c in CLASHES)
    ids = [r.doc_id for r in found]
    if name in ("near_duplicates", "repeated_passages"):
        assert {10**6, 10**6 + 1} <= set(ids) and (None in ids) == shared
    if name == "repeated_passages":
        assert len(ids) == len(rows) and {r.text for r in found if r.doc_id == 10**6} == {None}
    if name == "near_duplicates":
        assert ids.count(rows[0][0]) == 1
    if name == "quality":
        # the share of label 1 among the labels
        assert {10**6, 10**6 + 1} <= set(ids) and ids.count(rows[0][0]) in (0, 2 if shared else 1)


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_every_stage_takes_an_empty_table(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(cp.STAGES)[name](spark, docs, SF).collect() == []


def test_rows_that_share_an_id_or_have_none_are_judged_each(spark):
    rng = random.Random(8)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    own, passage, copy = fresh(60), fresh(70), fresh(90)
    rows = [(1, fresh(50) + " " + passage), (1, own), (2, passage + " " + fresh(40)), (None, fresh(30) + " " + item), (None, copy), (None, copy), (3, fresh(40))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    cut = sorted(r.text for r in cp.repeated_passages(spark, docs.where("doc_id IS NOT NULL"), SF).collect())
    assert len(cut) == 4 and own in cut and sum(passage in t for t in cut) == 1
    kept = [r.text for r in cp.near_duplicates(spark, docs, SF).collect()]
    assert sorted(kept) == sorted({t for _, t in rows})
    clean = [r.text for r in cp.benchmark_passages(spark, docs, SF).collect()]
    assert sorted(clean) == sorted(t for _, t in rows if item not in t)
