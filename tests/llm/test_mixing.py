import pytest
from pyspark.sql import functions as F

from framelode.llm import mixing as mx
from tests.oracle import check


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    check(spark, f"/root/testdata/{sf}", mx.op2_mixing, mx.OP2_SQL)


def corpus(spark):
    rows = [(i, "w " * (i % 13), "big" if i % 3 else f"s{i % 12}") for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_budgets_are_kept_and_passes_are_whole(spark):
    docs = corpus(spark)
    out = mx.mixture(docs, budget=40_000, block_tokens=200).cache()
    total = docs.agg(F.sum(mx.n_tokens(F.col("text")))).first()[0]
    own = {r.source: (r.n, r.t) for r in docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(mx.n_tokens(F.col("text"))).alias("t")).collect()}
    weights = {r.source: r.mix_weight for r in out.select("source", "mix_weight").distinct().collect()}
    assert abs(sum(weights.values()) - 1) < 1e-9 and weights["big"] < own["big"][1] / total
    used = {r.source: r.t for r in out.groupBy("source").agg(F.sum("mix_tokens").alias("t")).collect()}
    for s, t in used.items():
        budget = int(weights[s] * 40_000)
        assert budget - 12 <= t <= budget
    passes = {(r.source, r.mix_epoch): r.n for r in out.groupBy("source", "mix_epoch").agg(F.count("*").alias("n")).collect()}
    for (s, e), n in passes.items():
        assert n == own[s][0] or (s, e + 1) not in passes


def test_repetition_limit_wins_over_entropy(spark):
    rows = [(i, "w " * 10, "big" if i < 990 else "small") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mx.mixture(docs, entropy=1.0, repeats=3.0)
    assert out.where("source = 'small'").agg(F.max("mix_epoch")).first()[0] <= 2
    free = mx.mixture(docs, entropy=1.0, repeats=1e9)
    weights = {r.source: r.mix_weight for r in free.select("source", "mix_weight").distinct().collect()}
    assert abs(weights["small"] - 0.5) < 1e-3


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, None, 5), (2, "", "a", 5), (3, "b c", None, 5), (None, "d", "a", 5), (None, "d", "a", 5), (4, "x " * 50000, "a", 5)], "doc_id long, text string, source string, mix_epoch int")
    out = mx.mixture(docs).collect()
    assert {r.doc_id for r in out} <= {1, 2, 3, 4, None} and all(isinstance(r.mix_epoch, int) for r in out)
    assert mx.mixture(docs.limit(0)).collect() == []
    assert mx.mixture(docs.where("doc_id = 2")).collect() == []


def test_sources_that_meet_the_target_stay_whole(spark):
    rows = [(i, "w " * (1 + i % 13), f"s{i % 7}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mx.mixture(docs, natural=True)
    assert sorted((r.doc_id, r.mix_epoch) for r in out.collect()) == [(i, 0) for i in range(700)]
    total = docs.agg(F.sum(mx.n_tokens(F.col("text")))).first()[0]
    twice = mx.mixture(docs, natural=True, budget=2 * total)
    assert sorted((r.doc_id, r.mix_epoch) for r in twice.collect()) == sorted((i, e) for i in range(700) for e in (0, 1))
    # one that doesn't meet it is mixed as before
    skewed = corpus(spark)
    key = lambda df: sorted((r.doc_id, r.mix_epoch, r.mix_key) for r in df.collect())
    assert key(mx.mixture(skewed, natural=True)) == key(mx.mixture(skewed))
