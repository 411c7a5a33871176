"""Resampling towards a target distribution: hashed n-gram weights, Gumbel scores, an exact integer-score histogram.

A document's features are hashed into buckets; a bucket's gain is the log ratio of its smoothed shares in target and
source. The gains are one array that scores each document's buckets. Adding Gumbel noise to the weight and taking the
highest scores draws without replacement with probabilities that follow the weights. Scores are integers within a range
that doesn't grow with the corpus, so their histogram is small: counts summed from the top give every score the rank
its first document has, and the score at which the draw ends. Only documents at or above it are numbered, each score on
its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontamination import words_of
from .shared import written

#: Equal rows that are numbered from one array.
RUN = 4096


def feature_buckets(rows: DataFrame, text: str, buckets: int, longest: int) -> DataFrame:
    """rows with n_words and buckets (array<short or int>), the crc32 bucket of every run of 1 to longest words."""
    words = rows.withColumn("_words", words_of(F.col(text)))
    # runs of n words are those of n - 1 words, each followed by one word more
    runs = {1: "_words"}
    for n in range(2, longest + 1):
        runs[n] = f"_runs{n}"
        words = words.withColumn(runs[n], F.expr(f"zip_with(slice({runs[n - 1]}, 1, greatest(size(_words) - {n - 1}, 0)), slice(_words, {n}, greatest(size(_words) - {n - 1}, 0)), (a, b) -> concat(a, ' ', b))"))
    kind = "short" if buckets <= 2**15 else "int"
    hashed = [F.expr(f"transform({name}, x -> CAST(crc32(CAST(x AS binary)) % {buckets} AS {kind}))") for name in runs.values()]
    return words.withColumn("n_words", F.size("_words")).withColumn("buckets", F.concat(*hashed)).drop("_words", *[x for x in runs.values() if x != "_words"])


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: an array of as many numbers as buckets, whatever the rows."""
    out = np.zeros(buckets, np.int64)
    for r in rows.select(F.explode("buckets").alias("b")).groupBy("b").count().collect():
        out[r["b"]] = r["count"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the smoothed source share) for each bucket."""
    b, t, s = len(target), target.astype(np.float64), source.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def _weighed(gain: np.ndarray):
    def weigh(batches):
        for batch in batches:
            lists = batch.column("buckets")
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.r_[0, np.cumsum(gain[lists.flatten().to_numpy()])]
            ends = np.cumsum(size)
            weight = (total[ends] - total[ends - size]) // np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(size), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return weigh


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: str = "7", id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Draws floor(percent * N / 100) of the N documents with at least min_words words, weighted towards target.

    Returns a row for each row of docs: doc_id, n_features (runs of 1 to longest words, repeats counted), weight (the
    floored mean gain of their buckets, 0 without features), score (weight plus the floored Gumbel noise of the id) and
    rank (from 1 in order of score, then doc_id; null where not drawn). Null and empty texts have no features. Rows with
    a null id take the noise of the empty id and come after all ids of their score. Rows that repeat an id are documents
    of their own; with equal scores those with fewer features come first. Without target texts every target count is 0.
    Other columns aren't looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    read = written(feature_buckets(rows, "_text", buckets, longest).select("doc_id", "n_words", "buckets"), "features")
    aim = feature_buckets(target.select(F.col(target_text_col).cast("string").alias("_text")), "_text", buckets, longest)
    gain = gains(bucket_counts(aim, buckets), bucket_counts(read, buckets))
    scored = read.mapInArrow(_weighed(gain), "doc_id long, n_words int, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(scored.withColumn("score", F.col("weight") + noise), "scores")

    # at most a row for each integer between the lowest and the highest score
    able = scored.where(F.col("n_words") >= min_words)
    histogram = able.groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = histogram.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    offsets = written(offsets.withColumn("draw", F.floor(F.col("all") * percent / 100)).where("before < draw"), "offsets")
    cutoff = offsets.agg(F.min("score").alias("s")).first().s

    # equal rows are one with a count, so that no score gathers the copies of an id
    key = ["doc_id", "n_features", "weight", "score"]
    drawn = able.where(F.col("score") >= F.lit(cutoff)) if cutoff is not None else able.limit(0)
    folded = drawn.groupBy(*key).agg(F.count("*").alias("copies"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    earlier = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = folded.withColumn("earlier", earlier).join(F.broadcast(offsets), "score").withColumn("first", F.col("before") + F.col("earlier"))
    runs = placed.withColumn("run", F.explode(F.expr(f"sequence(CAST(0 AS bigint), (copies - 1) div {RUN})")))
    each = runs.select(*key, "first", "draw", F.explode(F.expr(f"sequence(run * {RUN} + 1, least(copies, (run + 1) * {RUN}))")).alias("copy"))
    place = F.col("first") + F.col("copy")
    ranked = each.select(*key, F.when(place <= F.col("draw"), place).alias("rank"))
    low = scored.where((F.col("n_words") < min_words) | (F.col("score") < F.lit(cutoff))) if cutoff is not None else scored
    return low.select(*key, F.lit(None).cast("long").alias("rank")).unionByName(ranked)


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of all documents, 25 % drawn towards the benchmark."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: crc32 of a feature's bytes in SQL: the table of the reversed polynomial 0xEDB88320, folded over the bytes.
OP13_SQL = r"""
WITH RECURSIVE tab(i, step, v) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) r(i)
  UNION ALL SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM tab WHERE step < 8
), crc AS (
  SELECT list(v ORDER BY i) AS t FROM tab WHERE step = 8
), texts AS (
  SELECT 'd' AS kind, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), w AS (
  SELECT kind, doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), f AS (
  SELECT kind, row_no, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM w
), u AS (
  SELECT feature, list_transform(range(0, CAST(strlen(feature) AS BIGINT)), lambda i: CAST(('0x' || hex(encode(feature))[2 * i + 1:2 * i + 2]) AS BIGINT)) AS bytes FROM (SELECT DISTINCT feature FROM f)
), h AS (
  SELECT feature, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket FROM u, crc
), fb AS (
  SELECT kind, row_no, bucket FROM f JOIN h USING (feature)
), n AS (
  SELECT bucket, CAST(count(*) FILTER (kind = 'd') AS DOUBLE) AS s, CAST(count(*) FILTER (kind = 'b') AS DOUBLE) AS t FROM fb GROUP BY bucket
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000)))) AS BIGINT) AS gain FROM n
), weights AS (
  SELECT row_no, count(*) AS n_features, CAST(floor(sum(gain) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight FROM fb JOIN g USING (bucket) WHERE kind = 'd' GROUP BY row_no
), scores AS (
  SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8]) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN weights USING (row_no) WHERE kind = 'd'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, (25 * count(*) FILTER (able) OVER ()) // 100 AS draw FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= draw THEN place END AS rank FROM ranked
"""
