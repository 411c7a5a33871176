"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window of an item (`window` words, or the whole of a shorter item) is a set of five-word shingles that a document
must hold whole, so any one of them is a sufficient prefix. Shingles are ordered by rarity in the benchmark and the
rarest of each window is its prefix token. Documents are streamed once as rolling shingle hashes against those tokens;
the token's place in the window gives the only start that can match (positional bound), and the window must fit into
the document (length bound). What is left is compared word by word.

The token set is broadcast only if it has at most BROADCAST_TOKENS rows; beyond that Spark shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import one_text_each

SHINGLE = 5
#: 8 bytes a token: a broadcast of 16 MB at most.
BROADCAST_TOKENS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The candidates whose words are those of the phrase. The words are bound once, outside the filter: where the optimizer
#: puts their expression in place of the column, a text would otherwise be split anew for each word looked up.
HITS = """get(transform(array(words), w -> filter(coalesce(near, array()),
    x -> array_join(transform(sequence(0, x.size - 1), k -> get(w, x.start + k)), ' ') = x.phrase)), 0)"""


def words_of(text):
    """Words of a text column: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def _shingles(hashes: str, size: int):
    """The hash of each run of size words, from an array column of word hashes; one per start."""
    parts = ", ".join(f"get({hashes}, i + {k})" for k in range(size))
    return F.expr(f"CASE WHEN size({hashes}) >= {size} THEN transform(sequence(0, size({hashes}) - {size}), i -> xxhash64({parts})) ELSE array() END")


def benchmark_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(item_id, phrase, size): each window of each item, its words joined by one space."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where("item_id IS NOT NULL AND size(words) > 0")
    starts = F.expr(f"sequence(1, greatest(size(words) - {window} + 1, 1))")
    return items.select("item_id", "words", F.explode(starts).alias("s")).select("item_id", F.expr(f"array_join(transform(sequence(s - 1, least(s + {window} - 1, size(words)) - 1), k -> get(words, k)), ' ')").alias("phrase"), F.expr(f"least(size(words), {window})").alias("size")).distinct()


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Which words of each document stand in a benchmark item.

    Returns doc_id, n_words, spans (array of <start, size> of every occurrence of an item window), n_hit (words inside
    any of them), items (sorted array of the item ids, as strings). Null or wordless texts have no words and no hits;
    null or wordless items have no windows; rows with a null id are left out on both sides. Of several rows with one
    doc_id the smallest text stands for it; repeated item ids are parts of one item. Other columns aren't looked at.
    """
    item_windows = benchmark_windows(benchmark, window, item_col, item_text_col)
    phrases = item_windows.select("phrase", "size").distinct()
    # the shingles of each window, and the rarest as its token; a window under five words is its own shingle
    parts = phrases.select("phrase", "size", F.expr(f"least(size, {SHINGLE})").alias("k"), F.expr("transform(split(phrase, ' '), w -> xxhash64(w))").alias("h"))
    sizes = [r.k for r in parts.select("k").distinct().collect()]  # five values at most
    of_size = F.coalesce(*[F.when(F.col("k") == k, _shingles("h", k)) for k in range(1, SHINGLE + 1)])
    tokens = parts.select("phrase", "size", "k", F.posexplode(of_size).alias("offset", "token"))
    rarity = tokens.groupBy("k", "token").agg(F.count("*").alias("seen"))
    prefix = tokens.join(rarity, ["k", "token"]).groupBy("phrase", "size").agg(F.min(F.struct("seen", "k", "token", "offset")).alias("least")).select("phrase", "size", "least.token", "least.offset")

    def bounded(side: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(side) if rows <= BROADCAST_TOKENS else side

    n_tokens = prefix.count()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    found = None
    for k in sizes or [SHINGLE]:
        rolling = hashed.select("doc_id", F.size("h").alias("n"), F.posexplode(_shingles("h", k)).alias("p", "token"))
        rolling = rolling.join(bounded(prefix.select("token").distinct(), n_tokens), "token", "left_semi")
        found = rolling if found is None else found.unionByName(rolling)
    near = found.join(prefix, "token").select("doc_id", "phrase", "size", (F.col("p") - F.col("offset")).alias("start"), "n").where("start >= 0 AND start + size <= n")
    near = near.groupBy("doc_id").agg(F.collect_set(F.struct("start", "size", "phrase")).alias("near"))
    texts = one_text_each(docs, id_col, text_col).join(near, "doc_id", "left").select("doc_id", words_of(F.col("text")).alias("words"), "near")
    sure = texts.select("doc_id", F.size("words").cast("long").alias("n_words"), F.expr(HITS).alias("hits"))
    phrase_items = item_windows.select("phrase", F.col("item_id").cast("string").alias("item_id"))
    items = sure.where("size(hits) > 0").select("doc_id", F.explode(F.array_distinct(F.col("hits.phrase"))).alias("phrase")).join(phrase_items, "phrase").groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    hit = F.expr("size(array_distinct(flatten(transform(hits, x -> sequence(x.start, x.start + x.size - 1)))))")
    spans = F.expr("array_sort(transform(hits, x -> struct(x.start AS start, x.size AS size)))")
    return sure.join(items, "doc_id", "left").select("doc_id", "n_words", spans.alias("spans"), hit.cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for all documents."""
    out = decontamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bs AS (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM bw WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS phrase, least(len(w), 10) AS size FROM bs
), sizes AS (
  SELECT DISTINCT size FROM win
), ds AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM dw, sizes WHERE len(w) >= size
), dp AS (
  SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS phrase FROM ds
), hit AS (
  SELECT doc_id, s, dp.size, item_id FROM dp JOIN win ON dp.phrase = win.phrase AND dp.size = win.size
), pos AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + size)) AS p FROM hit
), n AS (
  SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
