"""A corpus pipeline of five operators, each stage written as Parquet and read again.

documents -> quality -> near duplicates -> repeated passages -> benchmark passages -> mixture
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelode.llm import decontamination as dc
from framelode.llm import jaccard_join as jj
from framelode.llm import mixing as mx
from framelode.llm import quality as ql
from framelode.llm import substring_dedup as sd
from framelode.llm.shared import released, shared_folder, written

#: Documents scored lower are rejected.
LEAST_QUALITY = 0.7


def unused(docs: DataFrame, name: str) -> str:
    """name, or name with as many underscores as no column of docs has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column, and its name, that names a single row: doc_id itself where it is a row's own.

    Of several rows with one doc_id, the first by hashes of the text and the whole row keeps it. The others, and rows
    without a doc_id, get numbers beyond all of them in the order of those hashes. Only then are rows written anew.
    """
    key, row = unused(docs, "_id"), unused(docs, "_row")
    if docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        return docs.withColumn(key, F.col("doc_id")), key
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    light = rows.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(*docs.columns).alias("a"), F.col(row).alias("r"))
    first = light.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("h", "a", "r")).alias("first")).select(F.col("first.r").alias(row), F.col("doc_id").alias(key))
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    # row numbers stay far below 2**62
    base = 0 if ends.high is None else ends.high + 1 if ends.high < 2**62 else ends.low - 2**62
    if base < -(2**63):
        raise ValueError("doc_id leaves no room for the numbers of rows that share an id or have none")
    others = light.withColumnRenamed("r", row).join(first, row, "left_anti").sort("h", "a", row).select(row, (F.monotonically_increasing_id() + F.lit(base).cast("long")).alias(key))
    return written(rows.join(first.unionByName(written(others, "numbers")), row).drop(row), "numbered"), key


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """rows but for those whose key, which goes too, is a doc_id of gone."""
    return rows.join(gone.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier, learned from labels, scores at 0.7 or more.

    A null, empty or blank text has the share of label 1 among the labels for a score, and stays if that is enough.
    Equal texts are scored alike, whatever their ids. No column but text is an input of a score.
    """
    model = ql.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    scored = ql.quality_scores(docs.select("text", *held), model).where(F.col("score") >= LEAST_QUALITY)
    return scored.select(*[F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class of the n-gram Jaccard join.

    Texts without words, null ones too, are in no class and stay, each of them. Of repeated rows one stays; rows that
    share an id or have none are judged each, by the numbers that numbered() gives them.
    """
    rows, key = numbered(docs)
    return without(rows, key, jj.jaccard_join(rows, id_col=key).where("NOT kept"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the words of repeated 20-word windows; texts without any stay as they are, to the byte.

    No row goes: null and empty texts stay null and empty, a text that only repeats becomes empty. n_chars follows where
    words are cut. Rows that share an id or have none are judged each, in the order of numbered().
    """
    rows, key = numbered(docs)
    kept = unused(docs, "_kept")
    cut = sd.substring_dedup(rows, id_col=key).where("n_removed > 0").select(F.col("doc_id").alias(key), F.col("text").alias(kept))
    joined = rows.join(cut, key, "left")
    text = F.coalesce(kept, "text")
    length = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast("long"))
    return joined.withColumns({"text": text, "n_chars": length}).drop(key, kept)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents with words in any occurrence of a benchmark window.

    Null and empty texts hold none and stay; so does every row where the benchmark is empty. Rows that share an id or
    have none are judged each.
    """
    rows, key = numbered(docs)
    found = dc.decontamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return without(rows, key, found.where("n_hit > 0"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of what is left: a row for each time that a document is used, with its place in the order.

    Null and blank texts take no budget and come along where they stand, unless their source has no token at all, which
    yields nothing. Sources whose shares meet the target already stay whole. Repeated rows stay together; columns named
    mix_... are replaced by the mixture's.
    """
    return mx.mixture(docs, natural=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_passages", benchmark_passages), ("mixture", mixed)]

#: SQL can't express the quality classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again, and the tables that a
    stage has written on its way go when its result is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, name)
        with released(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
