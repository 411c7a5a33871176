"""Mixing sources to target weights: temperature weights and budgeted block permutations.

A source with the share s of the tokens gets a weight in proportion to s**a. The exponent a in [0, 1] is bisected: the
largest that reaches the target entropy, or the smallest that keeps the repetition limit if that is larger. Each pass
over the source table tries 15 exponents, four bisection steps at once, and collects 15 rows.

A weight becomes a token budget. A source's documents fall into blocks of about block_tokens tokens; a pass over the
source visits its blocks in a permutation, and the documents of each block in another. Whole passes take everything;
the last one takes documents in this order while they fit. So the last pass is described by one place in the order, and
choosing documents is a comparison with their source's row: no text is moved. The place is found from sums over blocks
and the rows of one block a source. A source that holds a third of all rows is pre-aggregated to its blocks, and their
running sums are taken over prefixes of the permuted key first and inside each prefix then.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SEED = 7
BLOCK_TOKENS = 100_000
ENTROPY = 0.95
REPEATS = 4.0
#: Rows of the source table (about 200 bytes each) that are broadcast at most; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000
STEPS, PASSES = 16, 6


def n_tokens(text):
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def _bisected(shares: DataFrame, holds: str) -> tuple[float, float]:
    """The last exponent in [0, 1] at which holds is false and the first at which it is true, 2**-24 apart or less.

    shares: tokens, share; holds: a condition on z (sum of share**a), h (sum of share**a * ln share), most (the largest
    share**(a - 1)), a, and n (sources); false below a point and true from there.
    """
    low, width = 0.0, 1.0
    for _ in range(PASSES):
        tries = F.explode(F.array(*[F.lit(low + width * k / STEPS) for k in range(1, STEPS)])).alias("a")
        sums = shares.select("share", tries).groupBy("a").agg(F.sum(F.expr("pow(share, a)")).alias("z"), F.sum(F.expr("pow(share, a) * ln(share)")).alias("h"), F.max(F.expr("pow(share, a - 1)")).alias("most"), F.count("*").alias("n"))
        false = [r.a for r in sums.select("a", F.expr(holds).alias("yes")).collect() if not r.yes]
        low, width = max(false, default=low), width / STEPS
    return low, low + width


def exponent(shares: DataFrame, entropy: float, repeats: float, budget_share: float) -> float:
    """The exponent for sources with these shares; budget_share is the budget over all tokens."""
    too_low = f"ln(z) - a * h / z < {entropy} * ln(n)"
    kept = f"{budget_share} * most / z <= {repeats}"
    wanted, _ = _bisected(shares, too_low)
    at_zero = shares.agg(F.max(1 / F.col("share")).alias("most"), F.count("*").alias("n")).first()
    if budget_share * at_zero.most / at_zero.n <= repeats:
        return wanted
    return max(wanted, _bisected(shares, kept)[1])


def met_already(shares: DataFrame, entropy: float, repeats: float, budget_share: float) -> bool:
    """Whether the sources' own shares reach the entropy and keep the repetition limit."""
    r = shares.agg(F.sum(F.expr("share * ln(share)")).alias("h"), F.count("*").alias("n")).first()
    return -r.h >= entropy * log(r.n) - 1e-12 and budget_share <= repeats


def mixture(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, natural: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of a mixture, each as often as its source's budget has it.

    budget: tokens of the mixture, by default as many as docs has; entropy: target for the entropy of the weights, as a
    share of the largest possible; repeats: how often a source may be repeated at most, which wins over entropy. natural:
    where the sources' own shares meet both, the exponent is 1 and a source's budget its own tokens, times the budget over
    all; without it the bisection ends a little below 1, and rounded budgets lose a source's last document.

    Returns docs's columns and mix_tokens (words of the text), mix_weight (the source's), mix_epoch (the pass, from 0),
    mix_block, mix_block_key and mix_key: the mixture in order is sorted by epoch, block key and key. Whole passes hold
    every document of a source, the last one those that fit the rest of the budget. A null source is a source of its
    own. A null or blank text has no tokens, takes no budget and comes along where it stands. A source without tokens
    has weight 0 and yields nothing. Rows with equal ids and sources have equal keys and stay together; a row with a
    null id has its text for one. Columns of docs with these names are replaced; any other name is kept as it is.
    """
    names = [c for c in docs.columns if not c.startswith("mix_")]
    held = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    # docs's columns go under names of their own, so that none meets a name of the plan below
    own, back = zip(*[(F.col(f"`{c}`").alias(f"mix_in{i}"), F.col(f"mix_in{i}").alias(c)) for i, c in enumerate(names)], strict=True)
    keyed = docs.select(*own, n_tokens(F.col(text_col)).alias("mix_tokens"), F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("_source"), F.md5(F.concat(F.lit(f"{seed}:"), held).cast("binary")).alias("mix_key"))
    light = written(keyed.select("_source", "mix_key", "mix_tokens"), "tokens")
    sizes = light.groupBy("_source").agg(F.sum("mix_tokens").alias("tokens")).where("tokens > 0")
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        empty = keyed.where("false").drop("_source")
        return empty.select(*back, "mix_tokens", F.lit(0.0).alias("mix_weight"), F.lit(0).alias("mix_epoch"), F.lit(0).cast("long").alias("mix_block"), F.lit("").alias("mix_block_key"), "mix_key")
    budget = total if budget is None else budget
    shares = written(sizes.withColumn("share", F.col("tokens") / total), "shares")
    as_is = natural and met_already(shares, entropy, repeats, budget / total)
    a = 1.0 if as_is else exponent(shares, entropy, repeats, budget / total)
    z = shares.agg(F.sum(F.pow("share", F.lit(a)))).first()[0]
    sources = shares.select("_source", "tokens", (F.pow("share", F.lit(a)) / z).alias("mix_weight"))
    own_budget = F.expr(f"CAST(CAST(tokens AS decimal(38, 0)) * {budget} div {total} AS bigint)") if as_is else F.floor(F.col("mix_weight") * budget)
    sources = sources.withColumn("budget", own_budget).withColumn("epochs", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") % F.col("tokens")).withColumn("blocks", F.ceil(F.col("tokens") / block_tokens))
    sources = written(sources, "sources")
    few = sources.count() <= BROADCAST_SOURCES

    def placed(rows: DataFrame, with_: DataFrame) -> DataFrame:
        joined = rows.join(F.broadcast(with_) if few else with_, "_source")
        joined = joined.withColumn("mix_block", F.expr("CAST(conv(substr(mix_key, 1, 8), 16, 10) AS BIGINT) % blocks"))
        return joined.withColumn("mix_block_key", F.substring(F.md5(F.concat(F.lit(f"{seed}:b:"), "_source", F.lit(":"), "mix_block", F.lit(":"), "epochs").cast("binary")), 1, 16))

    # where the last pass ends: running sums of blocks, in two levels, then of the documents of one block
    blocks = placed(light, sources).groupBy("_source", "mix_block_key", "rest").agg(F.sum("mix_tokens").alias("n")).withColumn("head", F.substring("mix_block_key", 1, 3))
    heads = blocks.groupBy("_source", "head").agg(F.sum("n").alias("n"))
    before = heads.select("_source", "head", (F.sum("n").over(Window.partitionBy("_source").orderBy("head")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("_source", "head").orderBy("mix_block_key")
    ends = blocks.withColumn("upto", F.sum("n").over(inside)).join(before, ["_source", "head"]).withColumn("end", F.col("before") + F.col("upto"))
    last = ends.where("end > rest").groupBy("_source").agg(F.min(F.struct("mix_block_key", "end", "n")).alias("cut")).select("_source", F.col("cut.mix_block_key").alias("cut_block"), (F.col("cut.end") - F.col("cut.n")).alias("begin"))
    sources = written(sources.join(last, "_source", "left"), "cuts")
    of_cut = placed(light, sources).where("mix_block_key = cut_block")
    fits = of_cut.withColumn("upto", F.col("begin") + F.sum("mix_tokens").over(Window.partitionBy("_source").orderBy("mix_key"))).where("upto <= rest").groupBy("_source").agg(F.max("mix_key").alias("cut_key"))
    sources = written(sources.join(fits, "_source", "left"), "ends")

    extra = F.expr("CASE WHEN mix_block_key < cut_block OR (mix_block_key = cut_block AND mix_key <= cut_key) THEN 1 ELSE 0 END")
    chosen = placed(keyed, sources).withColumn("_copies", (F.col("epochs") + extra).cast("int")).where("_copies > 0")
    return chosen.withColumn("mix_epoch", F.explode(F.expr("sequence(0, _copies - 1)"))).select(*back, "mix_tokens", "mix_weight", "mix_epoch", "mix_block", "mix_block_key", "mix_key")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, block_key, doc_key of the mixture of all documents."""
    out = mixture(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").cast("long").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_block_key").alias("block_key"), F.col("mix_key").alias("doc_key"))


OP2_SQL = r"""
WITH RECURSIVE k AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS doc_key
  FROM documents
), s AS (
  SELECT src, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM k GROUP BY src HAVING sum(n_tokens) > 0
), t AS (
  SELECT CAST(sum(tokens) AS BIGINT) AS total, count(*) AS n FROM s
), sh AS (
  SELECT src, tokens, tokens / total AS share FROM s, t
), e(i, low, width) AS (
  SELECT 0, CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN (SELECT ln(sum(pow(share, low + width / 2))) - (low + width / 2) * sum(pow(share, low + width / 2) * ln(share)) / sum(pow(share, low + width / 2)) >= 0.95 * ln(count(*)) FROM sh) THEN low + width / 2 ELSE low END, width / 2 FROM e WHERE i < 24
), r(i, low, width) AS (
  SELECT 0, CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN (SELECT max(pow(share, low + width / 2 - 1)) / sum(pow(share, low + width / 2)) > 4.0 FROM sh) THEN low + width / 2 ELSE low END, width / 2 FROM r WHERE i < 24
), x AS (
  SELECT greatest((SELECT low FROM e WHERE i = 24), CASE WHEN (SELECT max(1 / share) / count(*) <= 4.0 FROM sh) THEN 0.0 ELSE (SELECT low + width FROM r WHERE i = 24) END) AS a
), z AS (
  SELECT sum(pow(share, a)) AS z FROM sh, x
), b AS (
  SELECT src, tokens, CAST(floor(pow(share, a) / z * total) AS BIGINT) AS budget, CAST(ceil(tokens / 100000) AS BIGINT) AS blocks FROM sh, x, z, t
), p AS (
  SELECT src, tokens, budget // tokens AS epochs, budget % tokens AS rest, blocks FROM b
), q AS (
  SELECT k.*, epochs, rest, CAST('0x' || substr(doc_key, 1, 8) AS BIGINT) % blocks AS block FROM k JOIN p USING (src)
), o AS (
  SELECT *, substr(md5('7:b:' || src || ':' || block || ':' || epochs), 1, 16) AS block_key FROM q
), c AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY src ORDER BY block_key, doc_key) AS upto FROM o
)
SELECT doc_id, source, n_tokens, unnest(range(0, epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS epoch, block, block_key, doc_key FROM c
"""
