"""Tensors as rows of (coordinates, value): patches, channel scaling, products and attention in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a matrix side that is broadcast at most (about 500 bytes each); a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Queries and keys of one block of attention(), about, and the queries multiplied at once (8 MB of scores).
BLOCK, STRIP = 8000, 125
#: Tasks of a rank that rounds() numbers together, about.
RANGE = 100_000


def normalized(values: DataFrame, stats: DataFrame, scale: float = 1.0) -> DataFrame:
    """values (channel, x) with y = (x - mean) * scale / std of their channel (channel, mean, std)."""
    return values.join(stats.select("channel", "mean", "std"), "channel").withColumn("y", (F.col("x") - F.col("mean")) * scale / F.col("std")).drop("mean", "std")


def denormalized(values: DataFrame, stats: DataFrame, scale: float = 1.0) -> DataFrame:
    """The inverse: x = y * std / scale + mean."""
    return values.join(stats.select("channel", "mean", "std"), "channel").withColumn("x", F.col("y") * F.col("std") / scale + F.col("mean")).drop("mean", "std")


def packed(cells: DataFrame, patch: int, width: int) -> DataFrame:
    """(id, token, place, x): cells (id, row, col, x) as patch x patch tokens, numbered row by row."""
    r, c = F.col("row"), F.col("col")
    token = F.expr(f"(row div {patch}) * {width // patch} + col div {patch}")
    return cells.select("id", token.alias("token"), ((r % patch) * patch + c % patch).alias("place"), "x")


def unpacked(tokens: DataFrame, patch: int, width: int) -> DataFrame:
    """The inverse of packed()."""
    per = width // patch
    return tokens.select("id", F.expr(f"(token div {per}) * {patch} + place div {patch}").alias("row"), F.expr(f"(token % {per}) * {patch} + place % {patch}").alias("col"), "x")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(m, n, y): the matrix product of a (m, k, x) and b (k, n, w), as an equi-join on k and partial sums."""
    small = b.count() <= BROADCAST_ROWS
    return a.join(F.broadcast(b) if small else b, "k").groupBy("m", "n").agg(F.sum(F.col("x") * F.col("w")).alias("y"))


def attention(queries: DataFrame, keys: DataFrame, scale: float) -> DataFrame:
    """(q, place, y): softmax over all keys of the queries' products, times the keys' values.

    queries (q, v) and keys (k, v, value) hold arrays of numbers. Both sides are dealt into blocks of about BLOCK rows
    by a hash; a task multiplies one pair of blocks and returns, for each query, the largest score, the norm and the
    weighted sum, which are then merged. Neither side is bounded, and no task or row holds all keys. A key whose v or
    value is null counts for nothing; a null v of a query raises.
    """
    blocks = lambda df: max(-(-df.count() // BLOCK), 1)
    keys = keys.where("v IS NOT NULL AND value IS NOT NULL")
    n_q, n_k = blocks(queries), blocks(keys)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = dict(queries.dtypes)["q"]
    own_q = queries.select(F.pmod(F.xxhash64("q"), F.lit(n_q)).cast("int").alias("qb"), every(n_k).alias("kb"), "q", F.col("v").cast("array<double>").alias("v"), F.lit(None).cast("array<double>").alias("value"))
    own_k = keys.select(every(n_q).alias("qb"), F.pmod(F.xxhash64("k"), F.lit(n_k)).cast("int").alias("kb"), F.lit(None).cast(kind).alias("q"), F.col("v").cast("array<double>").alias("v"), F.col("value").cast("array<double>").alias("value"))

    def partial(table: pa.Table) -> pa.Table:
        is_key = table.column("value").is_valid()
        held, asked = table.filter(is_key), table.filter(pc.invert(is_key))
        matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        if not len(held) or not len(asked):
            return asked.select(["q"]).slice(0, 0).append_column("top", pa.array([], pa.float64())).append_column("norm", pa.array([], pa.float64())).append_column("part", pa.array([], pa.list_(pa.float64())))
        if asked.column("v").null_count:
            raise ValueError("a query of attention has no vector")
        q, k, value = matrix(asked, "v"), matrix(held, "v"), matrix(held, "value")
        top, norm, part = np.empty(len(q)), np.empty(len(q)), np.empty((len(q), value.shape[1]))
        for i in range(0, len(q), STRIP):  # the scores of a strip are one array, which becomes its weights
            own = slice(i, i + STRIP)
            score = q[own] @ k.T
            score *= scale
            top[own] = score.max(1)
            score -= top[own, None]
            np.exp(score, out=score)
            norm[own], part[own] = score.sum(1), score @ value
        return pa.table({"q": asked.column("q"), "top": top, "norm": norm, "part": _lists(part)})

    parts = own_q.unionByName(own_k).groupBy("qb", "kb").applyInArrow(partial, f"q {kind}, top double, norm double, part array<double>")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = SoftmaxFold()
        for batch in batches:
            fold.add(batch.column("q").to_pylist(), batch.column("top").to_numpy(), batch.column("norm").to_numpy(), batch.column("part"))
        if fold.order:
            q, y = fold.result(arrow_type)
            yield pa.RecordBatch.from_arrays([q, _lists(y)], ["q", "y"])

    arrow_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    # a block of queries again, whose parts meet one after the other
    sums = parts.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(n_q)).cast("int")).groupBy("qb").applyInArrow(merged, f"q {kind}, y array<double>")
    return sums.select("q", F.posexplode("y").alias("place", "y"))


def _lists(rows: np.ndarray) -> pa.ListArray:
    """A matrix as lists, without a copy of its numbers."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


class SoftmaxFold:
    """Partial softmax sums of queries added up: for each the largest score, the norm and the weighted sum so far."""

    def __init__(self):
        self.order, self.top, self.norm, self.part = {}, np.zeros(0), np.zeros(0), None

    def add(self, ids: list, top: np.ndarray, norm: np.ndarray, part: pa.Array) -> None:
        if not len(ids):
            return
        part = part.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        new = [i for i in dict.fromkeys(ids) if i not in self.order]
        self.order |= {i: len(self.order) + n for n, i in enumerate(new)}
        self.top, self.norm = np.r_[self.top, np.full(len(new), -np.inf)], np.r_[self.norm, np.zeros(len(new))]
        self.part = np.concatenate([np.zeros((0, part.shape[1])) if self.part is None else self.part, np.zeros((len(new), part.shape[1]))])
        at = np.array([self.order[i] for i in ids])
        high = self.top.copy()
        np.maximum.at(high, at, top)
        kept, share = np.exp(np.where(np.isneginf(self.top), -np.inf, self.top - high)), np.exp(top - high[at])
        self.top, self.norm, self.part = high, self.norm * kept, self.part * kept[:, None]
        np.add.at(self.norm, at, share * norm)
        np.add.at(self.part, at, share[:, None] * part)

    def result(self, kind: pa.DataType) -> tuple[pa.Array, np.ndarray]:
        return pa.array(list(self.order), kind), self.part / self.norm[:, None]


def timestep_embedding(steps: DataFrame, dim: int, base: float = 10000.0) -> DataFrame:
    """steps (t) with emb: cos of t * base**(-i / half) for i < half, then the sines."""
    half = dim // 2
    freq = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: F.pow(F.lit(base), -i / half))
    angle = lambda f: F.transform(freq, lambda w: f(F.col("t") * w))
    return steps.withColumn("emb", F.concat(angle(F.cos), angle(F.sin)))


def predicted(computed: DataFrame) -> DataFrame:
    """(branch, step, guess) for the step after each computed (branch, step, x, layout): x plus the last change.

    The change counts for one interval only, and only between steps of one layout.
    """
    order = Window.partitionBy("branch", "layout").orderBy("step")
    gap = F.col("step") - F.lag("step").over(order)
    slope = F.coalesce((F.col("x") - F.lag("x").over(order)) / gap, F.lit(0.0))
    return computed.select("branch", (F.col("step") + 1).alias("step"), (F.col("x") + slope).alias("guess"))


def rounds(plan: DataFrame, ranks: DataFrame) -> DataFrame:
    """(round, rank, task): the r-th task of each rank of plan (task, rank) for every round any rank has; null if none.

    Tasks are integers. A rank may hold any share of them: they are numbered inside ranges of about RANGE tasks each, to
    which the sizes of the ranges before are added. Null tasks come first; tasks without a rank are left out.
    """
    spans = plan.groupBy("rank").agg(F.min("task").alias("low"), F.max("task").alias("high"), F.ceil(F.count("*") / RANGE).alias("ranges"))
    part = F.floor((F.col("task") - F.col("low")) * F.col("ranges") / (F.col("high") - F.col("low") + 1))
    dealt = plan.join(spans, "rank").select("rank", "task", F.coalesce(part, F.lit(-1)).alias("part"))
    counts = dealt.groupBy("rank", "part").agg(F.count("*").alias("n"))
    before = counts.select("rank", "part", (F.sum("n").over(Window.partitionBy("rank").orderBy("part")) - F.col("n")).alias("before"))
    turn = F.row_number().over(Window.partitionBy("rank", "part").orderBy("task")) - 1
    mine = dealt.withColumn("turn", turn).join(before, ["rank", "part"]).select("task", "rank", (F.col("before") + F.col("turn")).alias("round"))
    last = counts.groupBy("rank").agg(F.sum("n").alias("n")).agg((F.max("n") - 1).alias("last"))
    # rounds in two steps, so that no row holds an array as long as the longest rank
    blocks = ranks.join(F.broadcast(last), F.expr("true")).select("rank", "last", F.explode(F.expr(f"sequence(0L, last div {RANGE})")).alias("block"))
    grid = blocks.select("rank", F.explode(F.expr(f"sequence(block * {RANGE}, least(last, block * {RANGE} + {RANGE - 1}))")).alias("round"))
    return grid.join(mine, ["rank", "round"], "left").select("round", "rank", "task")


def delta_table(pairs: DataFrame) -> DataFrame:
    """(row, count, deltas): sorted distinct columns of pairs (row, col) as first value and differences."""
    order = Window.partitionBy("row").orderBy("col")
    steps = pairs.select("row", "col").distinct().withColumn("delta", F.col("col") - F.coalesce(F.lag("col").over(order), F.lit(0)))
    return steps.groupBy("row").agg(F.count("*").alias("count"), F.transform(F.array_sort(F.collect_list(F.struct("col", "delta"))), lambda x: x["delta"]).alias("deltas"))


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """left and right (clip, frame, value) frame by frame: value and other; a frame without its partner raises."""
    joined = left.join(right.select("clip", "frame", F.col("value").alias("other")), ["clip", "frame"], "full")
    alone = F.col("value").isNull() | F.col("other").isNull()
    return joined.withColumn("value", F.when(alone, F.raise_error(F.concat_ws(" ", F.lit("frame counts differ at"), "clip", "frame")).cast("double")).otherwise(F.col("value")))
