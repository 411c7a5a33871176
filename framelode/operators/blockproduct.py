"""Matrix products of blocks: integers summed exactly, then scaled by row and column, with a bias.

A side is rows of numbers, dealt into blocks of about SIDE rows and cut into pieces of DEPTH columns. Blocks meet on a
grid (rows of a, rows of b, columns): a task multiplies two blocks, and the partial products of one place of the grid are
added up. What is shuffled is rows of blocks and partial blocks, never a row for each product of two numbers, and no side
is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a block: 1 MB of doubles.
SIDE, DEPTH = 256, 512


def _blocks(df: DataFrame) -> int:
    return max(1, -(-df.count() // SIDE))


def row_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, depth, number, scale, bias, values): rows (number, values, scale, bias) dealt into blocks by a hash of their
    number, about SIDE rows each, and cut into pieces of DEPTH columns."""
    cut = rows.where("size(values) > 0").withColumn("depth", F.explode(F.expr(f"sequence(0, (size(values) - 1) div {DEPTH})")))
    cut = cut.withColumn("values", F.slice("values", F.col("depth") * DEPTH + 1, F.lit(DEPTH)).cast("array<double>"))
    return cut.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int"))


def _matrix(column) -> np.ndarray:
    """Rows of any lengths, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), size.max(initial=0)))
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Sum:
    """A sum of partial products that know their rows and columns; what one of them lacks is zero."""

    def __init__(self):
        self.ids, self.factors = [np.zeros(0, np.int64)] * 2, [np.zeros(0), np.zeros((0, 2))]
        self.total = np.zeros((0, 0))

    def add(self, ids: list[np.ndarray], factors: list[np.ndarray], y: np.ndarray) -> None:
        if [len(i) for i in ids] != [len(i) for i in self.ids] or any((i != j).any() for i, j in zip(ids, self.ids, strict=True)):
            both = [np.union1d(i, j) for i, j in zip(ids, self.ids, strict=True)]
            wide = np.zeros((len(both[0]), len(both[1])))
            wide[np.ix_(*(np.searchsorted(b, i) for b, i in zip(both, self.ids, strict=True)))] = self.total
            grown = [np.zeros((len(b), *f.shape[1:])) for b, f in zip(both, factors, strict=True)]
            for g, b, i, f in zip(grown, both, self.ids, self.factors, strict=True):
                g[np.searchsorted(b, i)] = f
            for g, b, i, f in zip(grown, both, ids, factors, strict=True):
                g[np.searchsorted(b, i)] = f
            self.ids, self.factors, self.total = both, grown, wide
        self.total[np.ix_(*(np.searchsorted(b, i) for b, i in zip(self.ids, ids, strict=True)))] += y


def scaled_product(a: DataFrame, b: DataFrame, whole: bool = True) -> DataFrame:
    """(m, n, sum, y): y = sum * scale of m * scale of n + bias of n, for a (m, x, scale) and b (n, w, scale, bias).

    sum is the inner product of the rows. whole: they hold integers and sums are exact; one that might leave 2**53 raises.
    A row shorter than its partner counts as filled up with zeros; rows that are null or empty have no products. A number
    that is there twice raises, a null one is left out, null scales and biases make y null. Scales travel with the blocks.
    """
    down, across = _blocks(a), _blocks(b)
    left = row_blocks(a.where("m IS NOT NULL").select(F.col("m").cast("long").alias("number"), F.col("x").alias("values"), F.col("scale").cast("double").alias("scale"), F.lit(0.0).alias("bias")), down)
    right = row_blocks(b.where("n IS NOT NULL").select(F.col("n").cast("long").alias("number"), F.col("w").alias("values"), F.col("scale").cast("double").alias("scale"), F.col("bias").cast("double").alias("bias")), across)
    grid = ["down", "across", "depth"]
    held = ["number", "scale", "bias", "values"]
    sent = left.withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumnRenamed("block", "down").select(*grid, *held)
    met = right.withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumnRenamed("block", "across").select(*grid, *held)
    packed = ["m", "n", "row_scale", "column_scale", "y"]
    schema = pa.schema([("down", pa.int32()), ("across", pa.int32()), *((c, pa.binary()) for c in packed)])

    def multiply(p: pa.Table, q: pa.Table) -> pa.Table:
        if not len(p) or not len(q):
            return schema.empty_table()
        p, q = p.sort_by("number"), q.sort_by("number")
        m, n = p.column("number").to_numpy(), q.column("number").to_numpy()
        if any((i[1:] == i[:-1]).any() for i in (m, n)):
            raise ValueError("a row's number is there twice")
        x, w = _matrix(p.column("values")), _matrix(q.column("values"))
        k = min(x.shape[1], w.shape[1])
        if whole and np.abs(x).max(initial=0) * np.abs(w).max(initial=0) * DEPTH >= 2**53:
            raise OverflowError("sums of these products aren't exact")
        scales = lambda t: np.stack([t.column(c).to_numpy() for c in ("scale", "bias")], 1)
        values = (m, n, scales(p)[:, 0].copy(), scales(q), x[:, :k] @ w[:, :k].T)
        return pa.table([[p.column("down")[0].as_py()], [p.column("across")[0].as_py()], *([v.tobytes()] for v in values)], schema=schema)

    parts = sent.toDF(*sent.columns).groupBy(*grid).cogroup(met.toDF(*met.columns).groupBy(*grid)).applyInArrow(multiply, "down int, across int, m binary, n binary, row_scale binary, column_scale binary, y binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sum()
        for batch in batches:
            for r in zip(*(batch.column(c) for c in packed), strict=True):
                m, n = (np.frombuffer(v.as_py(), np.int64) for v in r[:2])
                row, column, y = (np.frombuffer(v.as_py(), np.float64) for v in r[2:])
                sums.add([m, n], [row, column.reshape(-1, 2)], y.reshape(len(m), len(n)))
        if whole and np.abs(sums.total).max(initial=0) >= 2**53:
            raise OverflowError("sums of these products aren't exact")
        (m, n), (row, column) = sums.ids, sums.factors
        for at in range(0, len(m), 64):  # a few thousand rows at a time
            part, own = sums.total[at : at + 64], row[at : at + 64, None]
            y = part * own * column[None, :, 0] + column[None, :, 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(m[at : at + 64], len(n))), pa.array(np.tile(n, len(part))), pa.array(part.ravel()), pa.array(y.ravel(), from_pandas=True)], ["m", "n", "sum", "y"])

    return parts.groupBy("down", "across").applyInArrow(add, "m long, n long, sum double, y double")


def quantised(rows: DataFrame, values: str, top: float, rounding, out: str) -> DataFrame:
    """rows with out, values over scale, rounded by rounding(column), and scale: the largest absolute value over top; 1
    where that is 0."""
    largest = F.array_max(F.transform(F.col(values), F.abs))
    scale = F.when(largest > 0, largest / top).otherwise(F.lit(1.0))
    return rows.withColumn("scale", scale).withColumn(out, F.transform(F.col(values), lambda v: rounding(v / F.col("scale"))))


def int8(v: Column) -> Column:
    """Rounded half to even and cut to [-127, 127]."""
    return F.greatest(F.least(F.rint(v), F.lit(127.0)), F.lit(-127.0))
