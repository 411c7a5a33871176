"""Vectors of integers in blocks: what the searches over embeddings share.

A search is a product of blocks: rows of one length are dealt into blocks of about BLOCK_VALUES numbers, Spark brings
two blocks together, and the task multiplies them piece by piece and keeps the first k of each row that asks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Numbers in one block of vectors (32 MB as doubles).
BLOCK_VALUES = 1 << 22
#: Rows of the two sides that are multiplied at once: scores of 8 MB.
ASK, OFFER = 256, 4096
#: Scores beyond this don't survive the products by 100 that windows need.
LARGEST = 2**56


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, label=None) -> DataFrame:
    """(vec_id, dim, embedding, and label where given), written: the rows that can be scored, one for each id.

    Left out: null ids, null vectors, vectors with null or non-finite components, and null labels. Of rows that repeat
    an id the smallest (vector, label) stands for it.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), (F.lit(0) if label is None else label).cast("long").alias("label"))
    fine = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('infinity'))")
    one = fine.groupBy("vec_id").agg(F.min(F.struct("embedding", "label")).alias("one")).select("vec_id", F.size("one.embedding").alias("dim"), "one.embedding", "one.label")
    return written(one, "vectors")


def matrix(column) -> np.ndarray:
    """floor(256 x) of an Arrow column of vectors of one length, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(256 * flat.reshape(len(column), -1)) if len(flat) else np.zeros((len(column), 0))


def by_length(batch: pa.RecordBatch):
    """A batch's rows, parted by the length of their vectors: (rows, matrix)."""
    dim = batch.column("dim").to_numpy()
    for d in np.unique(dim):
        rows = np.flatnonzero(dim == d)
        yield rows, matrix(batch.column("embedding").take(pa.array(rows)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers, as long; an error where one might not fit."""
    top = (np.abs(a).max(initial=0) or 1) * (np.abs(b).max(initial=0) or 1) * max(a.shape[1], 1)
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    if top >= LARGEST:
        raise OverflowError("inner products of these vectors don't fit 56 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest allowed scores, and of all that equal the last of them."""
    if scores.shape[1] > k:
        masked = np.where(allowed, scores, np.iinfo(np.int64).min)
        allowed = allowed & (scores >= np.partition(masked, -k, axis=1)[:, -k, None])
    return np.nonzero(allowed)


def first(k: int, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the first k entries of each who: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, who))
    w = who[order]
    start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]][: len(w)])
    return order[np.arange(len(w)) - np.repeat(start, np.diff(np.r_[start, len(w)])) < k]


def sample(rows: DataFrame, size: int, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """About size of n rows by the hash of their id, never more than twice as many: {length: (ids, matrix)}."""
    part = rows.where(F.expr(f"pmod(xxhash64(vec_id, 1), {max(1, n // size)}) = 0")).select("vec_id", "dim", "embedding").limit(2 * size)
    out: dict[int, list] = {}
    for r in part.collect():
        out.setdefault(r.dim, []).append((r.vec_id, r.embedding))
    return {d: (np.array([i for i, _ in x], np.int64), np.floor(256 * np.array([v for _, v in x], np.float64).reshape(len(x), d))) for d, x in out.items()}
