"""Exact top-k by inner product, with bounds from segment statistics, coarse to fine.

A vector is cut into segments; a segment is known by its mean m and by the length s of what departs from the mean. For
two vectors the part of the inner product that a segment gives is at most L m m' + s s' (Cauchy-Schwarz on the
departures), which is the same as a lower bound on their distance. The bounds of 1 segment, then 4, then 16 and so on
are products of matrices with 2 columns for each segment. What a bound puts strictly below the k-th score known for a
query goes; exact scores are taken of what survives all levels.

Queries and rows meet in blocks: every block of queries with every block of rows. A first k-th score of each query comes
from a sample of rows, so every block prunes from its start; the tasks return the first k of each query and block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectorblocks as vb

#: Rows that give each query its first k-th score; at most twice as many are gathered.
SEEDS = 2048
#: Fewest rows of a block that is made smaller to give every core one.
SMALL = 1024
#: Share of pairs beyond which the next level multiplies whole matrices.
DENSE = 0.1


def levels(dim: int) -> list[int]:
    """Segment counts, coarse to fine."""
    return [4**i for i in range(20) if 4**i * 4 <= dim]


def statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """For each segment sqrt(L) * mean and the length of the departures from it: n x 2 segments."""
    cut = np.arange(segments) * m.shape[1] // segments
    size = np.diff(np.r_[cut, m.shape[1]])
    mean = np.add.reduceat(m, cut, axis=1) / size
    rest = np.sqrt(np.add.reduceat((m - np.repeat(mean, size, axis=1)) ** 2, cut, axis=1))
    return np.hstack([mean * np.sqrt(size), rest])


def survivors(ask: list[np.ndarray], offer: list[np.ndarray], below: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs whose upper bound at every level is no less than the query's below."""
    if not ask:
        return np.nonzero(alive)
    alive = alive & (ask[0] @ offer[0].T >= below[:, None])
    q, r = np.nonzero(alive)
    for a, o in zip(ask[1:], offer[1:], strict=True):
        if len(q) > DENSE * alive.size:
            fine = (a @ o.T)[q, r] >= below[q]
        else:
            fine = np.einsum("ij,ij->i", a[q], o[r]) >= below[q]
        q, r = q[fine], r[fine]
    return q, r


def search_block(ask_ids, ask, floor, has_floor, ids, rows, k: int):
    """The first k rows of each query among rows: (query place, row place, score). floor: scores known to be reached by
    k rows, where has_floor. A query's own id is no row for it."""
    stages = levels(ask.shape[1])
    found = tuple(np.zeros(0, np.int64) for _ in range(3))
    low = np.where(has_floor, floor.astype(np.float64), -np.inf)
    slack = 1e-9 * (np.linalg.norm(ask, axis=1) * np.linalg.norm(rows, axis=1).max(initial=0) + 1)
    for i in range(0, len(ask), vb.ASK):
        own = slice(i, i + vb.ASK)
        a_stats = [statistics(ask[own], s) for s in stages]
        kept = tuple(np.zeros(0, np.int64) for _ in range(3))
        for j in range(0, len(rows), vb.OFFER):
            part = rows[j : j + vb.OFFER]
            alive = ask_ids[own, None] != ids[None, j : j + vb.OFFER]
            q, r = survivors(a_stats, [statistics(part, s) for s in stages], low[own] - slack[own], alive)
            if len(q) > DENSE * alive.size:
                score = vb.products(ask[own], part)[q, r]
            else:
                score = paired(ask[own], part, q, r)
            reach = score >= low[own][q]
            q, r, score = (np.r_[x, y] for x, y in zip(kept, (q[reach], r[reach] + j, score[reach]), strict=True))
            top = vb.first(k, q, score, ids[r])
            kept = q, r, score = q[top], r[top], score[top]
            n = np.bincount(q, minlength=len(ask[own]))
            last = np.full(len(n), np.iinfo(np.int64).max)
            np.minimum.at(last, q, score)
            low[own] = np.where(n >= k, np.maximum(low[own], last), low[own])
        found = tuple(np.r_[x, y] for x, y in zip(found, (kept[0] + i, kept[1], kept[2]), strict=True))
    return found


def paired(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of a[i] and b[j], few thousand pairs at a time."""
    out = np.empty(len(i), np.int64)
    whole = (np.abs(a).max(initial=0) or 1) * (np.abs(b).max(initial=0) or 1) * max(a.shape[1], 1)
    if whole >= vb.LARGEST:
        raise OverflowError("inner products of these vectors don't fit 56 bits")
    kind = np.float64 if whole < 2**53 else np.int64
    for p in range(0, len(i), 8192):
        s = slice(p, p + 8192)
        out[s] = np.einsum("ij,ij->i", a[i[s]].astype(kind), b[j[s]].astype(kind))
    return out


def topk_search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows with the highest inner product of floor(256 x) for each row whose id is divisible by every.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. A query with fewer than k others has
    them all. Null ids, null vectors and vectors with null or non-finite components take no part; of rows that repeat an
    id the smallest vector stands, and a row never finds its own id. Vectors of different lengths never meet; vectors
    without components score 0. Other columns aren't looked at.
    """
    rows = vb.integer_rows(vectors, id_col, vector_col)
    spark = rows.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a row for each length of vector: as many lengths as there are need vectors of their square in numbers
    n = F.count("*")
    block = F.greatest(F.lit(16), F.floor(F.lit(vb.BLOCK_VALUES) / F.greatest("dim", F.lit(1))))
    shape = rows.groupBy("dim").agg(n.alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asks"))
    shape = F.broadcast(shape.select("dim", F.greatest(F.ceil(F.col("n") / block), F.least(F.ceil(F.col("n") / SMALL), F.lit(wide))).cast("int").alias("across"), F.greatest(F.ceil(F.col("asks") / block), F.lit(1)).cast("int").alias("down")))
    seeds = spark.sparkContext.broadcast(vb.sample(rows, SEEDS, rows.count()))

    def floors(batches):
        for batch in batches:
            for at, m in vb.by_length(batch):
                ids = batch.column("vec_id").take(pa.array(at)).to_numpy()
                there, known = seeds.value.get(m.shape[1], (np.zeros(0, np.int64), np.zeros((0, m.shape[1]))))
                floor, has = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
                for p in range(0, len(at), vb.ASK):
                    s = slice(p, p + vb.ASK)
                    if len(there) > k:
                        score = np.where(ids[s, None] == there[None], np.iinfo(np.int64).min, vb.products(m[s], known))
                        floor[s], has[s] = np.partition(score, -k, axis=1)[:, -k], True
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in ("vec_id", "dim", "embedding")] + [pa.array(floor, mask=~has)], ["vec_id", "dim", "embedding", "floor"])

    asks = rows.where(F.col("vec_id") % every == 0).select("vec_id", "dim", "embedding").mapInArrow(floors, "vec_id long, dim int, embedding array<double>, floor long")
    asks = asks.join(shape, "dim").withColumn("i", F.expr("CAST(pmod(xxhash64(vec_id), down) AS int)")).withColumn("j", F.explode(F.expr("sequence(0, across - 1)")))
    offers = rows.join(shape.where("down > 0"), "dim").withColumn("j", F.expr("CAST(pmod(xxhash64(vec_id), across) AS int)")).withColumn("i", F.explode(F.expr("sequence(0, down - 1)")))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        floor = a.column("floor")
        ask_ids, ids = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
        q, r, score = search_block(ask_ids, vb.matrix(a.column("embedding")), floor.fill_null(0).to_numpy(), floor.is_valid().to_numpy(), ids, vb.matrix(b.column("embedding")), k)
        return pa.table({"query_id": ask_ids[q], "vec_id": ids[r], "score": score})

    near = asks.select("dim", "i", "j", "vec_id", "embedding", "floor").groupBy("dim", "i", "j").cogroup(offers.select("dim", "i", "j", "vec_id", "embedding").groupBy("dim", "i", "j")).applyInArrow(meet, "query_id long, vec_id long, score long")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_topk_search(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 highest inner products of each 50th vector id."""
    return topk_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
