"""Near-duplicate embeddings: random projections decoded to E8 lattice points, in several tables.

In each table a vector's projection to eight dimensions falls into the cell of its nearest E8 point; the vector is
entered there and also asks the cells nearest to it. The scale of the lattice follows the number of vectors, so that a
cell holds about as many strangers at any size; the number of tables follows from the scale by simulation, so that a
pair at the threshold is met with the wanted probability. All pairs that meet are verified by cosine.

An entry carries its vector, as floats where those hold it exactly. Equal vectors are one entry with a count. Pairs are counted inside the tasks and never emitted: a pair belongs to
exactly one of the cells in which it meets, and a task returns, for each vector, its links and one edge of the cell's
spanning forest. Cells with more than BLOCK rows are split into pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lattice
from . import textarrays as ta
from .anchors import bucket_count
from .components import components, contracted
from .shared import attach, written

BLOCK = 2048
#: Rows of the largest broadcast list of heavy cells (16 bytes each).
BROADCAST_CELLS = 1_000_000
#: Entries of one bucket, about.
ENTRIES = 200_000
#: ∫p² of a standard normal is SPREAD per dimension; cells have volume 1.
SPREAD = 0.5 / np.pi**0.5


def plan(n: int, cosine: float, probes: int, recall: float) -> tuple[float, int]:
    """The lattice scale and number of tables for n vectors."""
    strangers = max(16.0, n**0.5 / 2.5)
    scale = SPREAD * max(n / strangers, 1.0) ** 0.125
    rate = lattice.found_rate(scale, cosine, probes)
    return scale, max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - min(rate, 0.999)))))


def units(v: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def rows_by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors as doubles), one entry for each length of vector."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(size) - size
    out = []
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out.append((rows, flat[start[rows][:, None] + np.arange(d)]))
    return out


def packed(v: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The vectors' bytes, as floats where those hold them exactly, and whether they are doubles."""
    floats = v.astype(np.float32)
    wide = (floats != v).any(1)
    return [(x if w else y).tobytes() for x, y, w in zip(v, floats, wide.tolist(), strict=True)], wide


def unpacked(raw: list[bytes], wide: np.ndarray) -> np.ndarray:
    """The vectors as doubles again; all have one length."""
    if not wide.any():
        return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(np.float64)
    return np.stack([np.frombuffer(x, np.float64 if w else np.float32).astype(np.float64) for x, w in zip(raw, wide.tolist(), strict=True)])


def _cells(vectors: np.ndarray, scale: float, tables: int, probes: int, seed: int) -> np.ndarray:
    """Names of the cells of each vector: n x tables x (1 + probes), the home first."""
    dim = vectors.shape[1]
    out = np.empty((len(vectors), tables, 1 + probes), np.uint64)
    for t in range(tables):
        projection = np.random.default_rng([seed, t, dim]).standard_normal((dim, 8))
        out[:, t] = ta.mix(lattice.cells(scale * vectors @ projection, probes) + np.uint64((t + 1) * 1_000_003 + dim))
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def embedding_links(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.97, probes: int = 2, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Links between different vectors of (rep long, copies long, embedding).

    Returns (rep, n_links), counting every copy of a linked vector, and the edges (a, b) of spanning forests.
    """
    n = vectors.count()
    scale, tables = plan(n, cosine, probes, recall)
    per = tables * (1 + probes)
    # a bucket's entries fit a task at any size: about ENTRIES of them
    buckets = max(bucket_count(vectors), -(-n * per // ENTRIES))

    def names(batches):
        for batch in batches:
            for _, v in rows_by_length(batch.column("embedding")):
                yield pa.RecordBatch.from_arrays([pa.array(_cells(units(v), scale, tables, probes, seed).ravel().view(np.int64))], ["cell"])

    heavy = vectors.select("embedding").mapInArrow(names, "cell long").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    heavy = written(heavy, "cells")
    heavy = F.broadcast(heavy) if heavy.count() <= BROADCAST_CELLS else heavy

    def enter(batches):
        for batch in batches:
            for rows, v in rows_by_length(batch.column("embedding")):
                for at in range(0, len(rows), 1000):
                    part, own = v[at : at + 1000], rows[at : at + 1000]
                    cells = _cells(units(part), scale, tables, probes, seed)
                    k = len(own)
                    raw, wide = packed(part)
                    raw, wide = pa.array(raw, pa.binary()), pa.array(wide)
                    all_cells = pa.array([x.tobytes() for x in cells.astype(np.uint32).reshape(k, -1)], pa.binary())
                    row = np.repeat(np.arange(k), per)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().view(np.int64)), pa.array(np.tile(np.repeat(np.arange(tables), 1 + probes), k).astype(np.int32)), pa.array(np.tile(np.arange(1 + probes) == 0, k * tables)), batch.column("rep").take(pa.array(own)).take(take), batch.column("copies").take(pa.array(own)).take(take), raw.take(take), wide.take(take), all_cells.take(take)], ["cell", "table", "home", "rep", "copies", "vector", "wide", "cells"])

    entered = vectors.select("rep", "copies", "embedding").mapInArrow(enter, "cell long, table int, home boolean, rep long, copies long, vector binary, wide boolean, cells binary")
    block = F.expr("CAST(pmod(xxhash64(rep), blocks) AS int)")
    dealt = entered.join(heavy, "cell", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(block))
    dealt = dealt.withColumn("other", F.explode(F.expr("CASE WHEN blocks IS NULL THEN array(0) ELSE sequence(0, blocks - 1) END")))
    dealt = dealt.select("cell", "table", "home", "rep", "copies", "vector", "wide", "cells", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = dealt.withColumn("bucket", F.expr(f"CAST(pmod(xxhash64(cell, i, j), {buckets}) AS int)"))

    def owned(x: np.ndarray, y: np.ndarray, table: int, cell: int) -> np.ndarray:
        """Which pairs of rows of cell names (n x tables x (1 + probes)) belong to this table and cell."""
        in_y, in_x = (y == x[:, :, :1]).any(2), (x == y[:, :, :1]).any(2)
        first = (in_x | in_y).argmax(1) == table
        hx, hy = x[:, table, 0], y[:, table, 0]
        at = np.where(in_y[:, table] & in_x[:, table], np.minimum(hx, hy), np.where(in_y[:, table], hx, hy))
        return first & (at == cell)

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        col = {k: table.column(k).to_numpy() for k in ("cell", "table", "home", "rep", "copies", "wide", "block", "i", "j")}
        order = np.lexsort((col["j"], col["i"], col["cell"]))
        col = {k: v[order] for k, v in col.items()}
        group = np.r_[True, (np.diff(col["cell"]) != 0) | (np.diff(col["i"]) != 0) | (np.diff(col["j"]) != 0)]
        at = np.flatnonzero(group)
        size = np.diff(np.r_[at, len(group)])
        vectors, cells = (table.column(k).take(pa.array(order)).to_pylist() for k in ("vector", "cells"))
        reps, links, froms, tos = [], [], [], []
        for s, k in zip(at[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            home = col["home"][s : s + k]
            if not home.any():
                continue
            v = units(unpacked(vectors[s : s + k], col["wide"][s : s + k]))
            hit = np.triu(v @ v.T >= cosine, 1)
            if not hit.any():
                continue
            a, b = np.nonzero(hit)
            own, i, j = col["block"][s : s + k], col["i"][s], col["j"][s]
            keep = (home[a] | home[b]) & (np.minimum(own[a], own[b]) == i) & (np.maximum(own[a], own[b]) == j)
            a, b = a[keep], b[keep]
            c = np.frombuffer(b"".join(cells[s : s + k]), np.uint32).reshape(k, tables, 1 + probes)
            name = int(col["cell"][s : s + 1].view(np.uint64)[0] & np.uint64(0xFFFFFFFF))
            mine = np.concatenate([np.zeros(0, bool), *(owned(c[a[p : p + 50_000]], c[b[p : p + 50_000]], int(col["table"][s]), name) for p in range(0, len(a), 50_000))])
            a, b = a[mine], b[mine]
            if not len(a):
                continue
            rep, copies = col["rep"][s : s + k], col["copies"][s : s + k]
            seen = np.unique(np.r_[a, b])
            reps.append(rep[seen])
            links.append((np.bincount(a, copies[b], k) + np.bincount(b, copies[a], k))[seen].astype(np.int64))
            root = _forest(k, a, b)
            froms.append(rep[seen])
            tos.append(rep[root[seen]])
        if not reps:
            return pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        return pa.table({"rep": np.concatenate(reps), "links": np.concatenate(links), "root": np.concatenate(tos)})

    met = written(dealt.groupBy("bucket").applyInArrow(meet, "rep long, links long, root long"), "met")
    return met.groupBy("rep").agg(F.sum("links").alias("n_links")), met.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct()


def embedding_dedup(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.97, probes: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Near-duplicates by cosine >= cosine among all vectors of one length.

    Returns a row for each row: vec_id, n_links (other vectors linked directly), component_id (smallest id reachable),
    kept (vec_id = component_id). A null vector, an all-zero one, and one that holds null, NaN or infinity link with
    nothing. Vectors of different lengths never link. Rows with a null id are left out; rows that repeat an id and a
    vector are one vector, and of those that repeat an id with another vector the smallest stands. Pairs at the
    threshold are met with probability recall, closer ones more often.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL")
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    fine = F.expr("embedding IS NOT NULL AND exists(embedding, x -> x <> 0) AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('infinity'))")
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    keyed = rows.where("fine").withColumn("same", F.struct(F.xxhash64("embedding").alias("p"), F.xxhash64(F.lit(1), "embedding").alias("q")))
    keyed = written(keyed.select("vec_id", "same", "embedding"), "vectors")
    groups = keyed.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    members = attach(keyed.select("vec_id", "same"), groups.where("copies > 1").select("same", "copies", "rep", F.col("copies").alias("group")), "same", "copies", "vec_id")
    members = members.select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("group", F.lit(1).cast("long")).alias("copies"))
    members = written(members, "members")
    reps = keyed.select("vec_id", "embedding").join(members.where("vec_id = rep"), "vec_id").select("rep", "copies", "embedding")
    links, edges = embedding_links(reps, cosine, recall, probes)
    found = links.join(components(contracted(edges)), F.col("rep") == F.col("node"), "left").select("rep", "n_links", F.coalesce("component", "rep").alias("component"))
    held = members.groupBy("rep").agg(F.max("copies").alias("held"))
    answers = attach(members, held.join(found, "rep").select("rep", "held", "n_links", "component"), "rep", "held", "vec_id")
    answers = answers.select("vec_id", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id").join(answers, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for all vectors, cosine 0.9."""
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
