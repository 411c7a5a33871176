"""Hard negatives by exact search over k-means inverted lists.

Centroids come from a bounded sample; every row enters the list of its nearest centroid, and a list stores its radius,
the largest distance of a row from the centroid. For an anchor q a list with centroid c and radius r holds only inner
products within q.c - |q| r and q.c + |q| r (Cauchy-Schwarz). An anchor visits lists by their upper bound: first the WAVE
best, which give it a k-th score, then every other list whose bound isn't strictly below that score. For negatives the
lists whose bounds lie outside all windows of the anchor are skipped as well. The answer is exact: nothing that could
enter the first k is left unseen.

A visit is a join: lists are parted into blocks of bounded size, anchors too, and a block of a list meets each block of
anchors of which one visits the list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectorblocks as vb
from .shared import written

#: Rows that centroids are fitted on: about SAMPLE, never more than twice as many.
SAMPLE = 8192
CENTROIDS = 1024
ROUNDS = 10
#: Lists that each anchor visits before its k-th score decides about the others.
WAVE = 3
ANCHOR, LIST = "vec_id long, dim int, embedding array<double>, label long", "dim int, cluster int, vec_id long, label long, embedding array<double>, distance double"
POSITIVES = "positives array<struct<positive_score:long,positive_id:long>>"


def centroids(m: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from k rows spread over the sample; a centroid without rows stays where it was."""
    c = m[np.linspace(0, len(m) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(m, c)[0]
        total, n = np.zeros_like(c), np.bincount(own, minlength=k)
        np.add.at(total, own, m)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid and its distance."""
    own = np.concatenate([np.zeros(0, np.int64), *(((c**2).sum(1) - 2 * m[p : p + vb.OFFER] @ c.T).argmin(1) for p in range(0, len(m), vb.OFFER))])
    return own, np.linalg.norm(m - c[own], axis=1)


class Lists:
    """What an anchor knows of the inverted lists: for each length of vector the clusters, centroids and radii."""

    def __init__(self, fitted: dict[int, np.ndarray], rows):
        self.of = {}
        for r in sorted(rows, key=lambda r: (r.dim, r.cluster)):
            self.of.setdefault(r.dim, []).append((r.cluster, r.radius))
        self.of = {d: (np.array([c for c, _ in x], np.int32), fitted.get(d, np.zeros((1, d)))[[c for c, _ in x]], np.array([r for _, r in x]) * (1 + 1e-9) + 1e-6) for d, x in self.of.items()}

    def bounds(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(clusters, lower, upper): bounds of the inner products of each row of m with the rows of each list."""
        clusters, c, radius = self.of[m.shape[1]]
        middle, reach = m @ c.T, np.linalg.norm(m, axis=1)[:, None] * radius[None]
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
        return clusters, middle - reach - slack, middle + reach + slack


def first_wave(upper: np.ndarray, useful: np.ndarray) -> np.ndarray:
    """Which lists are the WAVE useful ones with the highest upper bounds, for each anchor."""
    order = np.argsort(-np.where(useful, upper, -np.inf), axis=1, kind="stable")[:, :WAVE]
    out = np.zeros(upper.shape, bool)
    np.put_along_axis(out, order, True, axis=1)
    return out & useful


def inverted_lists(rows: DataFrame, size: int = SAMPLE) -> tuple[DataFrame, Lists]:
    """(dim, cluster, vec_id, label, embedding, distance, block) of every row, and the lists' bounds."""
    spark = rows.sparkSession
    shape = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a length of vector
    size = max(64, min(size, vb.BLOCK_VALUES // max([1, *shape])))
    fitted = {d: centroids(m, max(1, min(CENTROIDS, len(m), int(shape[d] ** 0.5 / 2)))) for d, (_, m) in vb.sample(rows, size, sum(shape.values())).items()}
    shared = spark.sparkContext.broadcast(fitted)

    def enter(batches):
        for batch in batches:
            for at, m in vb.by_length(batch):
                own, distance = nearest(m, shared.value.get(m.shape[1], np.zeros((1, m.shape[1]))))
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(own.astype(np.int32)), part.column("vec_id"), part.column("label"), part.column("embedding"), pa.array(distance)], ["dim", "cluster", "vec_id", "label", "embedding", "distance"])

    listed = written(rows.select("vec_id", "dim", "embedding", "label").mapInArrow(enter, LIST), "lists")
    radii = listed.groupBy("dim", "cluster").agg(F.max("distance").alias("radius")).collect()  # a row a centroid
    return listed, Lists(fitted, radii)


def visits(anchors: DataFrame, lists: Lists, chosen, state: str) -> DataFrame:
    """(dim, cluster, vec_id, part): chosen(batch, matrix, clusters, lower, upper) says which lists each anchor visits."""
    shared = anchors.sparkSession.sparkContext.broadcast(lists)

    def plan(batches):
        for batch in batches:
            for at, m in vb.by_length(batch):
                part = batch.take(pa.array(at))
                clusters, lower, upper = shared.value.bounds(m)
                a, c = np.nonzero(chosen(part, clusters, lower, upper))
                yield pa.RecordBatch.from_arrays([part.column("dim").take(pa.array(a)), pa.array(clusters[c]), part.column("vec_id").take(pa.array(a)), part.column("part").take(pa.array(a))], ["dim", "cluster", "vec_id", "part"])

    return anchors.select("vec_id", "dim", "embedding", "part", state).mapInArrow(plan, "dim int, cluster int, vec_id long, part int")


def search(anchors: DataFrame, seen: DataFrame, lists: DataFrame, meet, state: str, out: str) -> DataFrame:
    """meet(anchors, rows), both Arrow tables, for each block of a list and each block of the anchors that visit it."""
    # a row a centroid; an array holds the numbers of blocks of anchors
    parts = seen.groupBy("dim", "cluster").agg(F.collect_set("part").alias("parts"))
    offered = lists.join(F.broadcast(parts), ["dim", "cluster"]).withColumn("part", F.explode("parts")).select("dim", "cluster", "block", "part", "vec_id", "label", "embedding")
    blocks = lists.groupBy("dim", "cluster").agg(F.max("blocks").alias("blocks"))
    asked = seen.join(F.broadcast(blocks), ["dim", "cluster"]).join(anchors.select("vec_id", "label", "embedding", state), "vec_id").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).select("dim", "cluster", "block", "part", "vec_id", "label", "embedding", state)
    key = ["dim", "cluster", "block", "part"]
    schema = pa.schema([(f.name, pa.int64()) for f in asked.sparkSession.createDataFrame([], out).schema])

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return schema.empty_table()
        b = b.sort_by("vec_id")
        return meet(a, b, vb.matrix(a.column("embedding")), vb.matrix(b.column("embedding"))).cast(schema)

    return asked.groupBy(*key).cogroup(offered.groupBy(*key)).applyInArrow(both, out)


def first_rows(found: DataFrame, by: list[str], k: int, score: str, who: str) -> DataFrame:
    """The first k of each group: higher scores first, then smaller ids."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), who)))
    return ranked.where(F.col("rank") <= k)


def positives(anchors: DataFrame, listed: DataFrame, lists: Lists, k: int) -> DataFrame:
    """anchors with positives: each one's first k other rows of its label, by inner product."""

    def meet(a, b, am, bm):
        al, bl, ai, bi = (t.column(c).to_numpy() for c in ("label", "vec_id") for t in (a, b))
        who, other, scores = [], [], []
        for p in range(0, len(am), vb.ASK):
            s = slice(p, p + vb.ASK)
            for r in range(0, len(bm), vb.OFFER):
                t = slice(r, r + vb.OFFER)
                allowed = (al[s, None] == bl[None, t]) & (ai[s, None] != bi[None, t])
                if allowed.any():
                    score = vb.products(am[s], bm[t])
                    q, c = vb.best(score, allowed, k)
                    top = vb.first(k, q, score[q, c], bi[t][c])
                    who, other, scores = [*who, ai[s][q[top]]], [*other, bi[t][c[top]]], [*scores, score[q, c][top]]
        return pa.table({"vec_id": np.concatenate([np.zeros(0, np.int64), *who]), "positive_id": np.concatenate([np.zeros(0, np.int64), *other]), "positive_score": np.concatenate([np.zeros(0, np.int64), *scores])})

    def best_lists(part, clusters, lower, upper):
        return first_wave(upper, np.ones(upper.shape, bool))

    def the_rest(part, clusters, lower, upper):
        kth = part.column("kth")
        bound = np.where(kth.is_valid().to_numpy(zero_copy_only=False), kth.fill_null(0).to_numpy().astype(np.float64), -np.inf)
        return ~best_lists(part, clusters, lower, upper) & (upper >= bound[:, None])

    out = "vec_id long, positive_id long, positive_score long"
    start = anchors.withColumn("kth", F.lit(None).cast("long"))
    near = written(first_rows(search(start, visits(start, lists, best_lists, "kth"), listed, meet, "kth", out), ["vec_id"], k, "positive_score", "positive_id").drop("rank"), "positives")
    known = near.groupBy("vec_id").agg(F.when(F.count("*") >= k, F.min("positive_score")).alias("kth"))
    known = written(anchors.join(known, "vec_id", "left"), "anchors")
    rest = search(known, visits(known, lists, the_rest, "kth"), listed, meet, "kth", out)
    return written(first_rows(near.unionByName(rest), ["vec_id"], k, "positive_score", "positive_id").drop("rank"), "positives")


def lowest(high: np.ndarray, percent: int) -> np.ndarray:
    """The least score s with percent * high <= 100 * s."""
    return -((-percent * high) // 100)


def negatives(anchors: DataFrame, listed: DataFrame, lists: Lists, k: int, percent: int) -> DataFrame:
    """(vec_id, high, negative_id, negative_score): for each score high among an anchor's windows (array of <high, kth>)
    the first k rows of other labels with percent * high <= 100 * score <= 100 * high."""

    def windows(part):
        """(anchor's place, high, low, k-th score known or low) of every window of a batch."""
        column = part.column("windows")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat = column.flatten()
        high, kth = flat.field("high").to_numpy(zero_copy_only=False), flat.field("kth")
        at = np.repeat(np.arange(len(part)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        low = lowest(high, percent)
        return at, high, low, np.where(kth.is_valid().to_numpy(zero_copy_only=False), kth.fill_null(0).to_numpy(), low)

    def meet(a, b, am, bm):
        al, bl, ai, bi = (t.column(c).to_numpy() for c in ("label", "vec_id") for t in (a, b))
        at, high, low, _ = windows(a)
        who, top_score, other, scores = [], [], [], []
        for p in range(0, len(am), vb.ASK):
            own = np.flatnonzero((at >= p) & (at < p + vb.ASK))
            if not len(own):
                continue
            for r in range(0, len(bm), vb.OFFER):
                t = slice(r, r + vb.OFFER)
                score = vb.products(am[p : p + vb.ASK], bm[t])
                differs = al[p : p + vb.ASK, None] != bl[None, t]
                for w in range(0, len(own), vb.ASK):
                    v = own[w : w + vb.ASK]
                    s = score[at[v] - p]
                    q, c = vb.best(s, differs[at[v] - p] & (s >= low[v, None]) & (s <= high[v, None]), k)
                    top = vb.first(k, q, s[q, c], bi[t][c])
                    q, c = q[top], c[top]
                    who, top_score, other, scores = [*who, ai[at[v[q]]]], [*top_score, high[v[q]]], [*other, bi[t][c]], [*scores, s[q, c]]
        return pa.table({n: np.concatenate([np.zeros(0, np.int64), *x]) for n, x in (("vec_id", who), ("high", top_score), ("negative_id", other), ("negative_score", scores))})

    def holding(part, lower, upper, from_kth: bool):
        """Lists that some window of the anchor still needs."""
        at, high, low, kth = windows(part)
        need = np.zeros(upper.shape, bool)
        fits = (lower[at] <= high[:, None]) & (upper[at] >= (kth if from_kth else low)[:, None]) & (high >= low)[:, None]
        np.logical_or.at(need, at, fits)
        return need

    def best_lists(part, clusters, lower, upper):
        return first_wave(upper, holding(part, lower, upper, False))

    def the_rest(part, clusters, lower, upper):
        return holding(part, lower, upper, True) & ~best_lists(part, clusters, lower, upper)

    out = "vec_id long, high long, negative_id long, negative_score long"
    by = ["vec_id", "high"]
    near = written(first_rows(search(anchors, visits(anchors, lists, best_lists, "windows"), listed, meet, "windows", out), by, k, "negative_score", "negative_id").drop("rank"), "negatives")
    known = near.groupBy(*by).agg(F.when(F.count("*") >= k, F.min("negative_score")).alias("kth"))
    open_windows = anchors.select("vec_id", F.explode("windows.high").alias("high")).join(known, by, "left").groupBy("vec_id").agg(F.collect_list(F.struct("high", "kth")).alias("windows"))
    again = written(anchors.drop("windows").join(open_windows, "vec_id"), "anchors")
    rest = search(again, visits(again, lists, the_rest, "windows"), listed, meet, "windows", out)
    return first_rows(near.unionByName(rest), by, k, "negative_score", "negative_id")


def hard_negatives(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, percent: int = 80, id_col: str = "vec_id", vector_col: str = "embedding", label=None) -> DataFrame:
    """For each row whose id is divisible by every, and each of its first n_positives other rows of the same label, the
    first n_negatives rows of other labels that score within percent and 100 % of the positive.

    Scores are inner products of floor(256 x); higher ones come first, ties go to the smaller id. label is a column
    (default: that of the table named label). Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score; a positive without such rows has none, as one with a negative score can't have any. Null ids, labels
    and vectors and vectors with null or non-finite components take no part; of rows that repeat an id the smallest
    (vector, label) stands. Vectors of different lengths never meet. Other columns aren't looked at.
    """
    rows = vb.integer_rows(vectors, id_col, vector_col, F.col("label") if label is None else label)
    listed, lists = inverted_lists(rows)
    block = F.greatest(F.lit(16), F.floor(F.lit(vb.BLOCK_VALUES) / F.greatest("dim", F.lit(1))))
    sizes = F.broadcast(listed.groupBy("dim", "cluster").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"))  # a row a centroid
    listed = listed.join(sizes, ["dim", "cluster"]).withColumn("block", F.expr("CAST(pmod(xxhash64(vec_id), blocks) AS int)"))
    anchors = rows.where(F.col("vec_id") % every == 0)
    per = F.broadcast(anchors.groupBy("dim").agg(F.ceil(F.count("*") / F.first(block)).cast("int").alias("many")))  # a row a length of vector
    anchors = anchors.join(per, "dim").withColumn("part", F.expr("CAST(pmod(xxhash64(vec_id, 2), many) AS int)")).drop("many")
    liked = positives(anchors, listed, lists, n_positives)
    asked = liked.groupBy("vec_id").agg(F.transform(F.collect_set("positive_score"), lambda s: F.struct(s.alias("high"), F.lit(None).cast("long").alias("kth"))).alias("windows"))
    hard = negatives(written(anchors.join(asked, "vec_id"), "asked"), listed, lists, n_negatives, percent)
    out = liked.join(hard.withColumnRenamed("high", "positive_score"), ["vec_id", "positive_score"])
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each 100th vector id."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS bigint) + 1) % 10 ELSE CAST(label AS bigint) END")
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_dot_product(a.e, o.e) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
