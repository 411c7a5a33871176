"""Similarity join of word-shingle sets by chosen paths.

Sets are embedded as COORDINATES minhash values. The join is a recursion over buckets of sets: in each run, a bucket
that is still large picks one or two of the coordinates by a hash of its own path, and every set moves into the child
named by its value there, the token it shares with the sets that it meets. The recursion ends at buckets of at most
LEAF sets, where sketches are compared by brute force, and at larger ones that hold more than ALIKE of the bucket above:
their sets agree nearly everywhere, as copies do, and no path would part them. The deeper the recursion went, the less
often a pair meets, so runs repeat with other paths until a pair at the threshold is met with the target recall; those
beyond the plan take only the sets that stood in deep buckets.

Sets that met and look alike form clusters. Within a cluster all pairs are verified by exact intersections, so pairs that
no leaf held are found too, where that is little work beside the pairs that met: a set has BLOCK others of its cluster for
each time that it met another, at most. A sparser one, a chain of texts that each share something with the next, is cut
into blocks of sets that stood in one leaf, and only those pairs of blocks are verified of which two sets met and look
alike: the work follows the pairs that met, not the square of the cluster. A pair of sets lies in one pair of blocks, so
none is counted twice. Equal sets are one entry with a count. Large leaves and clusters are dealt out as pairs of blocks;
tasks return sums, spanning forests and pairs of blocks, never pairs of sets.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .anchors import bucket_count
from .components import components, contracted
from .embedding_dedup import _forest
from .shared import attach, in_tasks, written

SHINGLE = 5
COORDINATES = 64
LEAF = 50
#: Depth that the first runs are planned for; how deep they go is up to the sets.
DEPTH = 3
#: A bucket with more than this share of its parent's sets isn't parted further.
ALIKE = 0.75
LEAF_BLOCK, BLOCK = 256, 128
#: Share of equal coordinates below the threshold that still counts as alike: four standard deviations.
SLACK = 4.0
PIECE = 1_500_000
COLUMNS = 8192
WORD, WHOLE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
FACTORS, TERMS = (ta.mix(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(k)).astype(np.uint32) | np.uint32(1) for k in (10_000, 20_000))


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each text, sorted, and where texts start in them (n + 1 values).

    A text with fewer words than a shingle has the run of all its words as its only one, if it has any.
    """
    data, offsets = ta.text_bytes(column)
    starts, ends, bounds = ta.word_spans(data, offsets)
    words = ta.span_hashes(ta.BYTE_VALUES[data], starts, ends, WORD)
    count = np.diff(bounds)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    text, at = np.repeat(np.arange(len(n)), n), ta.within(n)
    i = bounds[text] + at
    h = ta.span_hashes(words, i, i + np.minimum(count[text], size), WHOLE)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])][: len(h)]
    return h[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def sketches(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minhash values of nonempty sets: n x COORDINATES."""
    low = (h >> np.uint64(32)).astype(np.uint32)
    return np.stack([np.minimum.reduceat(low * f + t, starts) for f, t in zip(FACTORS, TERMS, strict=True)], 1)


def survival(similarity: float, depth: int) -> float:
    """How likely a pair meets in a bucket of this depth: one coordinate, or two with the odds that 1/similarity asks."""
    p, second = 1.0, 1 / similarity - 1
    for _ in range(depth):
        q = similarity * p
        p = (1 - second) * q + second * (1 - (1 - q) ** 2)
    return p


def children(node: np.ndarray, sketch: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of the sets in their buckets: the bucket's path chooses the coordinates, the values the child."""
    choice = ta.mix(node ^ np.uint64(0x5851F42D4C957F2D))
    one = (choice % np.uint64(COORDINATES)).astype(np.int64)
    other = (one + 1 + ((choice >> np.uint64(16)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    twice = np.flatnonzero((choice >> np.uint64(32)).astype(np.float64) / 2**32 < 1 / similarity - 1)
    row, coordinate = np.r_[np.arange(len(node)), twice], np.r_[one, other[twice]]
    value = sketch[row, coordinate].astype(np.uint64)
    return row, ta.mix(ta.mix(node[row] + np.uint64(1) + coordinate.astype(np.uint64)) ^ value)


def in_block_pairs(rows: DataFrame, group: str, key: str, block: int, buckets: int) -> DataFrame:
    """rows (with size, its group's rows) repeated for each pair of blocks of its group: block, i, j, bucket."""
    cut = rows.withColumn("blocks", F.expr(f"CAST(ceil(size / {block}) AS int)")).withColumn("block", F.expr(f"CAST(pmod(xxhash64({key}), blocks) AS int)"))
    cut = cut.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return cut.drop("other", "blocks", "size").withColumn("bucket", F.expr(f"CAST(pmod(xxhash64({group}, i, j), {buckets}) AS int)"))


def _groups(table: pa.Table, group: str):
    """The table sorted by (group, i, j), and the slices of its groups with more than one row."""
    keys = [table.column(k).to_numpy() for k in (group, "i", "j")]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.r_[True, (np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0) | (np.diff(keys[2]) != 0)]
    at = np.flatnonzero(new)
    n = np.diff(np.r_[at, len(new)])
    return table.take(pa.array(order)).combine_chunks(), [slice(a, a + k) for a, k in zip(at.tolist(), n.tolist(), strict=True) if k > 1]


def _across(block: np.ndarray, i: int, j: int, n: int) -> np.ndarray:
    """Which pairs of rows a pair of blocks owns: rows of one block with each other, or of one with the other."""
    own = np.triu(np.ones((n, n), bool), 1)
    return own if i == j else own & (block[:, None] != block[None, :])


def candidates(sets: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, met) of forests over sets (rep long, sketch binary) that met and look alike, and the leaves (node, rep,
    size) in which they met. met adds up to the number of meetings, a pair's in each leaf."""
    buckets = bucket_count(sets)
    needed = lambda depth: max(1, ceil(log(1 - recall) / log(1 - min(survival(threshold, depth), 0.999))))
    alike = least_alike(threshold)

    def split(batches, runs):
        for batch in batches:
            if not batch.num_rows:
                continue
            reps = batch.column("rep").to_numpy()
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            paths = [batch.column("node").to_numpy().view(np.uint64)] if "node" in batch.schema.names else [np.full(len(reps), ta.mix(np.array([r + 1], np.uint64))[0]) for r in runs]
            for node in paths:
                row, child = children(node, sketch, threshold)
                above = batch.column("size").to_numpy()[row] if "node" in batch.schema.names else np.full(len(row), 1 << 62)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(reps[row]), pa.array(above)], ["node", "rep", "above"])

    def recursed(own: DataFrame, runs: range) -> tuple[DataFrame, int, DataFrame | None]:
        """The leaves (node, rep, size) of some runs over own sets, their depth, and the sets that went beyond DEPTH."""
        kind, leaves, deep, depth = "node long, rep long, above long", None, None, 0
        level = own.select("rep", "sketch").mapInArrow(lambda batches: split(batches, runs), kind)
        while True:
            depth += 1
            # a set is in a bucket once: the names of buckets hash the bucket above and the coordinate, and two coordinates differ
            level = written(level, f"paths{depth}")
            sizes = level.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
            sized = attach(level, sizes.withColumn("size", F.col("n")), "node", "n", "rep").where("size > 1")
            sized = written(in_tasks(sized, level.count()), f"nodes{depth}")
            parted = (F.col("size") > LEAF) & (F.col("size") <= ALIKE * F.col("above"))
            done = sized.where(~parted).select("node", "rep", "size")
            leaves = done if leaves is None else leaves.unionByName(done)
            large = sized.where(parted)
            many = large.count()
            if depth == COORDINATES or not many:
                return leaves, depth, deep
            if depth == DEPTH:
                deep = large.select("rep").distinct()
            drawn = large.select("node", "rep", "size").join(sets.select("rep", "sketch"), "rep").select("node", "rep", "size", "sketch")
            level = in_tasks(drawn, many).mapInArrow(lambda batches: split(batches, runs), kind)

    leaves, deepest, deep = recursed(sets, range(needed(DEPTH)))
    ran = needed(DEPTH)
    # only sets that stood in deeper buckets meet less often than planned
    while deep is not None and ran < needed(deepest):
        runs = range(ran, needed(deepest))
        more, depth, deep = recursed(written(sets.join(deep, "rep").select("rep", "sketch"), "deep"), runs)
        ran, deepest, leaves = runs.stop, max(deepest, depth), leaves.unionByName(more)

    def forests(table: pa.Table) -> pa.Table:
        a, b, met = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for reps, g, x, y in meetings(table, alike):
            root = _forest(g.stop - g.start, x, y)
            far = np.flatnonzero(root != np.arange(g.stop - g.start))
            a.append(reps[g][far])
            b.append(reps[g][root[far]])
            met.append(np.where(np.arange(len(far)) == 0, len(x), 0))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "met": np.concatenate(met)})

    rows = in_block_pairs(leaves, "node", "rep", LEAF_BLOCK, buckets).join(sets.select("rep", "sketch"), "rep")
    return rows.groupBy("bucket").applyInArrow(forests, "a long, b long, met long"), leaves


def least_alike(threshold: float) -> int:
    """How many equal coordinates count as alike."""
    return int(np.floor(COORDINATES * (threshold - SLACK * (threshold * (1 - threshold) / COORDINATES) ** 0.5)))


def meetings(table: pa.Table, alike: int):
    """For each group of a table (node, rep, sketch, block, i, j) with pairs of alike sketches: the table's column rep, the
    group's slice and the pairs' places in it."""
    table, groups = _groups(table, "node")
    reps, block, i, j = (table.column(k).to_numpy() for k in ("rep", "block", "i", "j"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES)
    for g in groups:
        s, n = sketch[g], g.stop - g.start
        if n <= 32:
            equal = (s[:, None] == s[None]).sum(2)
        else:
            equal = np.zeros((n, n), np.int16)
            for c in range(COORDINATES):
                equal += s[:, c, None] == s[None, :, c]
        x, y = np.nonzero((equal >= alike) & _across(block[g], i[g][0], j[g][0], n))
        if len(x):
            yield reps, g, x, y


def met_blocks(leaves: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(homes, pairs) of the sets in leaves (node, rep, size): homes (rep, home) deals them into blocks of about BLOCK at
    most, and pairs (i, j), i <= j, lists the blocks of which two sets met and look alike, and each block with itself.

    A set's home is the one of its leaves with the least name; a leaf of more than BLOCK sets is several homes.
    """
    buckets, alike = bucket_count(sets), least_alike(threshold)
    first = leaves.groupBy("rep").agg(F.min(F.struct("node", "size")).alias("f"))
    homes = written(first.select("rep", F.expr(f"xxhash64(f.node, pmod(xxhash64(rep), CAST(ceil(f.size / {BLOCK}) AS bigint)))").alias("home")), "homes")
    rows = in_block_pairs(leaves, "node", "rep", LEAF_BLOCK, buckets).join(homes, "rep").join(sets.select("rep", "sketch"), "rep")

    def pairs(table: pa.Table) -> pa.Table:
        out = [np.zeros((2, 0), np.int64)]
        home = dict(zip(table.column("rep").to_pylist(), table.column("home").to_pylist(), strict=True))
        for reps, g, x, y in meetings(table, alike):
            own = np.array([home[r] for r in reps[g].tolist()], np.int64)
            out.append(np.unique(np.sort(np.stack([own[x], own[y]]), axis=0), axis=1))
        i, j = np.unique(np.concatenate(out, 1), axis=1)
        return pa.table({"i": i, "j": j})

    found = rows.groupBy("bucket").applyInArrow(pairs, "i long, j long")
    return homes, written(found.unionByName(homes.select(F.col("home").alias("i"), F.col("home").alias("j"))).distinct(), "pairs")


def jaccard_join(docs: DataFrame, threshold: float = 0.8, shingle: int = SHINGLE, recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate texts: Jaccard similarity >= threshold of the sets of `shingle`-word runs.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Returns a row for each id: doc_id, n_shingles, n_links (other documents
    linked directly), class_id (smallest id reachable by links), kept (doc_id = class_id). Texts without words, null
    ones too, link with nothing; a text of fewer words than a shingle has one, of all its words. Rows with a null id
    are left out; of several rows with one id, the one whose text has the smallest 64-bit hash stands for it.
    """
    buckets = bucket_count(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL").withColumn("version", F.xxhash64("text"))

    def embed(batches):
        for piece in (p for b in batches for p in ta.pieces([b], PIECE)):
            h, bounds = shingle_sets(piece.column("text"), shingle)
            n = np.diff(bounds)
            full = n > 0
            at = bounds[:-1][full]
            p, q, sketch = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), [None] * len(n)
            if len(at):
                p[full], q[full] = np.add.reduceat(ta.mix(h), at), np.bitwise_xor.reduceat(ta.mix(h + np.uint64(7)), at)
                for i, s in zip(np.flatnonzero(full).tolist(), sketches(h, at), strict=True):
                    sketch[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("version"), pa.array(n), pa.array(p.view(np.int64)), pa.array(q.view(np.int64)), pa.array(sketch, pa.binary())], ["doc_id", "version", "n", "p", "q", "sketch"])

    embedded = rows.mapInArrow(embed, "doc_id long, version long, n long, p long, q long, sketch binary")
    sets = written(embedded.groupBy("doc_id").agg(F.min(F.struct("version", "n", "p", "q", "sketch")).alias("s")).select("doc_id", "s.*"), "sets")
    many = sets.count()
    same = F.struct("n", "p", "q").alias("same")
    groups = sets.where("n > 0").groupBy(same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    members = attach(sets.select("doc_id", "version", "n", same), groups.withColumn("group", F.col("copies")), "same", "copies", "doc_id")
    members = members.select("doc_id", "version", "n", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("group", F.lit(1).cast("long")).alias("copies"))
    members = written(in_tasks(members, many), "members")
    reps = members.where("doc_id = rep AND n > 0")
    drawn = written(in_tasks(reps.select("rep").join(sets.select(F.col("doc_id").alias("rep"), "sketch"), "rep"), many), "drawn")
    met, leaves = candidates(drawn, threshold, recall)
    met = written(met, "met")
    clusters = components(contracted(met))
    meets = met.where("met > 0").join(clusters, F.col("a") == F.col("node")).groupBy("component").agg(F.sum("met").alias("met"))
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n_cluster")).join(meets, "component")
    sparse = (F.col("n_cluster") > BLOCK) & (F.col("n_cluster") * F.col("n_cluster") > BLOCK * F.col("met"))
    sized = attach(clusters, sizes.select("component", "n_cluster", F.col("n_cluster").alias("size"), sparse.alias("sparse")), "component", "n_cluster", "node")
    wanted = sized.join(reps, sized.node == reps.rep).select("doc_id", "version", "copies", F.col("component").alias("cluster"), "size", "sparse")
    wanted = written(in_tasks(wanted, many), "wanted")
    chains = wanted.where("sparse").select(F.col("doc_id").alias("rep"))
    dense = wanted.where("NOT sparse").withColumn("blocks", F.expr(f"CAST(ceil(size / {BLOCK}) AS bigint)")).withColumn("block", F.expr("pmod(xxhash64(doc_id), blocks)"))
    dense = dense.withColumn("sides", F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))))
    held = ["doc_id", "version", "copies", "cluster", "block", "sides"]
    placed = dense.select(*held)
    if not chains.isEmpty():
        homes, pairs = met_blocks(leaves.join(chains, "rep", "left_semi"), drawn, threshold)
        # the pairs of blocks that a set takes part in
        sides = pairs.select(F.col("i").alias("block"), "i", "j").unionByName(pairs.where("i <> j").select(F.col("j").alias("block"), "i", "j"))
        sides = sides.groupBy("block").agg(F.collect_list(F.struct("i", "j")).alias("sides"))
        own = wanted.where("sparse").join(homes.select(F.col("rep").alias("doc_id"), F.col("home").alias("block")), "doc_id")
        placed = placed.unionByName(own.join(sides, "block").select(*held))

    def load(batches):
        for piece in (p for b in batches for p in ta.pieces([b], PIECE)):
            h, bounds = shingle_sets(piece.column("text"), shingle)
            cut = zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in ("doc_id", "copies", "cluster", "block", "sides")), pa.array([h[a:b].tobytes() for a, b in cut], pa.binary())], ["doc_id", "copies", "cluster", "block", "sides", "tokens"])

    # both sides are shuffled whatever their size, so that the plan is the same at any
    loaded = rows.join(placed.hint("merge"), ["doc_id", "version"]).select("doc_id", "copies", "cluster", "block", "sides", "text").mapInArrow(load, "doc_id long, copies long, cluster long, block long, sides array<struct<i:long,j:long>>, tokens binary").dropDuplicates(["doc_id"])
    blocks = loaded.select("doc_id", "copies", "cluster", "block", "tokens", F.inline("sides")).withColumn("bucket", F.expr(f"CAST(pmod(xxhash64(cluster, i, j), {buckets}) AS int)"))

    def verify(table: pa.Table) -> pa.Table:
        table, groups = _groups(table, "cluster")
        ids, copies, block, i, j = (table.column(k).to_numpy() for k in ("doc_id", "copies", "block", "i", "j"))
        tokens = table.column("tokens")
        out = [], [], []
        for g in groups:
            parts = [np.frombuffer(x, np.uint64) for x in tokens[g].to_pylist()]
            n = len(parts)
            size = np.array([len(p) for p in parts])
            _, which, seen = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(n), size)
            common = seen[which] > 1
            _, column = np.unique(which[common], return_inverse=True)
            row = row[common]
            inside = np.zeros((n, n))
            for c in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
                part = (column >= c) & (column < c + COLUMNS)
                matrix = np.zeros((n, min(COLUMNS, int(column.max()) + 1 - c)), np.float32)
                matrix[row[part], column[part] - c] = 1
                inside += matrix @ matrix.T
            union = size[:, None] + size[None, :] - inside
            x, y = np.nonzero((inside >= threshold * union - 1e-9) & _across(block[g], i[g][0], j[g][0], n))
            if len(x):
                linked, root = np.unique(np.r_[x, y]), _forest(n, x, y)
                out[0].append(ids[g][linked])
                out[1].append((np.bincount(x, copies[g][y], n) + np.bincount(y, copies[g][x], n))[linked].astype(np.int64))
                out[2].append(ids[g][root[linked]])
        empty = np.zeros(0, np.int64)
        return pa.table({k: np.concatenate([empty, *v]) for k, v in zip(("rep", "links", "root"), out, strict=True)})

    verified = written(blocks.groupBy("bucket").applyInArrow(verify, "rep long, links long, root long"), "verified")
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(contracted(verified.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))))
    found = links.join(classes, links.rep == classes.node).select("rep", "links", "component")
    held = members.groupBy("rep").agg(F.max("copies").alias("held"))
    answers = attach(members, held.join(found, "rep").select("rep", "held", "links", "component"), "rep", "held", "doc_id")
    out = answers.select("doc_id", F.col("n").alias("n_shingles"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("class_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, n_links, class_id, kept for all documents, five-word shingles, similarity 0.8."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
