"""Attention over listed blocks only: tiles in Morton order, windows of tiles, and queries that a mask protects.

Tokens lie on a grid (t, y, x). Tiles of it are put in order, frame by frame and along the Morton curve inside a frame,
so that tokens that follow each other are near each other; runs of tiles are the blocks of queries and of keys. A block
of queries meets the blocks of keys that hold a tile of the window around its centre, and its own; where the dilated
mask touches it, it meets all.

The list of pairs is made first, from tiles alone, by equi-joins: a window names its tiles, a masked token its
neighbours. A block of queries that meets all keys is one row for each chunk of keys, not one for each of their blocks.
Vectors are then sent once for each listed pair of a group of blocks of queries and a chunk of blocks of keys, both of
about ROWS tokens, however many pairs of blocks are listed inside; a task computes only those, and gives one partial
result for each query. A second grouping merges those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelode.operators.tensors import SoftmaxFold

#: Tokens of a group of blocks of queries and of a chunk of blocks of keys, about, and the scores computed at once (32 MB).
ROWS, SCORES = 32_000, 4_000_000
#: Blocks of keys that one task folds at most.
CHUNK = 4096


def morton(y: Column, x: Column, bits: int = 16) -> Column:
    """The bits of y and x interleaved, those of x in the even places."""
    spread = lambda v, odd: [F.shiftleft(F.shiftright(v, i).bitwiseAND(1), 2 * i + odd) for i in range(bits)]
    parts = [*spread(x.cast("long"), 0), *spread(y.cast("long"), 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


class Layout:
    """Tiles of (t, y, x) tokens of a grid whose frames are height x width; blocks are runs of tiles."""

    def __init__(self, height: int, width: int, tile: tuple[int, int, int], query_tiles: int, key_tiles: int):
        if height % tile[1] or width % tile[2]:
            raise ValueError(f"a frame of {height} x {width} isn't made of tiles of {tile[1]} x {tile[2]}")
        self.tile, self.query_tiles, self.key_tiles = tile, query_tiles, key_tiles
        self.down, self.across = height // tile[1], width // tile[2]

    def group(self) -> int:
        """Blocks of queries that one task asks for."""
        return max(1, ROWS // (self.query_tiles * math.prod(self.tile)))

    def chunk(self) -> int:
        """Blocks of keys that one task folds."""
        return max(1, min(CHUNK, ROWS // (self.key_tiles * math.prod(self.tile))))

    def tiles(self, tokens: DataFrame) -> DataFrame:
        """tokens (clip, t, y, x, ...) with the coordinates of their tile: a, b, c."""
        return tokens.withColumns({n: F.expr(f"{v} div {s}") for n, v, s in zip("abc", "tyx", self.tile, strict=True)})

    def ordered(self, tiled: DataFrame) -> DataFrame:
        """Rows with a, b, c and their tile's number in order, and its blocks qb and kb. A frame's tiles, as many as it
        has whatever the clips, are broadcast."""
        codes = sorted((sum(((c >> i & 1) << 2 * i) + ((b >> i & 1) << 2 * i + 1) for i in range(16)), b, c) for b in range(self.down) for c in range(self.across))
        plane = tiled.sparkSession.createDataFrame([(b, c, i) for i, (_, b, c) in enumerate(codes)], "b long, c long, place long")
        number = F.col("a") * (self.down * self.across) + F.col("place")
        out = tiled.withColumns({n: F.col(n).cast("long") for n in "abc"}).join(F.broadcast(plane), ["b", "c"]).withColumn("number", number).drop("place")
        return out.withColumns({"qb": F.expr(f"number div {self.query_tiles}"), "kb": F.expr(f"number div {self.key_tiles}")})


def listed(tokens: DataFrame, layout: Layout, window: tuple[int, int, int]) -> DataFrame:
    """(clip, qb, kb): the blocks of keys that have a tile in the window of tiles around each block of queries, and its own.

    The window is centred on the floored mean of the block's tiles and moved into the grid; tokens: (clip, t, y, x).
    """
    tiles = layout.ordered(layout.tiles(tokens).select("clip", "a", "b", "c").distinct())
    frames = tiles.groupBy("clip").agg((F.max("a") + 1).alias("frames"))
    centres = tiles.groupBy("clip", "qb").agg(*[F.floor(F.sum(n) / F.count("*")).alias(n) for n in "abc"]).join(frames, "clip")
    sizes = {"a": F.col("frames"), "b": F.lit(layout.down), "c": F.lit(layout.across)}
    starts = {n: F.least(F.greatest(F.col(n) - e // 2, F.lit(0)), sizes[n] - e) for n, e in zip("abc", window, strict=True)}
    named = centres.select("clip", "qb", *[s.alias(n) for n, s in starts.items()])
    for n, e in zip("abc", window, strict=True):
        named = named.withColumn(n, F.explode(F.sequence(F.col(n), F.col(n) + (e - 1))))
    inside = named.join(tiles.select("clip", "a", "b", "c", "kb"), ["clip", "a", "b", "c"]).select("clip", "qb", "kb")
    return inside.unionByName(tiles.select("clip", "qb", "kb")).distinct()


def protected(tokens: DataFrame, layout: Layout, kernel: tuple[int, int, int]) -> DataFrame:
    """(clip, qb) of the blocks of queries with a token that lies within kernel (odd sizes) of a token with mask > 0."""
    near = tokens.where("mask > 0").select("clip", "t", "y", "x")
    for n, k in zip("tyx", kernel, strict=True):
        near = near.withColumn(n, F.explode(F.sequence(F.col(n) - k // 2, F.col(n) + k // 2))).distinct()
    return layout.ordered(layout.tiles(near.join(tokens.select("clip", "t", "y", "x"), ["clip", "t", "y", "x"], "left_semi"))).select("clip", "qb").distinct()


def packed_pairs(tokens: DataFrame, layout: Layout, window: tuple[int, int, int], kernel: tuple[int, int, int]) -> DataFrame:
    """(clip, qb, chunk, kbs, protected): the listed blocks of keys of each chunk for each block of queries. A protected
    block of queries has kbs null: every block of the chunk."""
    chunks = layout.ordered(layout.tiles(tokens)).select("clip", F.expr(f"kb div {layout.chunk()}").alias("chunk")).distinct()
    shielded = protected(tokens, layout, kernel)
    whole = shielded.join(chunks, "clip").select("clip", "qb", "chunk", F.lit(None).cast("array<bigint>").alias("kbs"), F.lit(1).alias("protected"))
    some = listed(tokens, layout, window).join(shielded, ["clip", "qb"], "left_anti").groupBy("clip", "qb", F.expr(f"kb div {layout.chunk()}").alias("chunk")).agg(F.collect_list("kb").alias("kbs"))
    return some.withColumn("protected", F.lit(0)).unionByName(whole)


def block_pairs(tokens: DataFrame, layout: Layout, window: tuple[int, int, int], kernel: tuple[int, int, int]) -> DataFrame:
    """(clip, qb, kb, protected): the listed pairs, and every block of keys for each protected block of queries.

    Pairs grow with the square of a clip's protected tokens, as rows of the result; none of them is shuffled, sorted or
    held: a chunk's blocks are one array, met by each block of queries, and those are dealt evenly."""
    packed = packed_pairs(tokens, layout, window, kernel)
    chunk = F.expr(f"kb div {layout.chunk()}").alias("chunk")
    held = layout.ordered(layout.tiles(tokens)).select("clip", "kb").distinct().groupBy("clip", chunk).agg(F.collect_list("kb").alias("every"))
    tasks = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the rows of a chunk are many where a clip is long: they are dealt by their queries, the few arrays go to each task
    dealt = packed.repartition(tasks, "clip", "qb").join(F.broadcast(held), ["clip", "chunk"])
    return dealt.select("clip", "qb", F.explode(F.coalesce("kbs", "every")).alias("kb"), "protected")


def _stacked(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sparse_attention(tokens: DataFrame, pairs: DataFrame, layout: Layout, scale: float) -> DataFrame:
    """(clip, t, y, x, out): softmax over the keys of the listed blocks, times their values.

    tokens (clip, t, y, x, q, k, v: arrays of numbers), pairs (clip, qb, kb) or those of packed_pairs(). A chunk of keys
    is sent to each group of queries that lists some of it; no task holds all keys of a clip. Queries whose block lists
    nothing are left out; a token whose k or v is null is no key, a null q raises.
    """
    placed = layout.ordered(layout.tiles(tokens))
    packed = pairs if "kbs" in pairs.columns else pairs.groupBy("clip", "qb", F.expr(f"kb div {layout.chunk()}").alias("chunk")).agg(F.collect_list("kb").alias("kbs"))
    group = F.expr(f"qb div {layout.group()}").alias("group")
    key = ["clip", "group", "chunk"]
    lists = packed.select("clip", group, "chunk", "qb", "kbs")
    met = lists.select(*key).distinct()
    wide = lambda c: F.col(c).cast("array<double>").alias(c)
    keys = placed.where("k IS NOT NULL AND v IS NOT NULL").select("clip", F.expr(f"kb div {layout.chunk()}").alias("chunk"), "kb", wide("k"), wide("v"))
    sent = met.join(keys, ["clip", "chunk"]).select(*key, "kb", "k", "v")
    asked = met.join(placed.select("clip", group, "qb", "t", "y", "x", wide("q")), ["clip", "group"]).withColumn("asks", F.lit(True))
    left = asked.unionByName(lists.withColumn("asks", F.lit(False)), allowMissingColumns=True)
    kind = dict(tokens.dtypes)
    place = [f"{c} {kind[c]}" for c in ("clip", "t", "y", "x")]

    def partial(a: pa.Table, b: pa.Table) -> pa.Table:
        asks = a.column("asks")
        own, rows = a.filter(pc.invert(asks)), a.filter(asks)
        if rows.column("q").null_count:
            raise ValueError("a query of sparse_attention has no vector")
        at, found = [], []
        if len(rows) and len(b):
            q, k, v, qb, kb = _stacked(rows.column("q")), _stacked(b.column("k")), _stacked(b.column("v")), rows.column("qb").to_numpy(), b.column("kb").to_numpy()
            numbers, kbs = own.column("qb").to_numpy(), own.column("kbs").combine_chunks()
            # those that ask for the whole chunk do so together
            whole = kbs.is_null().to_numpy(zero_copy_only=False)
            asking = [(np.flatnonzero(np.isin(qb, numbers[whole])), None)]
            asking += [(np.flatnonzero(qb == numbers[i]), np.flatnonzero(np.isin(kb, kbs[i].values.to_numpy()))) for i in np.flatnonzero(~whole)]
            for who, what in asking:
                if what is not None and not len(what):
                    continue
                k1, v1 = (k, v) if what is None else (k[what], v[what])
                step = max(1, SCORES // len(k1))
                for i in range(0, len(who), step):
                    score = q[who[i : i + step]] @ k1.T
                    score *= scale
                    top = score.max(1)
                    score -= top[:, None]
                    np.exp(score, out=score)
                    at.append(who[i : i + step])
                    found.append((top, score.sum(1), score @ v1))
        if not at:
            return rows.slice(0, 0).select(["clip", "t", "y", "x", "qb"]).append_column("top", pa.array([], pa.float64())).append_column("norm", pa.array([], pa.float64())).append_column("part", pa.array([], pa.list_(pa.float64())))
        top, norm, part = (np.concatenate(x) for x in zip(*found, strict=True))
        lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1], part.ravel())
        return rows.select(["clip", "t", "y", "x", "qb"]).take(np.concatenate(at)).append_column("top", pa.array(top)).append_column("norm", pa.array(norm)).append_column("part", lists)

    # both come from pairs: the copies of its columns get ids of their own
    parts = left.toDF(*left.columns).groupBy(*key).cogroup(sent.toDF(*sent.columns).groupBy(*key)).applyInArrow(partial, ", ".join([*place, "qb long, top double, norm double, part array<double>"]))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = SoftmaxFold()
        for batch in batches:
            ids = list(zip(*(batch.column(c).to_pylist() for c in ("clip", "t", "y", "x")), strict=True))
            fold.add(ids, batch.column("top").to_numpy(), batch.column("norm").to_numpy(), batch.column("part"))
        if fold.order:
            places = [pa.array(c, k) for c, k in zip(zip(*fold.order, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*places, pa.array(list(fold.part / fold.norm[:, None]), pa.list_(pa.float64()))], ["clip", "t", "y", "x", "out"])

    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind[c]] for c in ("clip", "t", "y", "x")]
    return parts.groupBy("clip", "qb").applyInArrow(merged, ", ".join([*place, "out array<double>"]))
