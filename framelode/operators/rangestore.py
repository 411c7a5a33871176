"""A frame store by ranges: commits of ranges in any number, of which the latest owns each frame.

Commits are rows (clip, version, start, end), [start, end) of whole frames or of a box of them. Nothing here makes a row
for each frame of a commit:

- End points cut a clip into ranges with one owner. Commits are cut at strips of STRIP frames, and a strip is painted in
  one array, the latest version on top; it gives its end points, each with what was painted there. Strips are tied by
  their first points, so no task sees a clip as a whole, and a task holds SIDE_BY_SIDE strips whatever their commits.

- A range is a sum of at most 2 log2(length) nodes of a binary tree over the frame numbers, and a frame lies in one node
  of each level. "Which ranges hold this point" is then an equi-join on (clip, level, node), and the latest of them a
  partial maximum by node. Nodes of one range are disjoint, so each pair of a point and a range meets once.
- Commits of more than LONG frames aren't cut at strips but meet the end points through such nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a strip, those of the longest commit that is cut at strips, and the strips that a task paints at once (10 MB).
STRIP, LONG, SIDE_BY_SIDE = 4096, 64 * 4096, 256


def _nodes(start: str, end: str) -> str:
    """SQL for the nodes (level, node) whose frames are those of [start, end), for numbers of at least 0."""
    left, right = f"shiftright({start} + shiftleft(1L, k) - 1, k)", f"shiftright({end}, k)"
    return (
        f"filter(flatten(transform(sequence(0, CAST(ceil(log2({end} + 1)) AS int)), k -> array("
        f"IF({left} < {right} AND {left} % 2 = 1, struct(k AS level, {left} AS node), NULL), "
        f"IF({left} < {right} AND {right} % 2 = 1, struct(k AS level, {right} - 1 AS node), NULL)))), x -> x IS NOT NULL)"
    )


def covering(ranges: DataFrame) -> DataFrame:
    """ranges (clip, start, end, ...) with a row for each of its nodes: level, node. Empty ranges have none."""
    if (low := ranges.agg(F.min("start")).first()[0]) is not None and low < 0:
        raise ValueError(f"a range starts at {low}")
    return ranges.where("end > start").withColumn("_n", F.explode(F.expr(_nodes("start", "end")))).select("*", "_n.level", "_n.node").drop("_n")


def stabbed(points: DataFrame, ranges: DataFrame, at: str = "frame") -> DataFrame:
    """points (clip, at, ...) with each range (clip, start, end, ...) that holds them; other columns must differ."""
    nodes = covering(ranges)
    levels = nodes.agg(F.max("level")).first()[0]
    if levels is None:
        return points.join(ranges.limit(0).drop("start", "end"), "clip")
    named = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("node", F.expr(f"shiftright({at}, level)"))
    return named.join(nodes.drop("start", "end"), ["clip", "level", "node"]).drop("level", "node")


def latest(points: DataFrame, commits: DataFrame, at: str = "frame") -> DataFrame:
    """(clip, at, version) of distinct points: the largest version of the commits that hold each; none, no row.

    A node keeps its largest version before any point meets it, so a node that many commits share is one row.
    """
    nodes = covering(commits.select("clip", "version", "start", "end")).groupBy("clip", "level", "node").agg(F.max("version").alias("version"))
    levels = nodes.agg(F.max("level")).first()[0] or 0
    named = points.select("clip", at).distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("node", F.expr(f"shiftright({at}, level)"))
    return named.join(nodes, ["clip", "level", "node"]).groupBy("clip", at).agg(F.max("version").alias("version"))


def _painted(clip: str, bare: bool, strip: int):
    """For mapInArrow: (clip, start, end, version) of rows (clip, strip, lo, hi, own, version, after) in order of clip and
    strip; bare: also pieces without a version. A row is a commit cut to a strip, which own says it starts in; lo = hi
    only marks; or, without lo, the first point behind the strip."""
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[clip]
    none = np.iinfo(np.int64).min
    schema = pa.schema([("clip", kind), ("start", pa.int64()), ("end", pa.int64()), ("version", pa.int64())])

    def pieces(clips: pa.Array, strips: np.ndarray, owner: np.ndarray, mark: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(mark)
        group = at // strip
        start = strips[group] * strip + at % strip
        last = np.r_[group[1:] != group[:-1], True] if len(at) else np.zeros(0, bool)
        end = np.where(last, after[group], np.r_[start[1:], none] if len(at) else start)
        version = owner.ravel()[at]
        kept = (end != none) & (bare | (version != none))
        return pa.RecordBatch.from_arrays([clips.take(pa.array(group[kept])), pa.array(start[kept]), pa.array(end[kept]), pa.array(version[kept], mask=version[kept] == none)], schema=schema)

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            clips, strips = batch.column("clip"), batch.column("strip").to_numpy()
            moved = pc.not_equal(clips[1:], clips[:-1]).to_numpy(zero_copy_only=False) | (strips[1:] != strips[:-1])
            first = np.r_[0, np.flatnonzero(moved) + 1]
            whole = lambda c, batch=batch: pc.fill_null(batch.column(c), none).to_numpy()
            lo, hi, version, after = (whole(c) for c in ("lo", "hi", "version", "after"))
            own = batch.column("own").to_numpy(zero_copy_only=False)
            for g in range(0, len(first), SIDE_BY_SIDE):
                heads = first[g : g + SIDE_BY_SIDE]
                end = first[g + SIDE_BY_SIDE] if g + SIDE_BY_SIDE < len(first) else len(batch)
                n = len(heads)
                owner, mark, behind = np.full((n, strip), none), np.zeros((n, strip), bool), np.full(n, none)
                row = np.arange(heads[0], end)
                base = np.repeat(np.arange(n), np.diff(np.r_[heads, end])) * strip
                cut = lo[row] != none
                np.maximum.at(behind, base[~cut] // strip, after[row[~cut]])
                row, base = row[cut], base[cut]
                mark.ravel()[(base + lo[row])[own[row]]] = True
                mark.ravel()[(base + hi[row])[hi[row] < strip]] = True
                flat, order = owner.ravel(), np.argsort(version[row], kind="stable")
                order = order[(hi > lo)[row[order]]]
                for i, j, v in zip((base + lo[row])[order].tolist(), (base + hi[row])[order].tolist(), version[row][order].tolist(), strict=True):
                    flat[i:j] = v
                names = clips.take(pa.array(heads))
                if held is not None:
                    if held[0][0] == names[0] and held[1][0] == strips[heads[0]]:
                        np.maximum(owner[0], held[2][0], out=owner[0])
                        mark[0] |= held[3][0]
                        behind[0] = max(behind[0], held[4][0])
                    else:
                        yield pieces(*held)
                if n > 1:
                    yield pieces(names[:-1], strips[heads[:-1]], owner[:-1], mark[:-1], behind[:-1])
                # the last strip may go on in the next batch
                held = names[-1:], strips[heads[-1:]], owner[-1:].copy(), mark[-1:].copy(), behind[-1:]
        if held is not None:
            yield pieces(*held)

    return paint


def committed(commits: DataFrame) -> DataFrame:
    """(clip, start, end, version): the disjoint ranges between end points of commits, each with its latest commit.

    Ranges that no commit holds are left out. Neighbours of one commit stay apart where another one's end, which it has
    overwritten, lies between them. Equal versions are one commit.
    """
    real = commits.where("end > start AND clip IS NOT NULL AND version IS NOT NULL").select("clip", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "version")
    low, longest = real.agg(F.min("start"), F.max(F.col("end") - F.col("start"))).first()
    if low is not None and low < 0:
        raise ValueError(f"a range starts at {low}")
    has_long = longest is not None and longest > LONG
    kind = dict(real.dtypes)
    # a range that many commits share is one row
    same = real.groupBy("clip", "start", "end").agg(F.max("version").alias("version"))
    strips = f"sequence(start div {STRIP}, end div {STRIP})"
    strips = f"IF(end - start > {LONG}, array_distinct(array(start div {STRIP}, end div {STRIP})), {strips})" if has_long else strips
    cut = same.withColumn("strip", F.explode(F.expr(strips)))
    lo, hi = F.expr(f"greatest(start - strip * {STRIP}, 0L)"), F.expr(f"least(end - strip * {STRIP}, {STRIP}L)")
    if has_long:  # their ends are marks, their versions come through nodes
        is_long = F.expr(f"end - start > {LONG}")
        cut = cut.select("clip", "strip", F.explode(F.when(is_long, F.array(*[F.struct(p.alias("lo"), p.alias("hi"), own.alias("own"), F.lit(None).cast("long").alias("version")) for p, own in ((F.col("start") - F.col("strip") * STRIP, F.lit(True)), (F.col("end") - F.col("strip") * STRIP, F.lit(True)))])).otherwise(F.array(F.struct(lo.alias("lo"), hi.alias("hi"), F.expr(f"start div {STRIP} = strip").alias("own"), F.col("version").cast("long").alias("version"))))).alias("_c")).select("clip", "strip", "_c.*").where(f"lo >= 0 AND lo <= {STRIP} - IF(version IS NULL, 1, 0)")
    else:
        cut = cut.select("clip", "strip", lo.alias("lo"), hi.alias("hi"), F.expr(f"start div {STRIP} = strip").alias("own"), F.col("version").cast("long").alias("version"))
    points = same.select("clip", F.explode(F.array("start", "end")).alias("p"))
    firsts = points.groupBy("clip", F.expr(f"p div {STRIP}").alias("strip")).agg(F.min("p").alias("first"))
    onward = firsts.select("clip", "strip", F.lead("first").over(Window.partitionBy("clip").orderBy("strip")).alias("after")).where("after IS NOT NULL")
    told = cut.unionByName(onward.withColumn("own", F.lit(False)), allowMissingColumns=True).repartition("clip", "strip").sortWithinPartitions("clip", "strip")
    found = told.mapInArrow(_painted(kind["clip"], has_long, STRIP), f"clip {kind['clip']}, start long, end long, version long")
    if has_long:
        held = latest(found, real.where(F.expr(f"end - start > {LONG}")), "start").withColumnRenamed("version", "_long")
        found = found.join(held, ["clip", "start"], "left").withColumn("version", F.greatest("version", "_long")).where("version IS NOT NULL")
    return found.select("clip", "start", "end", F.col("version").cast(kind["version"]).alias("version"))


def owned(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """frames (clip, frame, ...) with version, null where no range of committed() holds them, and what other columns the
    ranges have.

    Ranges are cut at strips; inside a strip each frame takes the last range that starts at or before it.
    """
    more = ["version", *[c for c in ranges.columns if c not in ("clip", "start", "end", "version")]]
    cut = ranges.withColumn("strip", F.explode(F.expr(f"sequence(start div {STRIP}, (end - 1) div {STRIP})")))
    starts = cut.select("clip", "strip", F.greatest("start", F.col("strip") * STRIP).alias("_at"), F.struct("end", *more).alias("_own"))
    held = frames.withColumn("strip", F.expr(f"frame div {STRIP}")).withColumn("_at", F.col("frame"))
    both = starts.withColumn("_frame", F.lit(0)).unionByName(held.withColumn("_frame", F.lit(1)), allowMissingColumns=True)
    last = F.last("_own", ignorenulls=True).over(Window.partitionBy("clip", "strip").orderBy("_at", "_frame").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_last", last).where("_frame = 1")
    return found.select(*frames.columns, *[F.when(F.col("frame") < F.col("_last.end"), F.col(f"_last.{c}")).alias(c) for c in more])


def after_resets(commits: DataFrame, resets: DataFrame) -> DataFrame:
    """Commits (clip, version, start, end) as resets (clip, version, start, end) leave them: a reset cuts every earlier
    commit of its clip to its own range. Commits that are cut to nothing are left out."""
    every = commits.select("clip", "version", "start", "end", F.lit(False).alias("_reset")).unionByName(resets.select("clip", "version", "start", "end", F.lit(True).alias("_reset")))
    later = Window.partitionBy("clip").orderBy(F.desc("version"), "_reset").rowsBetween(Window.unboundedPreceding, -1)
    low, high = F.max(F.when(F.col("_reset"), F.col("start"))).over(later), F.min(F.when(F.col("_reset"), F.col("end"))).over(later)
    cut = every.withColumns({"_low": low, "_high": high}).where("NOT _reset")
    return cut.select("clip", "version", F.greatest("start", "_low").alias("start"), F.least("end", "_high").alias("end")).where("end > start")


def appended(pieces: DataFrame, start: int = 0) -> DataFrame:
    """(clip, version, start, end) of pieces appended to an output in order of version, each where the last one ended.

    Empty pieces are left out. A gap or an overlap raises when the rows are computed.
    """
    real = pieces.where("end > start")
    expected = F.coalesce(F.lag("end").over(Window.partitionBy("clip").orderBy("version")), F.lit(start).cast("long"))
    wrong = F.raise_error(F.format_string("clip %s: a contiguous write at %s was given [%s, %s)", F.col("clip").cast("string"), F.col("_expected").cast("string"), F.col("start").cast("string"), F.col("end").cast("string")))
    return real.withColumn("_expected", expected).withColumn("start", F.when(F.col("_expected") == F.col("start"), F.col("start")).otherwise(wrong.cast("long"))).select("clip", "version", "start", "end")


def patched(frames: DataFrame, commits: DataFrame) -> DataFrame:
    """frames (clip, frame, height, width, pixels) of bytes after commits (clip, version, start, end, x, y, w, h, patch).

    patch holds w x h bytes for each frame of [start, end). In order of version each commit overwrites its box; a null x
    overwrites the whole frame (patch: whole frames). A box outside the frame raises. Commits behind a later whole one
    aren't read: only those after the latest whole commit of a frame meet it.
    """
    whole = commits.where("x IS NULL")
    base = owned(frames, committed(whole)).withColumnRenamed("version", "_whole")
    meets = stabbed(base.select("clip", "frame", "_whole"), commits.select("clip", "version", "start", "end", F.col("start").alias("_start"), "x", "y", "w", "h", "patch"))
    late = meets.where("_whole IS NULL OR version >= _whole")
    # only the frame's own bytes go on
    late = late.withColumn("_place", (F.col("frame") - F.col("_start")).cast("int"))
    sized = late.join(frames.select("clip", "frame", (F.col("height") * F.col("width")).alias("_size")), ["clip", "frame"])
    boxed = F.when(F.col("x").isNull(), F.col("_size")).otherwise(F.col("w") * F.col("h")).cast("int")
    own = sized.withColumn("_boxed", boxed).withColumn("patch", F.expr("substring(patch, _place * _boxed + 1, _boxed)"))
    lists = own.groupBy("clip", "frame").agg(F.array_sort(F.collect_list(F.struct("version", "x", "y", "w", "h", "patch"))).alias("_laid"))

    def lay(batches):
        for batch in batches:
            out = []
            laid = batch.column("_laid")
            for raw, height, width, patches in zip(batch.column("pixels"), batch.column("height").to_pylist(), batch.column("width").to_pylist(), laid.to_pylist(), strict=True):
                image = np.frombuffer(raw.as_py(), np.uint8).reshape(height, width).copy()
                for p in patches or ():
                    x, y, w, h = (0, 0, width, height) if p["x"] is None else (p["x"], p["y"], p["w"], p["h"])
                    if x < 0 or y < 0 or x + w > width or y + h > height:
                        raise ValueError(f"patch {x, y, w, h} exceeds frame {width} x {height}")
                    image[y : y + h, x : x + w] = np.frombuffer(p["patch"], np.uint8).reshape(h, w)
                out.append(image.tobytes())
            yield batch.drop_columns(["_laid", "pixels"]).append_column("pixels", pa.array(out, pa.binary()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name != "pixels") + ", pixels binary"
    return frames.join(lists, ["clip", "frame"], "left").select(*[c for c in frames.columns if c != "pixels"], "pixels", "_laid").mapInArrow(lay, schema)
