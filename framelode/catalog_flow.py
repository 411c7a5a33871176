"""Queries over windows that commit, stores by ranges and ordered outputs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelode import bindings as bd
from framelode.catalog import INFER, OVERLAP, _bytes, _folder, query, rounded
from framelode.operators import digests, objects, rangestore, tensors
from framelode.plans import windows
from framelode.sources import frameblocks
from framelode.streaming import carried
from framelode.streaming import frames as streams

# --- windows that commit ------------------------------------------------------------------------------------------

STEP = INFER - OVERLAP
_TWO_SCENES = (
    "sc AS (SELECT clip, num_frames, 0 AS base, 0 AS scene_start, 18 AS scene_end FROM clips UNION ALL SELECT clip, num_frames, 2, 25, num_frames FROM clips), "
    f"si AS (SELECT *, unnest(range(1 + greatest(CAST(ceil((scene_end - scene_start - {INFER}) / {STEP}) AS BIGINT), 0))) AS i FROM sc), "
    f"sw AS (SELECT clip, base + i AS k, scene_end, CASE WHEN i = 0 THEN scene_start ELSE scene_start + {INFER} + (i - 1) * {STEP} END AS ds, CASE WHEN i = 0 THEN 0 ELSE {OVERLAP} END AS ol FROM si), "
    f"pw AS (SELECT clip, k, ds, ds - ol AS ls, ol, ds + least({INFER} - ol, scene_end - ds) AS de, CASE WHEN ds + least({INFER} - ol, scene_end - ds) < scene_end THEN {OVERLAP} ELSE 0 END AS orr FROM sw)"
)


def _two_scenes(spark, sf_dir: str) -> DataFrame:
    """Windows of two scenes a clip, frames 0 to 17 and 25 to the end: what lies between passes."""
    scene = F.explode(F.expr("array(struct(0L AS start, 18L AS length), struct(25L AS start, 1000000L AS length))"))
    spec = bd.clips(spark, sf_dir).select("clip", "num_frames", scene.alias("s")).select("clip", "num_frames", "s.*")
    return windows.window_plan(windows.normalized_scenes(spec), INFER, OVERLAP)


def _edit(pixels, window_index):
    return pixels * 0.5 + 10 + window_index


@query(
    f"{_TWO_SCENES}, s AS (SELECT pw.*, bool_or(kind = 'purchase') AS live FROM pw JOIN frames f ON f.clip = pw.clip AND frame >= ds AND frame < de GROUP BY ALL), "
    "x AS (SELECT s.clip, f.frame, s.k, s.live, f.value AS v, frame - s.ls AS place, s.ol, b.k AS bk, b.live AS bl FROM s JOIN frames f ON f.clip = s.clip AND frame >= s.ls AND frame < s.de - s.orr LEFT JOIN s b ON b.clip = s.clip AND b.k = s.k - 1), "
    "y AS (SELECT *, unnest([v, -v]) AS r, unnest([0, 1]) AS place_in FROM x), "
    f"z AS (SELECT *, CASE WHEN place < ol AND bl THEN r * 0.5 + 10 + bk ELSE r END AS c, CASE WHEN place < ol THEN 1 - place / {OVERLAP - 1} ELSE 0 END AS w FROM y), "
    "o AS (SELECT clip, frame, k AS window_index, live AS changed, place_in, CASE WHEN live THEN w * c + (1 - w) * (c * 0.5 + 10 + k) ELSE r END AS value FROM z) "
    "SELECT clip, frame, window_index, changed, place_in AS place, round(value, 6) AS value FROM o UNION ALL "
    "SELECT clip, frame, NULL, false, unnest([0, 1]), round(unnest([value, -value]), 6) FROM frames WHERE frame >= 18 AND frame < 25",
    "frames",
    "clips",
)
def stream_carried_windows(spark, sf_dir: str) -> DataFrame:
    """Clips in batches of their time, changed window by window: a window sees what the one before has carried over.
    Windows without a purchase are skipped."""
    frames = bd.frames(spark, sf_dir).select("clip", "frame", F.array("value", -F.col("value")).alias("pixels"), (F.col("kind") == "purchase").alias("masked"), "ts")
    folder = _folder(spark, "carried")
    quarter = F.ntile(4).over(Window.orderBy("day"))
    days = frames.select(F.to_date("ts").alias("day")).distinct().withColumn("quarter", quarter)  # as many rows as days
    dealt = frames.withColumn("day", F.to_date("ts")).join(F.broadcast(days), "day").drop("ts", "day")
    dealt.write.partitionBy("quarter").parquet(f"{folder}/dealt")  # frames are numbered once
    dealt = spark.read.schema(dealt.schema).parquet(f"{folder}/dealt")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for q in range(1, 5):  # files in order of time; a batch is as many as a quarter's tasks write at most
        dealt.where(F.col("quarter") == q).drop("quarter").repartition(files, "clip").write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(frames.drop("ts").schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    out = streams.collected(carried.carried_windows(stream, _two_scenes(spark, sf_dir), _edit, "linear"), folder, "append")
    return rounded(out.select("clip", "frame", "window_index", "changed", F.posexplode("pixels").alias("place", "value")), "value")


# --- stores by ranges ---------------------------------------------------------------------------------------------

# a supplier's days are a clip; each line is a commit of as many days as its quantity, later orders are later versions
_COMMITS = "cm AS (SELECT DISTINCT l_suppkey AS clip, ((l_orderkey * 8 + l_linenumber) * 16384 + date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE))) * 64 + CAST(l_quantity AS BIGINT) AS version, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS start, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS stop FROM lineitem)"


def _commits(spark, sf_dir: str) -> DataFrame:
    start = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01")).cast("long")
    n = F.col("l_quantity").cast("long")
    version = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 16384 + start) * 64 + n
    return bd.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("clip"), version.alias("version"), start.alias("start"), (start + n).alias("end"))


_CUT = "pt AS (SELECT DISTINCT clip, unnest([start, stop]) AS p FROM {0} WHERE stop > start), sg AS (SELECT clip, p, lead(p) OVER (PARTITION BY clip ORDER BY p) AS q FROM pt)"


@query(f"WITH {_COMMITS}, {_CUT.format('cm')} SELECT sg.clip, p AS start, q AS \"end\", max(version) AS version FROM sg JOIN cm ON cm.clip = sg.clip AND start <= p AND p < stop WHERE q IS NOT NULL GROUP BY sg.clip, p, q")
def range_store(spark, sf_dir: str) -> DataFrame:
    """The disjoint ranges of each supplier's days, each owned by the latest line that holds it."""
    return rangestore.committed(_commits(spark, sf_dir))


@query(f"WITH {_COMMITS}, f AS (SELECT l_suppkey AS clip, unnest(range(min(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE))), max(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE))) + 60)) AS frame FROM lineitem GROUP BY l_suppkey) SELECT f.clip, f.frame, max(version) AS version, coalesce(max_by(version % 200 + frame - start, version), frame % 256) AS value FROM f LEFT JOIN cm ON cm.clip = f.clip AND start <= frame AND frame < stop GROUP BY f.clip, f.frame")
def range_store_frames(spark, sf_dir: str) -> DataFrame:
    """Every day of every supplier: what the latest commit wrote, and the source where none did."""
    commits = _commits(spark, sf_dir)
    days = commits.groupBy("clip").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    frames = days.select("clip", F.explode(F.expr("sequence(low, high + 59)")).alias("frame"))
    # ranges look up where their commit starts, not frames
    ranges = rangestore.committed(commits).join(commits.select("clip", "version", F.col("start").alias("origin")).distinct(), ["clip", "version"])
    held = rangestore.owned(frames, ranges)
    value = F.coalesce(F.col("version") % 200 + F.col("frame") - F.col("origin"), F.col("frame") % 256)
    return held.select("clip", "frame", "version", value.alias("value"))


_RESETS = "rs AS (SELECT s_suppkey AS clip, 8 * 16384 * 64 * (SELECT max(l_orderkey) FROM lineitem) * (j + 1) // 4 AS version, 700 + 200 * j + s_suppkey % 50 AS start, 3400 - 300 * j AS stop FROM supplier, (SELECT unnest(range(3)) AS j))"


@query(
    f"WITH {_COMMITS}, {_RESETS}, ct AS (SELECT cm.clip, cm.version, greatest(cm.start, max(rs.start)) AS start, least(cm.stop, min(rs.stop)) AS stop FROM cm LEFT JOIN rs ON rs.clip = cm.clip AND rs.version > cm.version GROUP BY cm.clip, cm.version, cm.start, cm.stop), "
    f"{_CUT.format('ct')} SELECT sg.clip, p AS start, q AS \"end\", max(version) AS version FROM sg JOIN ct ON ct.clip = sg.clip AND start <= p AND p < stop WHERE q IS NOT NULL GROUP BY sg.clip, p, q"
)
def range_store_resets(spark, sf_dir: str) -> DataFrame:
    """The store after three resets a supplier, each of which keeps only its own range of what was there."""
    commits = _commits(spark, sf_dir)
    top = bd.table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey").alias("top"))
    spec = bd.table(spark, sf_dir, "supplier").crossJoin(F.broadcast(top)).withColumn("j", F.explode(F.expr("sequence(0L, 2L)")))
    resets = spec.select(F.col("s_suppkey").alias("clip"), F.expr("8 * 16384 * 64 * top * (j + 1) div 4").alias("version"), F.expr("700 + 200 * j + s_suppkey % 50").alias("start"), F.expr("3400 - 300 * j").alias("end"))
    return rangestore.committed(rangestore.after_resets(commits, resets))


@query("WITH c AS (SELECT o_custkey AS clip, o_orderkey AS version, 1 + o_orderkey % 5 AS n FROM orders) SELECT clip, version, CAST(sum(n) OVER w - n AS BIGINT) AS start, CAST(sum(n) OVER w AS BIGINT) AS \"end\" FROM c WINDOW w AS (PARTITION BY clip ORDER BY version)")
def range_append(spark, sf_dir: str) -> DataFrame:
    """Each customer's orders as pieces of one output, which must follow each other."""
    rows = bd.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clip"), F.col("o_orderkey").alias("version"), F.expr("1 + o_orderkey % 5").alias("n"))
    end = F.sum("n").over(Window.partitionBy("clip").orderBy("version"))
    return rangestore.appended(rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("n")))


@query(
    "px AS (SELECT label AS clip, vec_id AS frame, unnest(range(64)) AS place, CAST(least(255, floor(abs(unnest(v)) * 255)) AS BIGINT) AS g FROM vectors), "
    "n AS (SELECT count(*) AS n FROM vectors), "
    "cm AS (SELECT o_custkey % 10 AS clip, o_orderkey AS version, o_orderkey % n AS start, 1 + o_custkey % 7 AS len, o_orderstatus = 'F' AS whole, o_orderkey % 5 AS x, o_custkey % 4 AS y, 1 + o_orderkey % 3 AS w, 1 + o_custkey % 5 AS h FROM orders, n) "
    "SELECT px.clip, frame, place, coalesce(max_by((version + 3 * (frame - start)) % 256, version), g) AS g FROM px LEFT JOIN cm ON cm.clip = px.clip AND start <= frame AND frame < start + len AND (whole OR (place % 8 >= x AND place % 8 < x + w AND place // 8 >= y AND place // 8 < y + h)) GROUP BY px.clip, frame, place, g",
    "vectors",
)
def range_store_patches(spark, sf_dir: str) -> DataFrame:
    """Images after the orders' commits: F writes whole frames, the others a box of some."""
    vectors = bd.vectors(spark, sf_dir)
    byte = F.transform("v", lambda x: F.least(F.lit(255), F.floor(F.abs(x) * 255)))
    frames = vectors.select(F.col("label").cast("long").alias("clip"), F.col("vec_id").alias("frame"), F.lit(8).alias("height"), F.lit(8).alias("width"), byte.alias("b")).select("clip", "frame", "height", "width", _bytes("b").alias("pixels"))
    rows = bd.table(spark, sf_dir, "orders").crossJoin(F.broadcast(vectors.agg(F.count("*").alias("n"))))
    box = {"clip": "o_custkey % 10", "version": "o_orderkey", "start": "o_orderkey % n", "end": "o_orderkey % n + 1 + o_custkey % 7"}
    box |= {c: f"IF(o_orderstatus = 'F', NULL, CAST({e} AS int))" for c, e in (("x", "o_orderkey % 5"), ("y", "o_custkey % 4"), ("w", "1 + o_orderkey % 3"), ("h", "1 + o_custkey % 5"))}
    commits = rows.select(*[F.expr(e).alias(c) for c, e in box.items()])
    values = F.expr("flatten(transform(sequence(0L, end - start - 1), i -> array_repeat((version + 3 * i) % 256, CAST(coalesce(w * h, 64) AS int))))")
    out = rangestore.patched(frames, commits.withColumn("b", values).withColumn("patch", _bytes("b")).drop("b"))
    digits = F.split(F.regexp_replace(F.hex("pixels"), "(..)(?!$)", "$1,"), ",")
    return out.select("clip", "frame", F.posexplode(F.transform(digits, lambda h: F.conv(h, 16, 10).cast("long"))).alias("place", "g"))


# --- ordered outputs ----------------------------------------------------------------------------------------------

_TEXT = "lpad(CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR), 8, '0')"


def _frame_texts(spark, sf_dir: str) -> DataFrame:
    text = F.lpad(F.floor(F.col("value") * 100).cast("string"), 8, "0")
    return bd.frames(spark, sf_dir).select("clip", "frame", text.cast("binary").alias("pixels"))


def _writers(spark, sf_dir: str, least: int, frames: int) -> int:
    """How many tasks write the frames: a task for so many of them, a least number for a small table."""
    return max(least, -(-bd.table(spark, sf_dir, "events").count() // frames))


def _ordered(spark, sf_dir: str) -> str:
    folder = _folder(spark, "ordered")
    frameblocks.write_ordered(_frame_texts(spark, sf_dir), folder, _writers(spark, sf_dir, 7, 200_000))
    return folder


@query(f"SELECT clip, frame, {_TEXT} AS pixels, CAST(row_number() OVER (ORDER BY clip, frame) - 1 AS BIGINT) AS place FROM frames", "frames")
def ordered_sink(spark, sf_dir: str) -> DataFrame:
    """Clips written by many tasks (seven at least) as one output and read back; place: the row's number as the parts follow each other."""
    rows = frameblocks.read_ordered(spark, _ordered(spark, sf_dir))
    # the partition's number and the row's in it, made one number by the rows of the partitions before
    numbered = rows.select("clip", "frame", F.col("pixels").cast("string").alias("pixels"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))
    numbered = numbered.withColumn("inside", F.col("id") - F.shiftleft(F.col("part").cast("long"), 33))
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.withColumn("before", before).drop("n"))
    return numbered.join(offsets, "part").select("clip", "frame", "pixels", (F.col("before") + F.col("inside")).alias("place"))


@query(f"SELECT clip, CAST(count(*) AS BIGINT) AS frames, CAST(count(*) * 8 AS BIGINT) AS bytes, sha256(string_agg({_TEXT}, '' ORDER BY frame)) AS digest FROM frames GROUP BY clip", "frames")
def ordered_files(spark, sf_dir: str) -> DataFrame:
    """The same output as one file for each clip, with the file's digest."""
    source, out = _ordered(spark, sf_dir), _folder(spark, "files")
    frameblocks.composed(spark, source, out).write.parquet(f"{source}/made")
    made = spark.read.parquet(f"{source}/made")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.raw").load(out)
    digests = files.select(F.regexp_extract("path", r"([0-9]+)\.raw$", 1).cast("long").alias("clip"), F.sha2("content", 256).alias("digest"))
    return made.join(digests, "clip")


_DIGESTS = f"fd AS (SELECT clip, frame, {_TEXT} AS t FROM frames)"


@query(f"{_DIGESTS} SELECT clip, frame, sha256(t) AS digest FROM fd", "frames")
def frame_hashes(spark, sf_dir: str) -> DataFrame:
    """Each frame's digest, of an output that several tasks have written."""
    return digests.frame_digests(frameblocks.read_ordered(spark, _ordered(spark, sf_dir)))


@query(
    f"{_DIGESTS}, ot AS (SELECT clip, CASE WHEN clip % 5 = 1 AND frame IN (8, 9) THEN 17 - frame ELSE frame END AS frame, CASE WHEN clip % 5 = 2 AND frame = 11 THEN 'changed' ELSE t END AS t FROM fd WHERE frame >= 3 AND NOT (clip % 5 = 3 AND frame = 20)), "
    "nn AS (SELECT clip, max(frame) AS last FROM fd GROUP BY clip), ox AS (SELECT ot.* FROM ot JOIN nn USING (clip) WHERE NOT (clip % 5 = 4 AND frame = last)), "
    "jn AS (SELECT coalesce(a.clip, b.clip) AS clip, coalesce(a.frame, b.frame) AS frame, a.t IS NOT DISTINCT FROM b.t AS same, a.t IS NOT NULL AS l, b.t IS NOT NULL AS r FROM (SELECT * FROM fd WHERE frame >= 3) a FULL JOIN ox b ON b.clip = a.clip AND b.frame = a.frame) "
    "SELECT clip, count(*) FILTER (l) AS frames, count(*) FILTER (r) AS other_frames, bool_and(same) AS equal, min(frame) FILTER (NOT same) AS first_difference FROM jn GROUP BY clip",
    "frames",
)
def sequence_equality(spark, sf_dir: str) -> DataFrame:
    """Clips against copies without their first three frames, in some of which a frame has moved, changed or gone."""
    own = digests.frame_digests(_frame_texts(spark, sf_dir))
    last = own.groupBy("clip").agg(F.max("frame").alias("last"))
    other = _frame_texts(spark, sf_dir).where("frame >= 3 AND NOT (clip % 5 = 3 AND frame = 20)").join(last, "clip").where("NOT (clip % 5 = 4 AND frame = last)")
    other = other.select("clip", F.expr("IF(clip % 5 = 1 AND frame IN (8, 9), 17 - frame, frame) - 3").alias("frame"), F.expr("IF(clip % 5 = 2 AND frame = 11, CAST('changed' AS binary), pixels)").alias("pixels"))
    return digests.compared_sequences(own, digests.frame_digests(other), 3)


@query("SELECT clip, frame, floor(value * 100) AS value, CASE WHEN kind = 'purchase' THEN 255 ELSE 0 END AS mask FROM frames", "frames")
def paired_outputs(spark, sf_dir: str) -> DataFrame:
    """Two outputs, of frames and of masks, written by different numbers of tasks and read as pairs; other counts raise."""
    folder = _folder(spark, "masks")
    mask = F.when(F.col("kind") == "purchase", "255").otherwise("0")
    frameblocks.write_ordered(bd.frames(spark, sf_dir).select("clip", "frame", mask.cast("binary").alias("pixels")), folder, _writers(spark, sf_dir, 3, 300_000))
    read = lambda path: frameblocks.read_ordered(spark, path).select("clip", "frame", F.col("pixels").cast("string").cast("long").alias("value"))
    return tensors.paired(read(_ordered(spark, sf_dir)), read(folder)).withColumnRenamed("other", "mask")


# --- chains of objects --------------------------------------------------------------------------------------------

_BOXES = {0: ("f % 4 = 0", "0", "0", "1 + f % 2", "1"), 1: ("f % 3 = 0", "0", "0", "1", "2"), 2: ("f % 9 = 0", "0", "0", "2", "2")}
_MASK4 = ("kind = 'purchase'", "kind IN ('purchase', 'click')", "kind = 'view'", "frame % 6 = 0")


def _chain_sql() -> str:
    """What each of three objects makes of the frames fk (clip, frame, p, v, m) before it."""
    parts = [_TWO_SCENES, "f0 AS (SELECT clip, frame, unnest([0, 1, 2, 3]) AS p, value + 10 * unnest([0, 1, 2, 3]) AS v, unnest([" + ", ".join(f"CASE WHEN {m} THEN 1.0 ELSE 0.0 END" for m in _MASK4) + "]) AS m FROM frames)"]
    for k, (when, x1, y1, x2, y2) in _BOXES.items():
        edit = lambda v, w, b, k=k: f"CASE WHEN p % 2 >= {b}.x1 AND p % 2 < {b}.x2 AND p // 2 >= {b}.y1 AND p // 2 < {b}.y2 THEN {v} * 0.5 + 10 + {w} + {k} ELSE {v} END"
        parts += [
            f"w{k} AS (SELECT pw.clip, k, min({x1}) AS x1, min({y1}) AS y1, max({x2}) AS x2, max({y2}) AS y2 FROM pw JOIN (SELECT clip, frame AS f FROM frames) n ON n.clip = pw.clip AND f >= ds AND f < de WHERE {when} GROUP BY pw.clip, k)",
            f"l{k} AS (SELECT pw.*, w.x1, w.y1, w.x2, w.y2, coalesce((SELECT bool_or(m > 0 AND p % 2 >= w.x1 AND p % 2 < w.x2 AND p // 2 >= w.y1 AND p // 2 < w.y2) FROM f{k} f WHERE f.clip = pw.clip AND f.frame >= ds AND f.frame < de), false) AS live FROM pw LEFT JOIN w{k} w ON w.clip = pw.clip AND w.k = pw.k)",
            f"x{k} AS (SELECT f.clip, f.frame, f.p, f.v, f.m, s.live, s.frame_place AS place, s.ol, s.k, CASE WHEN s.frame_place < s.ol AND b.live THEN {edit('f.v', 'b.k', 'b').replace('p %', 'f.p %').replace('p //', 'f.p //')} ELSE f.v END AS c, s.x1, s.y1, s.x2, s.y2 FROM (SELECT l.*, unnest(range(ls, de - orr)) AS frame, unnest(range(ls, de - orr)) - ls AS frame_place FROM l{k} l) s JOIN f{k} f ON f.clip = s.clip AND f.frame = s.frame LEFT JOIN l{k} b ON b.clip = s.clip AND b.k = s.k - 1)",
            f"y{k} AS (SELECT clip, frame, p, live AS changed, CASE WHEN NOT live THEN v WHEN place < ol THEN (1 - place / {OVERLAP - 1}) * c + (place / {OVERLAP - 1}) * ({edit('c', 'x.k', 'x')}) ELSE {edit('c', 'x.k', 'x')} END AS v FROM x{k} x UNION ALL SELECT clip, frame, p, false, v FROM f{k} WHERE frame >= 18 AND frame < 25)",
            f"f{k + 1} AS (SELECT y.clip, y.frame, y.p, y.v, CASE WHEN EXISTS (SELECT 1 FROM l{k} l WHERE l.clip = y.clip AND l.live AND y.frame >= l.ds AND y.frame < l.de AND y.p % 2 >= l.x1 AND y.p % 2 < l.x2 AND y.p // 2 >= l.y1 AND y.p // 2 < l.y2) THEN 0.0 ELSE f.m END AS m FROM y{k} y JOIN f{k} f ON f.clip = y.clip AND f.frame = y.frame AND f.p = y.p)",
        ]
    return ", ".join(parts)


def _chained(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = bd.frames(spark, sf_dir)
    mask = F.array(*[F.when(F.expr(m), 1.0).otherwise(0.0) for m in _MASK4])
    frames = rows.select("clip", "frame", F.lit(2).alias("height"), F.lit(2).alias("width"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.col("value") + 10 * p).alias("pixels"), mask.alias("mask"))
    boxes = None
    for k, (when, *box) in _BOXES.items():
        own = rows.select("clip", "frame", F.col("frame").alias("f")).where(when).select(F.lit(k).alias("object"), "clip", "frame", *[F.expr(e).cast("long").alias(c) for c, e in zip(("x1", "y1", "x2", "y2"), box, strict=True)])
        boxes = own if boxes is None else boxes.unionByName(own)
    return objects.chained(frames, boxes, _two_scenes(spark, sf_dir), list(_BOXES), _object_edit, _folder(spark, "chain"), "linear")


def _object_edit(pixels, window_index, name):
    return pixels * 0.5 + 10 + window_index + name


@query(f"{_chain_sql()} SELECT clip, frame, p AS place, round(v, 6) AS value, m AS mask FROM f3", "frames", "clips")
def object_chain(spark, sf_dir: str) -> DataFrame:
    """Three objects worked on in order: the frames, and the mask that is left."""
    frames, _ = _chained(spark, sf_dir)
    both = frames.select("clip", "frame", F.posexplode(F.arrays_zip("pixels", "mask")).alias("place", "v"))
    return rounded(both.select("clip", "frame", "place", F.col("v.pixels").alias("value"), F.col("v.mask").alias("mask")), "value")


@query(
    f"{_chain_sql()}, a AS (SELECT 0 AS object, clip, frame, bool_or(changed) AS changed FROM y0 GROUP BY ALL UNION ALL SELECT 1, clip, frame, bool_or(changed) FROM y1 GROUP BY ALL UNION ALL SELECT 2, clip, frame, bool_or(changed) FROM y2 GROUP BY ALL), "
    "g AS (SELECT *, frame - row_number() OVER (PARTITION BY object, clip, changed ORDER BY frame) AS island FROM a) SELECT object, clip, min(frame) AS start, max(frame) + 1 AS \"end\", changed FROM g GROUP BY object, clip, changed, island",
    "frames",
    "clips",
)
def object_ranges(spark, sf_dir: str) -> DataFrame:
    """Which ranges of frames each object has passed on changed, and which as they came."""
    return _chained(spark, sf_dir)[1].select("object", "clip", "start", "end", "changed")
