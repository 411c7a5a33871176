"""A window's new frames as a model takes them: padded in space and time, masked, the mask compressed in time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.operators import images
from framelode.operators.masks import gray
from framelode.plans.windows import mirror_source, pad_plan

#: Frames that one of the compressed mask stands for.
GROUP = 8


def prepared(frames: DataFrame, clips: DataFrame, head: bool, infer_len: int, shift: int, align: int, size: int = 9, times: int = 9, share: float = 0.039) -> tuple[DataFrame, DataFrame]:
    """(masked, latents) of frames (clip, frame from 0 on, height, width, pixels, mask: bytes) and clips (clip, num_frames).

    Frames are padded to multiples of align by their last row and column, and each clip to whole batches of infer_len
    (shift of them shared) by its mirror image. masked: (clip, place, height, width, values) with values in [0, 1] that are
    0 where the thickened mask is on. latents: (clip, part, values), the mask of GROUP frames together, any of them, as
    grey; in a clip's head the first frame stands alone and counts 1 where it is on, the groups 255.

    Work on pixels is by frame; places name their frame by an equi-join; a group is at most GROUP masks.
    """
    wide = images.padded(frames.select("clip", "frame", "height", "width", "pixels", "mask"), align, ("pixels", "mask"))
    up = lambda c: (F.ceil(F.col(c) / align) * align).cast("int")
    covered = images.masked_frames(wide.withColumns({"height": up("height"), "width": up("width")}), times, size, share)
    n = F.col("num_frames")
    total = n + pad_plan(n, F.lit(head), infer_len, shift)[1]
    places = clips.where("num_frames > 0").withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), total.cast("long") - 1))).select("clip", "place", mirror_source(F.col("place"), n).cast("long").alias("frame"))
    placed = places.join(covered, ["clip", "frame"])
    lone = 1 if head else 0
    part = F.when(F.col("place") < lone, F.lit(0).cast("long")).otherwise(F.expr(f"(place - {lone}) div {GROUP} + {lone}"))
    kind = dict(frames.dtypes)["clip"]
    schema = pa.schema([("clip", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), ("part", pa.int64()), ("any", pa.list_(pa.int32()))])

    def together(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        on = np.zeros(len(held.column("on")[0].as_py()), bool)
        for raw in held.column("on"):
            on |= np.frombuffer(raw.as_py(), np.uint8) > 0
        single = head and key[1].as_py() == 0
        return pa.Table.from_pylist([{"clip": key[0].as_py(), "part": key[1].as_py(), "any": (on * (1 if single else 255)).tolist()}], schema)

    compressed = placed.select("clip", part.alias("part"), "on").groupBy("clip", "part").applyInArrow(together, f"clip {kind}, part long, any array<int>")
    return placed.select("clip", "place", "height", "width", "values"), compressed.select("clip", "part", F.transform("any", lambda v: gray(v, v, v)).alias("values"))
