"""Strided patches of pixels projected by a matrix: a convolution as a join of places and offsets, then a product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.operators.blockproduct import scaled_product

#: Bits of a patch's row and column in its number.
BITS = 20


def patch_rows(pixels: DataFrame, size: tuple[int, int], stride: tuple[int, int], padding: tuple[int, int] = (0, 0), channels: int = 1) -> DataFrame:
    """(id, row, col, x): the patches of images (id, height, width, y, x, channel, value) as arrays.

    A patch of size begins stride places after the one before, padding places outside the image first; what is outside
    is 0. Values stand by channel, then row, then column of the patch. A pixel goes to the few patches that hold it, by
    arithmetic alone; patches are put together by one grouping. Patches that would leave the padded image aren't there;
    pixels that are missing are 0, a patch without any pixel is left out.
    """
    rows = pixels
    for name, at, extent, k in (("row", "y", "height", 0), ("col", "x", "width", 1)):
        place = f"(CAST({at} AS bigint) + {padding[k]})"
        low = f"greatest(CAST(ceil(({place} - {size[k] - 1}) / {stride[k]}) AS bigint), 0L)"
        high = f"least({place} div {stride[k]}, ({extent} + {2 * padding[k] - size[k]}) div {stride[k]})"
        fits = f"{low} <= {high} AND {extent} + {2 * padding[k] - size[k]} >= 0"
        rows = rows.where(fits).withColumn(name, F.explode(F.expr(f"sequence({low}, {high})"))).withColumn(f"_{name}", F.expr(f"{place} - {name} * {stride[k]}"))
    place = (F.col("channel") * size[0] + F.col("_row")) * size[1] + F.col("_col")
    held = rows.groupBy("id", "row", "col").agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int").alias("k"), F.col("value").cast("double")))).alias("m"))
    width = channels * size[0] * size[1]
    return held.select("id", "row", "col", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("x"))


def projected(patches: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, row, col, n, y): patches (id, row, col, x) times weights (n, w), plus bias, as a product of blocks.

    id is an integer below 2**23, rows and columns below 2**20: a patch is one number.
    """
    number = F.shiftleft(F.col("id").cast("long"), 2 * BITS).bitwiseOR(F.shiftleft(F.col("row"), BITS)).bitwiseOR(F.col("col"))
    out = scaled_product(patches.select(number.alias("m"), "x", F.lit(1.0).alias("scale")), weights.select("n", "w", F.lit(1.0).alias("scale"), "bias"), whole=False)
    low = (1 << BITS) - 1
    return out.select(F.shiftright("m", 2 * BITS).alias("id"), F.shiftright("m", BITS).bitwiseAND(F.lit(low)).alias("row"), F.col("m").bitwiseAND(F.lit(low)).alias("col"), "n", "y")
