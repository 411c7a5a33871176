"""Layers over tables of rows: matrices as products of blocks, activations as columns between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelode.operators.blockproduct import scaled_product


def linear(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(m, n, y): rows (m, x) times weights (n, w, bias)."""
    one = F.lit(1.0).alias("scale")
    return scaled_product(rows.select("m", "x", one), weights.select("n", "w", one, "bias"), whole=False).select("m", "n", "y")


def feed_forward(rows: DataFrame, first: DataFrame, second: DataFrame, activation: Callable[[Column], Column]) -> DataFrame:
    """(m, n, y): activation of a linear layer, and a second layer over its numbers in order of n.

    rows (m, x), first and second (n, w, bias). Between the layers a row is put together again by one grouping; it has as
    many numbers as first has rows.
    """
    inner = linear(rows, first).groupBy("m").agg(F.array_sort(F.collect_list(F.struct("n", "y"))).alias("held"))
    return linear(inner.select("m", F.transform("held", lambda h: activation(h["y"])).alias("x")), second)
