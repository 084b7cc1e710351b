"""Initial palettes: greedy farthest-point selection, evenly spaced and seeded pixels, order by length."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.color import length2, sed

Color = tuple[float, float, float]


def _rgb() -> list:
    return [F.col(c) for c in "rgb"]


def greedy(candidates: DataFrame, k: int) -> list[tuple[int, int, int, int]]:
    """Up to k colours (r, g, b, n): first the most frequent, then always the one with the largest
    distance to the chosen colours times the root of its count; the earliest ordinal wins ties.

    Each round is one job that returns one row. The distance to the chosen colours is an expression over them, so no
    state is kept between rounds.
    """
    pool = candidates.select("r", "g", "b", "n", "first_ord").persist()
    chosen: list = []
    try:
        while len(chosen) < k:
            if chosen:
                d = [sed(_rgb(), (c.r, c.g, c.b)) for c in chosen]
                score = (F.least(*d) if len(d) > 1 else d[0]) * F.sqrt("n")
                left = pool.filter(~F.col("first_ord").isin([c.first_ord for c in chosen]))
            else:
                score, left = F.col("n"), pool
            best = left.orderBy(score.desc(), "first_ord").limit(1).collect()
            if not best:
                break
            chosen += best
    finally:
        pool.unpersist()
    return [(c.r, c.g, c.b, c.n) for c in chosen]


def linspace_ordinals(n: int, k: int) -> list[int]:
    """k ordinals evenly spread over 0..n-1 (fewer when there are fewer pixels)."""
    k = min(k, n)
    return [0] * k if k < 2 else [i * (n - 1) // (k - 1) for i in range(k)]


def seeded_ordinals(n: int, k: int, seed: int) -> list[int]:
    """k distinct ordinals drawn by the standard library's generator."""
    return random.Random(seed).sample(range(n), min(k, n))


def at_ordinals(pixels: DataFrame, ordinals: Sequence[int]) -> list[Color]:
    """Colours at given ordinals, in their order; the filter reaches the scan."""
    rows = pixels.filter(F.col("ord").isin(list(ordinals))).select("ord", "r", "g", "b").collect()
    by = {x.ord: (x.r, x.g, x.b) for x in rows}
    return [by[o] for o in ordinals]


def as_frame(spark: SparkSession, palette: Sequence[Sequence[int]]) -> DataFrame:
    """(k, r, g, b) rows of a palette."""
    return spark.createDataFrame([(i, *map(int, c[:3])) for i, c in enumerate(palette)], "k long, r long, g long, b long")


def by_length(palette: DataFrame) -> DataFrame:
    """k, r, g, b, len2 in ascending order of length, equal ones in their old order."""
    with_length = palette.withColumn("len2", length2(_rgb()))
    rank = F.row_number().over(Window.orderBy("len2", "k")) - 1  # a palette has a handful of rows
    return with_length.select(rank.cast("long").alias("k"), "r", "g", "b", "len2")


def length_order(palette: Sequence[Color]) -> list[Color]:
    """The same on a list."""
    return sorted(palette, key=lambda c: c[0] ** 2 + c[1] ** 2 + c[2] ** 2)
