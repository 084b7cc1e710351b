"""Colour-cube histogram and the palette candidates it gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.color import cube

CUBE = ["rb", "gb", "bb"]


def cube_histogram(pixels: DataFrame, bins: int = 16) -> DataFrame:
    """Pixels, channel sums and first ordinal of every occupied cube; one shuffle of at most bins**3 rows a task."""
    keyed = pixels.select("ord", "r", "g", "b", *(cube(F.col(c), bins).alias(k) for c, k in zip("rgb", CUBE, strict=True)))
    return keyed.groupBy(*CUBE).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(c).alias(f"sum_{c}") for c in "rgb"),
        F.min("ord").alias("first_ord"),
    )


def candidates(histogram: DataFrame, least: int = 1, rounding: str = "floor") -> DataFrame:
    """Mean colour of the cubes with at least ``least`` pixels; means are floored or rounded half to even."""
    if rounding == "floor":
        means = [F.expr(f"sum_{c} div n").cast("long").alias(c) for c in "rgb"]
    elif rounding == "even":
        means = [F.bround(F.col(f"sum_{c}") / F.col("n"), 0).cast("long").alias(c) for c in "rgb"]
    else:
        raise ValueError(f"unknown rounding {rounding!r}")
    return histogram.filter(F.col("n") >= least).select(*CUBE, *means, "n", "first_ord")


def distinct_colors(pixels: DataFrame) -> DataFrame:
    """Each colour once with its pixel count n: what iterative operators need of an image."""
    return pixels.groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


def spread(colors: DataFrame) -> DataFrame:
    """colors dealt to as many tasks as a shuffle has: what iterates over a table of few bytes is bound by its arithmetic."""
    return colors.repartition(int(colors.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def counted_colors(pixels: DataFrame) -> tuple[DataFrame, int]:
    """Each colour with its pixel count, persisted, and the number of pixels, which the same job observes."""
    seen = Observation()
    colors = spread(distinct_colors(pixels.observe(seen, F.count(F.lit(1)).alias("n_pixels")))).persist()
    colors.count()
    return colors, seen.get["n_pixels"]
