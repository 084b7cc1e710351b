"""Operators that give rasters: quantised images, resized images, swatches, circles for plots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.pixels import with_lab
from .assign import assign, color_of


def quantize_rgb(pixels: DataFrame, palette: Sequence[Sequence[int]]) -> DataFrame:
    """pixels in the nearest colour of palette, by distance in RGB."""
    return assign(pixels, palette).select("ord", "x", "y", *color_of(palette, F.col("k")))


def write_quantized(pixels: DataFrame, palette: Sequence[Sequence[int]], path: str) -> tuple[DataFrame, dict[str, int]]:
    """Write pixels in the nearest colour of palette as Parquet: the table, and n_pixels, sum_sed and colors_used of the same job."""
    seen = Observation()
    near = assign(pixels, palette)
    counts = [F.count(F.lit(1)).alias("n_pixels"), F.sum("d").alias("sum_sed")]
    counts += [F.max(F.when(F.col("k") == i, 1).otherwise(0)).alias(f"k{i}") for i in range(len(palette))]
    near.observe(seen, *counts).select("ord", "x", "y", *color_of(palette, F.col("k"))).write.parquet(path)
    got = seen.get
    used = sum(got[f"k{i}"] or 0 for i in range(len(palette)))
    return pixels.sparkSession.read.parquet(path), {"n_pixels": got["n_pixels"], "sum_sed": got["sum_sed"] or 0, "colors_used": used}


def quantize_lab(pixels: DataFrame, centroids: Sequence[Sequence[float]], palette: Sequence[Sequence[int]]) -> DataFrame:
    """pixels in the colour of palette whose centroid is nearest in L*a*b*."""
    return assign(with_lab(pixels), centroids, ("l", "a", "b_lab")).select("ord", "x", "y", *color_of(palette, F.col("k")))


def fit_dims(width: int, height: int, most: int, rounding: str = "even") -> tuple[int, int]:
    """Width and height with the larger side at most ``most``; rounded half to even, or cut off (rounding="down")."""
    if max(width, height) <= most:
        return width, height
    scale = most / max(width, height)
    whole = round if rounding == "even" else int
    return whole(width * scale), whole(height * scale)


#: Fixed value: bits after the point of the weights.
BITS = 22


def _weights(spark: SparkSession, size: int, new: int, names: tuple[str, str]) -> DataFrame:
    """(to, from, weight) of a triangle filter whose width follows the scale; weights of a target add up to about 2**BITS.

    Everything is whole: distances are counted in units of 1 / (2 * new), and a weight is rounded once, half upwards.
    """
    reach = 2 * max(size, new)
    at = (2 * F.col("id") + 1) * size
    low, high = (F.floor((at + sign * reach) / (2 * new)) + more for sign, more in ((-1, -1), (1, 1)))
    window = F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(size - 1)))
    rows = spark.range(new).select(F.col("id").alias(names[0]), at.alias("at"), F.explode(window).alias(names[1]))
    rows = rows.withColumn("w", F.lit(reach) - F.abs((2 * F.col(names[1]) + 1) * new - F.col("at"))).filter("w > 0")
    total = rows.groupBy(names[0]).agg(F.sum("w").alias("total"))
    return rows.join(total, names[0]).select(*names, F.expr(f"(w * {2 << BITS} + total) div (2 * total)").alias("w"))


def resize(pixels: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Bilinear resampling in two passes (columns, then rows); each is a join with weights and an aggregate of whole sums."""
    spark = pixels.sparkSession
    if (width, height) == (new_width, new_height):
        return pixels.select("x", "y", "r", "g", "b")

    def mean(c: str) -> Column:
        return F.least(F.greatest(F.shiftright(F.sum(F.col(c) * F.col("w")) + (1 << BITS - 1), BITS), F.lit(0)), F.lit(255)).cast("long").alias(c)

    across = _weights(spark, width, new_width, ("nx", "x"))
    narrow = pixels.join(across, "x").groupBy("nx", "y").agg(*(mean(c) for c in "rgb"))
    down = _weights(spark, height, new_height, ("ny", "y"))
    done = narrow.join(down, "y").groupBy("nx", "ny").agg(*(mean(c) for c in "rgb"))
    return done.select(F.col("nx").alias("x"), F.col("ny").alias("y"), "r", "g", "b")


def swatch(spark: SparkSession, palette: Sequence[Sequence[int]], stripe: int = 50, height: int = 50) -> DataFrame:
    """One upright stripe a colour."""
    width = stripe * len(palette)
    at = spark.range(width * height).select(F.expr(f"id % {max(width, 1)}").alias("x"), F.expr(f"id div {max(width, 1)}").alias("y"))
    return at.select("x", "y", *color_of(palette, F.expr(f"x div {stripe}"))) if palette else at.select("x", "y", *(F.lit(0).cast("long").alias(c) for c in "rgb"))


def fixed_swatch(spark: SparkSession, palette: Sequence[Sequence[int]], width: int = 160, height: int = 40) -> DataFrame:
    """Stripes in a raster of fixed size; columns that no stripe reaches stay black."""
    stripe = max(1, width // max(1, len(palette)))
    at = spark.range(width * height).select(F.expr(f"id % {width}").alias("x"), F.expr(f"id div {width}").alias("y"))
    k = F.expr(f"x div {stripe}")
    inside = k < len(palette)
    if not palette:
        return at.select("x", "y", *(F.lit(0).cast("long").alias(c) for c in "rgb"))
    safe = F.when(inside, k).otherwise(0)
    return at.select("x", "y", *(F.when(inside, c).otherwise(F.lit(0)).cast("long").alias(n) for c, n in zip(color_of(palette, safe), "rgb", strict=True)))


def compare(spark: SparkSession, left: Sequence[int], right: Sequence[int], width: int = 200, height: int = 100) -> DataFrame:
    """Two colours side by side."""
    return swatch(spark, [left, right], width // 2, height)


def chroma_circle(spark: SparkSession, radius: float = 80.0, points: int = 200) -> DataFrame:
    """Points (i, a, b_lab) of a circle of equal chroma, first and last the same."""
    t = F.col("id") * (2 * math.pi / (points - 1))
    return spark.range(points).select(F.col("id").alias("i"), (F.cos(t) * radius).alias("a"), (F.sin(t) * radius).alias("b_lab"))


def lab_axes(spark: SparkSession, arrow: float = 90.0, middle: float = 50.0) -> DataFrame:
    """Axes of an L*a*b* diagram: name, start (l, a, b_lab) and end; lightness, and four arrows from the middle."""
    sides = (("+a", 1, 0), ("-a", -1, 0), ("+b", 0, 1), ("-b", 0, -1))
    rows = [("L", 0.0, 0.0, 0.0, 100.0, 0.0, 0.0)]
    rows += [(name, middle, 0.0, 0.0, middle, a * arrow, b * arrow) for name, a, b in sides]
    return spark.createDataFrame(rows, "axis string, l double, a double, b_lab double, to_l double, to_a double, to_b double")


def plot_points(pixels: DataFrame, palette: Sequence[Sequence[int]], n: int = 5000, seed: int = 0) -> DataFrame:
    """Sampled pixels and palette colours of a scatter plot: kind, r, g, b and L*a*b*."""
    from .palette import as_frame
    from .sampling import fixed_size

    points = fixed_size(pixels, n, seed).select(F.lit("pixel").alias("kind"), "r", "g", "b")
    marks = as_frame(pixels.sparkSession, palette).select(F.lit("palette").alias("kind"), "r", "g", "b")
    return with_lab(points.unionByName(marks))
