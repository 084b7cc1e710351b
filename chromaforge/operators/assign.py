"""Nearest palette colour of every row, as one expression: no join, no shuffle, whole-stage code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.color import sed


#: Colours up to which a palette is written out as one comparison of generated code; larger ones have an index.
FEW = 32


def nearest(palette: Sequence[Sequence[float]], color: Sequence[Column]) -> Column:
    """struct<d, k>: distance and index of the nearest colour of palette; the lowest index wins ties."""
    return F.array_min(F.array(*(F.struct(sed(color, c[:3]).alias("d"), F.lit(i).cast("long").alias("k")) for i, c in enumerate(palette))))


def assign(pixels: DataFrame, palette: Sequence[Sequence[float]], columns: Sequence[str] = ("r", "g", "b"), ties: str = "index") -> DataFrame:
    """pixels with k and d of the nearest colour; nulls where the palette is empty.

    ties: "index" for the lowest index, "length" for the order of a search from the colour of the nearest length, which
    takes a palette of whole RGB colours in ascending order of length.
    """
    from . import lookup

    if ties not in ("index", "length"):
        raise ValueError(f"unknown tie rule {ties!r}")
    if not palette:
        return pixels.select("*", F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("d"))
    if ties == "length":
        return lookup.assign_by_length(pixels, palette).drop("seen")
    if len(palette) > FEW:
        whole = tuple(columns) == ("r", "g", "b") and all(isinstance(v, int) for c in palette for v in c[:3])
        return lookup.assign_by_cell(pixels, palette) if whole else _with(pixels, arrays.closest(arrays.palette(palette), [F.col(c) for c in columns]))
    return _with(pixels, nearest(palette, [F.col(c) for c in columns]))


def _with(pixels: DataFrame, near: Column) -> DataFrame:
    found = pixels.select("*", near.alias("_near"))
    return found.select("*", F.col("_near.k").alias("k"), F.col("_near.d").alias("d")).drop("_near")


def color_of(palette: Sequence[Sequence[int]], k: Column) -> list[Column]:
    """Channel columns of palette colour k."""
    return [F.element_at(F.array(*(F.lit(int(c[i])).cast("long") for c in palette)), (k + 1).cast("int")).alias(n) for i, n in enumerate("rgb")]
