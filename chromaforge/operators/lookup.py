"""Nearest colours of large palettes: a search over colours sorted by length, and an index by cells of the colour cube.

Both give the rows of :func:`assign.assign`; a palette is one array value or one small table, so plans stay the same for
thousands of colours.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import constant, let, table
from ..functions.color import length2, sed

#: Cells of the index along each channel, and entries up to which it is broadcast (about 40 bytes each).
CELLS, MOST = 16, 1_000_000
#: Places beside the colour of the nearest length that are compared before the range of lengths is cut.
PROBES = 2
#: Whole lengths of 8-bit colours: the root of 3 * 255 * 255, upwards.
LENGTHS = 442


def _rgb() -> list[Column]:
    return [F.col(c) for c in "rgb"]


def _visits(size: int) -> list[int]:
    """When a binary search over so many places comes to each of them: its depth."""
    depth, spans = [0] * size, [(0, size - 1, 0)]
    while spans:
        low, high, d = spans.pop()
        if low <= high:
            middle = (low + high) // 2
            depth[middle] = d
            spans += [(low, middle - 1, d + 1), (middle + 1, high, d + 1)]
    return depth


class ByLength:
    """A palette in ascending order of length, as constants of a plan.

    colors: array<struct<r, g, b, k>>. starts: for each whole length m the places that can be nearest to a length from m
    to m + 1, with their length and depth in a binary search. below and upto: how many lengths are less than m, or at most m.
    They are written out: computed in the plan they would be computed again for every row.
    """

    def __init__(self, palette: Sequence[Sequence[int]], places: Sequence[int]) -> None:
        whole = [tuple(map(int, c[:3])) for c in palette]
        norms = np.sqrt(np.array([r * r + g * g + b * b for r, g, b in whole], np.float64))
        if (np.diff(norms) < 0).any():
            raise ValueError("the palette must ascend in length")
        depth = _visits(len(whole))
        edges = np.arange(LENGTHS + 2)
        self.colors = table([dict(zip("rgb", c, strict=True)) | {"k": k} for c, k in zip(whole, places, strict=True)])
        self.below, self.upto = (constant(np.searchsorted(norms, edges, side).tolist(), "array<int>") for side in ("left", "right"))
        starts = []
        for m in range(LENGTHS + 1):
            least = np.maximum(0, np.maximum(norms - (m + 1), m - norms))
            most = np.maximum(np.abs(norms - m), np.abs(norms - (m + 1))).min()
            starts.append([{"n": norms[i].item(), "v": depth[i], "p": i} for i in np.flatnonzero(least <= most).tolist()])
        self.starts = constant(starts, "array<array<struct<n:double,v:int,p:int>>>")

    def start(self, norm: Column) -> Column:
        """The place that a binary search for norm settles on: of those it visits the nearest, the first among equals.

        It visits both neighbours of norm; of equal lengths in a row, the first that it comes to is the least deep.
        """
        near = F.get(self.starts, F.floor(norm).cast("int"))
        return F.array_min(F.transform(near, lambda x: F.struct(F.abs(x["n"] - norm), x["v"], x["p"].alias("p"))))["p"]

    def window(self, norm: Column, reach: Column) -> Column:
        """struct<a, b>: the places whose length is within reach of norm, or a little more."""
        at = lambda v: F.greatest(F.least(v, F.lit(LENGTHS + 1)), F.lit(0)).cast("int")
        low, high = F.floor(norm - reach - 1e-6), F.ceil(norm + reach + 1e-6)
        return F.struct(F.get(self.below, at(low)).alias("a"), F.get(self.upto, at(high)).alias("b"))


def nearest_by_length(palette: ByLength, color: Sequence[Column], rank: Callable[[Column, Column], Column] | None = None) -> Column:
    """struct<d, t, k, seen> of the nearest colour.

    The search begins at the colour of the nearest length. A colour whose length differs from the pixel's by the root of
    the best distance or more can't be nearer, and lengths ascend, so only the slice inside that range is compared.
    Equal distances go to the least rank(place, start). seen: colours in the slice.
    """

    def compare(first: Column, count: Column, start: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            t = rank(first + i, start) if rank else F.lit(0)
            return F.struct(sed(color, [c[n] for n in "rgb"]).alias("d"), t.cast("int").alias("t"), c["k"].alias("k"))

        return F.array_min(F.transform(F.slice(palette.colors, first + 1, count), one))

    def search(norm: Column, start: Column) -> Column:
        def within(at: Column, best: Column) -> Column:
            seen = at["b"] - at["a"]
            return let(
                F.least(best, compare(at["a"], seen, start)), lambda x: F.struct(x["d"].alias("d"), x["t"].alias("t"), x["k"].alias("k"), seen.alias("seen"))
            )

        first = compare(F.greatest(start - PROBES, F.lit(0)), F.lit(2 * PROBES + 1), start)
        return let(first, lambda best: let(palette.window(norm, F.sqrt(best["d"].cast("double"))), lambda at: within(at, best)))

    return let(F.sqrt(length2(color).cast("double")), lambda norm: let(palette.start(norm), lambda start: search(norm, start)))


def walk(place: Column, start: Column) -> Column:
    """Order of places in a search from start to the left, then to the right."""
    return F.when(place == start, 0).when(place < start, start - place).otherwise(place)


def assign_by_length(pixels: DataFrame, palette: Sequence[Sequence[int]]) -> DataFrame:
    """pixels with k, d and the number of colours that were compared; ties by the order of the search."""
    held = ByLength(palette, range(len(palette)))
    near = pixels.select("*", nearest_by_length(held, _rgb(), walk).alias("_near"))
    return near.select("*", F.col("_near.k").alias("k"), F.col("_near.d").alias("d"), F.col("_near.seen").alias("seen")).drop("_near")


def cell_of(color: Sequence[Column], cells: int = CELLS) -> Column:
    r, g, b = (F.floor(c * cells / 256) for c in color)
    return ((r * cells + g) * cells + b).cast("long")


def cell_index(spark: SparkSession, palette: Sequence[Sequence[int]], cells: int = CELLS) -> DataFrame:
    """(cell, near): for each cell of the cube the colours (r, g, b, k) that can be nearest to a point in it.

    The farthest point of a cell is so far from the best colour at most; a colour whose nearest point of the cell is
    farther than that is never the nearest one. Equal distances stay, so ties are decided as without the index.
    """
    side = 256 // cells
    corner = [F.expr(f"(id div {cells ** p}) % {cells} * {side}") for p in (2, 1, 0)]
    given = table([dict(zip("rgb", map(int, c), strict=False)) | {"k": k} for k, c in enumerate(palette)])

    def least(c: Column) -> Column:
        gaps = [F.greatest(low - c[n], c[n] - (low + side - 1), F.lit(0)) for low, n in zip(corner, "rgb", strict=True)]
        return sum(x * x for x in gaps[1:]) + gaps[0] * gaps[0]

    def most(c: Column) -> Column:
        gaps = [F.greatest(F.abs(c[n] - low), F.abs(c[n] - (low + side - 1))) for low, n in zip(corner, "rgb", strict=True)]
        return sum(x * x for x in gaps[1:]) + gaps[0] * gaps[0]

    bound = F.array_min(F.transform(given, most))
    near = let(bound, lambda u: F.filter(given, lambda c: least(c) <= u))
    return spark.range(cells**3).select(F.col("id").alias("cell"), near.alias("near"))


def assign_by_cell(pixels: DataFrame, palette: Sequence[Sequence[int]], cells: int = CELLS, most: int = MOST) -> DataFrame:
    """pixels with k and d of the nearest colour, the lowest index among equals: a lookup, then a short comparison.

    The index is broadcast when it has at most ``most`` entries; beyond that the sorted search takes over.
    """
    spark = pixels.sparkSession
    if not palette:
        return pixels.select("*", F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("d"))
    index = cell_index(spark, palette, cells)
    if index.agg(F.sum(F.size("near"))).first()[0] > most:
        order = sorted(range(len(palette)), key=lambda i: (sum(v * v for v in palette[i][:3]), i))
        near = nearest_by_length(ByLength([palette[i] for i in order], order), _rgb())
        return pixels.select("*", near.alias("_near")).select(*pixels.columns, F.col("_near.k").alias("k"), F.col("_near.d").alias("d"))
    found = pixels.withColumn("_cell", cell_of(_rgb(), cells)).join(F.broadcast(index.withColumnRenamed("cell", "_cell")), "_cell")
    best = F.array_min(F.transform("near", lambda c: F.struct(sed(_rgb(), [c[n] for n in "rgb"]).alias("d"), c["k"].alias("k"))))
    return found.select(*pixels.columns, best.alias("_best")).select(*pixels.columns, F.col("_best.k").alias("k"), F.col("_best.d").alias("d"))
