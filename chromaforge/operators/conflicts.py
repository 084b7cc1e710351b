"""Colour differences between the members of a palette or of neighbours in a strip."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import by_batch, squared, stacked, sums
from ..functions.color import delta_e, sed
from ..sources.pixels import with_lab
from .histogram import distinct_colors, spread
from .sampling import HASH, MODULUS
from .seeding import STEP, best_starts


def palette_conflicts(palettes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Delta-E of every pair i < j of a palette's colours (k, r, g, b), for each group in by.

    A self-join of palettes: a handful of rows a group.
    """
    by = by or []
    lab = with_lab(palettes.select(*by, "k", "r", "g", "b")).select(*by, "k", "l", "a", "b_lab")
    p = lab.select(*by, F.col("k").alias("i"), *(F.col(c).alias(f"p_{c}") for c in ("l", "a", "b_lab")))
    q = lab.select(*(F.col(c).alias(f"q_{c}") for c in by), F.col("k").alias("j"), *(F.col(c).alias(f"q_{c}") for c in ("l", "a", "b_lab")))
    on = F.col("i") < F.col("j")
    for c in by:
        on = on & (F.col(c) == F.col(f"q_{c}"))
    d = delta_e([F.col(f"p_{c}") for c in ("l", "a", "b_lab")], [F.col(f"q_{c}") for c in ("l", "a", "b_lab")])
    return p.join(q, on).select(*by, "i", "j", d.alias("delta_e"))


def closest_pair(conflicts: DataFrame, by: str | None = None) -> DataFrame:
    """The pair with the smallest difference, of all or of each group; the first pair wins ties."""
    best = F.min(F.struct("delta_e", "i", "j")).alias("m")
    found = (conflicts.groupBy(by) if by else conflicts.groupBy()).agg(best).filter("m is not null")
    return found.select(*([by] if by else []), "m.i", "m.j", "m.delta_e")


def search(best_by_seed: DataFrame, limit: float = 5.0) -> DataFrame:
    """Rows of (seed, i, j, delta_e) up to the first seed whose difference is below limit."""
    w = Window.orderBy("seed").rowsBetween(Window.unboundedPreceding, -1)  # one row a seed
    earlier = F.coalesce(F.min("delta_e").over(w), F.lit(1e9))
    return best_by_seed.withColumn("_before", earlier).filter(F.col("_before") >= limit).drop("_before")


def adjacent(strips: DataFrame) -> DataFrame:
    """Squared differences d_rgb and d_lab of neighbours i and i + 1 in each strip (r, g, b, l, a, b_lab)."""
    w = Window.partitionBy("strip").orderBy("i")
    rgb, lab = ("r", "g", "b"), ("l", "a", "b_lab")
    after: dict[str, Column] = {c: F.lead(c).over(w) for c in (*rgb, *lab)}
    d = lambda names: sed([after[c] for c in names], [F.col(c) for c in names])
    return strips.select("strip", "i", d(rgb).alias("d_rgb"), d(lab).alias("d_lab")).filter("d_rgb is not null")


def batch_hash(x: np.ndarray, y: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Hash of a pixel's place in one step of one seed, from 0 to MODULUS - 1."""
    a, b, c = HASH
    return (x * a + y * b + seed * c + step * STEP) % MODULUS


def _batch_sums(pixels: DataFrame, centers: dict[int, list], step: int, rate: float) -> DataFrame:
    """(seed, k, n, r, g, b): pixels and channel sums by nearest centre of the batch that each seed takes in a step."""

    def body(x: np.ndarray, y: np.ndarray, *color: np.ndarray) -> list[np.ndarray]:
        parts = []
        for seed, held in centers.items():
            taken = batch_hash(x, y, seed, step) < rate * MODULUS
            mine = [c[taken] for c in color]
            if held and len(mine[0]):
                k, *totals = sums(squared(mine, held).argmin(1), len(held), [np.ones_like(mine[0]), *mine])
                parts.append((np.full(len(k), seed), k, *totals))
        return stacked(parts, [np.int64] * 6)

    rows = by_batch(pixels.select("x", "y", "r", "g", "b"), body, "seed long, k long, n long, r long, g long, b long")
    return rows.groupBy("seed", "k").agg(*(F.sum(c).alias(c) for c in ("n", "r", "g", "b")))


def minibatch_palettes(pixels: DataFrame, seeds: Sequence[int], k: int = 8, steps: int = 5, rate: float = 0.1) -> DataFrame:
    """Palettes (seed, k, r, g, b) of mini-batch K-means, all seeds in the same jobs.

    Each seed begins with the best of several oversampled starts. A step takes a hashed share of the pixels for each
    seed; tasks give only sums by seed and centre. Every centre moves towards its batch mean by its share of all the pixels
    it has had.
    """
    spark = pixels.sparkSession
    source = spread(pixels.select("x", "y", "r", "g", "b")).persist()
    colors = spread(distinct_colors(source)).persist()
    try:
        starts = best_starts(colors, k, seeds)
        centers = {s: [tuple(map(float, c)) for c in starts[s]] for s in seeds}
        had = {s: [0] * len(c) for s, c in centers.items()}
        for step in range(steps):
            for x in _batch_sums(source, centers, step, rate).collect():
                had[x.seed][x.k] += x.n
                share = x.n / had[x.seed][x.k]
                centers[x.seed][x.k] = tuple(c + share * (v / x.n - c) for c, v in zip(centers[x.seed][x.k], (x.r, x.g, x.b), strict=True))
    finally:
        source.unpersist()
        colors.unpersist()
    out = [(s, i, *(int(v) for v in c)) for s, cs in centers.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(out, "seed int, k long, r long, g long, b long")


def seed_search(pixels: DataFrame, seeds: Sequence[int] = range(20), limit: float = 5.0, **options: float) -> DataFrame:
    """(seed, i, j, delta_e) of the closest pair of each seed's palette, up to the first one below limit.

    Seeds are tried in waves of 1, 4, 16, ...: the jobs of a wave are shared, and no wave begins once one has a seed below
    limit.
    """
    spark, found, at, size = pixels.sparkSession, [], 0, 1
    seeds = list(seeds)
    while at < len(seeds) and not any(x.delta_e < limit for x in found):
        palettes = minibatch_palettes(pixels, seeds[at : at + size], **options)
        found += closest_pair(palette_conflicts(palettes, ["seed"]), "seed").collect()
        at, size = at + size, 4 * size
    rows = spark.createDataFrame([tuple(x) for x in found], "seed int, i long, j long, delta_e double")
    return search(rows, limit)
