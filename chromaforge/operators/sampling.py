"""Deterministic pixel samples: so many of each block, a rate of all, a fixed number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampling rate to block edge and pixels taken of a block.
BLOCKS = {0.5: (2, 2), 0.25: (2, 1), 0.125: (4, 2), 0.0625: (4, 1), 0.03125: (8, 2)}
#: Multipliers and modulus of the position hash.
HASH, MODULUS = (73856093, 19349663, 83492791), 1000003


def position_hash(seed: int = 0) -> Column:
    """Hash of a pixel's place, from 0 to MODULUS - 1."""
    a, b, c = HASH
    return (F.col("x") * a + F.col("y") * b + F.lit(seed * c)) % MODULUS


def block_sample(pixels: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Pixels by rate: all for 1, a fixed number of every block for the known rates, else each with chance rate.

    Blocks hold at most 64 pixels, so the window never sees a large group; blocks at the edges are smaller.
    """
    if abs(rate - 1) < 1e-9:
        return pixels
    known = next((v for k, v in BLOCKS.items() if abs(rate - k) < 1e-9), None)
    if known is None:
        return bernoulli(pixels, rate, seed)
    edge, take = known
    w = Window.partitionBy(F.expr(f"y div {edge}"), F.expr(f"x div {edge}")).orderBy(position_hash(seed), "ord")
    return pixels.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= take).drop("_rank")


def nested_counts(pixels: DataFrame, rates: Sequence[float], seed: int = 0) -> DataFrame:
    """(r, g, b, n): for each colour an array of its pixels in the samples of all rates, over one pass.

    A pixel's rank in its block decides on every rate of that block's size, so samples of one size are nested. Blocks lie in
    those of the next size (edges are powers of 2), so one shuffle, by the largest blocks, serves all sizes.
    """
    known = {rate: next((v for k, v in BLOCKS.items() if abs(rate - k) < 1e-9), None) for rate in rates}
    ranked = pixels
    edges = sorted({v[0] for v in known.values() if v}, reverse=True)
    if edges:
        places = [F.expr(f"{c} div {edge}").alias(f"_{c}{edge}") for edge in edges for c in "yx"]
        ranked = pixels.select("*", *places).repartition(f"_y{edges[0]}", f"_x{edges[0]}")
    for i, edge in enumerate(edges):
        w = Window.partitionBy(*(f"_{c}{e}" for e in edges[: i + 1] for c in "yx")).orderBy(position_hash(seed), "ord")
        ranked = ranked.withColumn(f"_rank{edge}", F.row_number().over(w))

    def taken(rate: float) -> Column:
        if abs(rate - 1) < 1e-9:
            return F.lit(True)
        return F.col(f"_rank{known[rate][0]}") <= known[rate][1] if known[rate] else position_hash(seed) < F.lit(rate * MODULUS)

    counts = [F.sum(F.when(taken(rate), 1).otherwise(0)) for rate in rates]
    return ranked.groupBy("r", "g", "b").agg(F.array(*counts).alias("n"))


def bernoulli(pixels: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Each pixel with chance rate, by its position hash: a filter, so no shuffle."""
    return pixels.filter(position_hash(seed) < F.lit(rate * MODULUS))


def fixed_size(pixels: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n pixels (a top-n, so each task sends n rows at most)."""
    return pixels.orderBy(position_hash(seed), "ord").limit(n)


def effective_rate(pixels: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """One row: rate, n_sampled, n_total."""
    sampled = block_sample(pixels, rate, seed).agg(F.count(F.lit(1)).alias("n_sampled"))
    whole = pixels.agg(F.count(F.lit(1)).alias("n_total"))
    return sampled.crossJoin(whole).select(F.lit(rate).alias("rate"), "n_sampled", "n_total")  # one row each
