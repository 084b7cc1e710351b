"""Starts for K-means by oversampling (k-means||): several rounds of draws over the data, then a weighted reduction.

A round draws every colour with a chance in proportion to its share of the error that the centres so far leave, about
``2 k`` of them at once, so a few rounds replace k passes. The candidates get as weights the pixels they are nearest to and
are reduced to k by weighted D² draws on the driver: they are about ``2 k`` a round, however large the image.

Any number of starts share the jobs: tasks compare their colours with the centres of all starts by numpy, and only sums and
drawn colours leave them. Draws are hashes of colour, seed, start and round, so every engine and every retry makes the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import by_batch, squared, stacked, sums
from .sampling import HASH, MODULUS

#: Rounds of draws, colours drawn a round by factor times k, and starts of which the best is kept.
ROUNDS, FACTOR, STARTS = 3, 2, 3
#: Multiplier of the round, and the number of the first draw of the reduction.
STEP, REDUCE = 15485863, 100
#: Number of 8-bit colours.
CODES = 256**3

Run = tuple[int, int]
Centers = list[tuple[int, int, int]]


def color_code(color: Sequence[Column | np.ndarray]) -> Column | np.ndarray:
    return (color[0] * 256 + color[1]) * 256 + color[2]


def draw_hash(code: Column | np.ndarray, seed: Column | int, start: Column | int, step: int) -> Column | np.ndarray:
    """From 0 to MODULUS - 1, for a colour in one round of one start."""
    a, b, c = HASH
    return (code * a + seed * b + start * c + step * STEP) % MODULUS


def _errors(colors: DataFrame, centers: Sequence[Centers]) -> list[int]:
    """Error sum that each start's centres leave: one aggregate of a row a start."""

    def body(r: np.ndarray, g: np.ndarray, b: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        errors = [(squared((r, g, b), c).min(1).astype(np.int64) * n).sum() for c in centers]
        return [np.arange(len(centers)), np.array(errors)]

    rows = by_batch(colors.select("r", "g", "b", "n"), body, "j long, e long")
    found = {x.j: x.e for x in rows.groupBy("j").agg(F.sum("e").alias("e")).collect()}
    return [found[j] for j in range(len(centers))]


def _first(colors: DataFrame, runs: Sequence[Run]) -> list[Centers]:
    """The colour of the least hash for each start, the least code among equals."""

    def body(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        code = color_code((r, g, b))
        return [np.arange(len(runs)), np.array([(draw_hash(code, seed, start, 0) * CODES + code).min() for seed, start in runs])]

    least = by_batch(colors.select("r", "g", "b"), body, "j long, m long").groupBy("j").agg(F.min("m").alias("m"))
    found = {x.j: x.m % CODES for x in least.collect()}
    return [[(found[j] // 65536, found[j] // 256 % 256, found[j] % 256)] for j in range(len(runs))]


def _draw(colors: DataFrame, runs: Sequence[Run], centers: Sequence[Centers], k: int, step: int) -> DataFrame:
    """(j, code) of the colours that each start draws in a round."""
    errors = _errors(colors, centers)

    def body(r: np.ndarray, g: np.ndarray, b: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        code, parts = color_code((r, g, b)), []
        for j, (seed, start) in enumerate(runs):
            d = squared((r, g, b), centers[j]).min(1).astype(np.int64)
            drawn = code[draw_hash(code, seed, start, step) / float(MODULUS) * float(errors[j]) < (FACTOR * k * n * d).astype(np.float64)]
            parts.append((np.full(len(drawn), j), drawn))
        return stacked(parts, (np.int64, np.int64))

    return by_batch(colors.select("r", "g", "b", "n"), body, "j long, code long")


def _weights(colors: DataFrame, centers: Sequence[Centers]) -> DataFrame:
    """(j, k, n): pixels nearest to each centre of each start, the first one among equals."""

    def body(r: np.ndarray, g: np.ndarray, b: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        parts = []
        for j, c in enumerate(centers):
            k, total = sums(squared((r, g, b), c).argmin(1), len(c), [n])
            parts.append((np.full(len(k), j), k, total))
        return stacked(parts, (np.int64, np.int64, np.int64))

    rows = by_batch(colors.select("r", "g", "b", "n"), body, "j long, k long, n long")
    return rows.groupBy("j", "k").agg(F.sum("n").alias("n"))


def reduce(candidates: Centers, weights: Sequence[int], k: int, seed: int, start: int) -> Centers:
    """k of the candidates by weighted D² draws; fewer where there are not as many different ones."""
    order = sorted(range(len(candidates)), key=lambda i: candidates[i])
    mass, chosen = [weights[i] for i in order], []
    near = [None] * len(order)
    for step in range(k):
        total = sum(mass)
        if not total:
            break
        limit = (seed * HASH[1] + start * HASH[2] + (REDUCE + step) * STEP) % MODULUS / MODULUS * total
        reached = 0
        for i, m in enumerate(mass):
            reached += m
            if reached > limit:
                break
        chosen.append(candidates[order[i]])
        for at, j in enumerate(order):
            d = sum((x - y) ** 2 for x, y in zip(candidates[j], chosen[-1], strict=True))
            near[at] = d if near[at] is None else min(near[at], d)
            mass[at] = weights[j] * near[at]
    return chosen


def oversampled(colors: DataFrame, k: int, runs: Sequence[Run], n: int) -> list[Centers]:
    """Up to k centres for each (seed, start) of runs, over n distinct colours (r, g, b, n)."""
    if not n or not k:
        return [[] for _ in runs]
    centers = _first(colors, runs)
    for step in range(1, ROUNDS + 1):
        for x in _draw(colors, runs, centers, k, step).collect():
            centers[x.j].append((x.code // 65536, x.code // 256 % 256, x.code % 256))
    centers = [sorted(c) for c in centers]
    weights = [[0] * len(c) for c in centers]
    for x in _weights(colors, centers).collect():
        weights[x.j][x.k] = x.n
    return [reduce(centers[j], weights[j], k, seed, start) for j, (seed, start) in enumerate(runs)]


def best_starts(colors: DataFrame, k: int, seeds: Sequence[int], starts: int = STARTS) -> dict[int, Centers]:
    """For each seed the centres of the start that leaves the least error on all colours; the earliest wins ties."""
    n = colors.count()
    runs = [(seed, start) for seed in seeds for start in range(starts)]
    centers = oversampled(colors, k, runs, n)
    if not n or not k:
        return {seed: [] for seed in seeds}
    errors = _errors(colors, centers)
    best = {seed: min((errors[j], j) for j, run in enumerate(runs) if run[0] == seed)[1] for seed in seeds}
    return {seed: centers[j] for seed, j in best.items()}
