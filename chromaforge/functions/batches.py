"""Arithmetic of colours against many palettes, by numpy over Arrow batches in tasks: higher-order functions are interpreted row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def by_batch(frame: DataFrame, body: Callable[..., Sequence[np.ndarray]], schema: str) -> DataFrame:
    """Rows (schema) that body makes of the columns of each batch of frame, which are numbers without nulls."""

    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                made = body(*(c.to_numpy(zero_copy_only=False) for c in rows.columns))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in made], names)

    return frame.mapInArrow(run, schema)


def squared(color: Sequence[np.ndarray], palette: Sequence[Sequence[float]]) -> np.ndarray:
    """Squared distances, a row a colour: exact for whole numbers, and summed in the order of :func:`color.sed`."""
    held = np.array(palette, np.float64).reshape(-1, 3)
    r, g, b = (c.astype(np.float64)[:, None] - held[:, i] for i, c in enumerate(color))
    return r * r + g * g + b * b


def stacked(parts: Sequence[Sequence[np.ndarray]], kinds: Sequence[type]) -> list[np.ndarray]:
    """Columns of parts one below the other; empty ones of these kinds where there are no parts."""
    return [np.concatenate([np.empty(0, kind), *(p[i] for p in parts)]).astype(kind) for i, kind in enumerate(kinds)]


def sums(k: np.ndarray, size: int, values: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Places of 0..size-1 that occur in k, and the sums of values by them, of the values' own kind."""
    found = np.flatnonzero(np.bincount(k, minlength=size))
    out = []
    for v in values:
        total = np.zeros(size, v.dtype)
        np.add.at(total, k, v)
        out.append(total[found])
    return [found, *out]
