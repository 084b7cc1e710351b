"""Small tables (palettes, centres, runs) as one array value: the plan and its generated code stay the same whatever they hold."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import sed


def constant(value: Any, kind: str) -> Column:
    """value (lists, dicts and numbers) as one constant of a type; a tree of literals would be walked by every rule."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _kind(values: Sequence[float]) -> str:
    return "long" if all(isinstance(v, int) for v in values) else "double"


def colors(palettes: Sequence[Sequence[Sequence[float]]]) -> str:
    """Type of an array of colours, whole or real by what the palettes hold."""
    kind = _kind([v for p in palettes for c in p for v in c[:3]])
    return f"array<struct<r:{kind},g:{kind},b:{kind}>>"


def palette(colors_: Sequence[Sequence[float]]) -> Column:
    """array<struct<r, g, b>>."""
    return constant([dict(zip("rgb", c, strict=False)) for c in colors_], colors([colors_]))


def table(rows: Sequence[dict[str, float]], palettes: Sequence[Sequence[Sequence[float]]] | None = None) -> Column:
    """array<struct> of rows of numbers, with the palette p of each where palettes are given."""
    names = list(rows[0]) if rows else []
    kinds = [f"{name}:{_kind([row[name] for row in rows])}" for name in names]
    if palettes is None:
        return constant(list(rows), f"array<struct<{','.join(kinds)}>>")
    made = [row | {"p": [dict(zip("rgb", c, strict=False)) for c in p]} for row, p in zip(rows, palettes, strict=True)]
    return constant(made, f"array<struct<{','.join([*kinds, f'p:{colors(palettes)}'])}>>")


def closest(palette: Column, color: Sequence[Column]) -> Column:
    """struct<d, k>: least squared distance and index of the first colour of palette that has it."""
    return F.array_min(
        F.transform(palette, lambda c, i: F.struct(sed(color, [c[n] for n in "rgb"]).alias("d"), i.cast("long").alias("k")))
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)
