"""Colour arithmetic as native column expressions: cubes, squared distances, norms, CIE L*a*b*, Delta-E."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB (IEC 61966-2-1), CIE 1976 L*a*b*, white point D65 for the 2-degree observer.
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.95047, 1.0, 1.08883)


def inverse3(m: Sequence[Sequence[float]]) -> list[list[float]]:
    """Inverse of a 3x3 matrix by cofactors."""
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    rows = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    return [[v / det for v in row] for row in rows]


FROM_XYZ = inverse3(TO_XYZ)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def cube(channel: Column, bins: int) -> Column:
    """Index of the cube that an 8-bit channel value falls into."""
    return F.floor(channel * bins / 256).cast("long")


def sed(color: Sequence[Column], other: Sequence[Column | float]) -> Column:
    """Squared Euclidean distance of two colours."""
    terms = [(a - b) * (a - b) for a, b in zip(color, (x if isinstance(x, Column) else F.lit(x) for x in other), strict=True)]
    return terms[0] + terms[1] + terms[2]


def length2(color: Sequence[Column]) -> Column:
    """Squared length of a colour."""
    return color[0] * color[0] + color[1] * color[1] + color[2] * color[2]


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """(L, a, b) of 8-bit channels, in double."""

    def linear(v: Column) -> Column:
        c = v.cast("double") / 255.0
        return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0)

    lin = [linear(v) for v in (r, g, b)]
    x, y, z = (f((lin[0] * m[0] + lin[1] * m[1] + lin[2] * m[2]) / w) for m, w in zip(TO_XYZ, WHITE, strict=True))
    return y * 116.0 - 16.0, (x - y) * 500.0, (y - z) * 200.0


def lab_to_rgb(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    """Channels in 0..255 as doubles, not yet made whole (``floor`` gives what an 8-bit cast gives)."""
    fy = (l + 16.0) / 116.0
    fx, fz = a / 500.0 + fy, F.greatest(fy - b / 200.0, F.lit(0.0))

    def t(v: Column, w: float) -> Column:
        return F.when(v > 0.2068966, v * v * v).otherwise((v - 16.0 / 116.0) / 7.787) * w

    xyz = [t(v, w) for v, w in zip((fx, fy, fz), WHITE, strict=True)]

    def gamma(v: Column) -> Column:
        c = F.when(v > 0.0031308, F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055).otherwise(v * 12.92)
        return clip(c, 0.0, 1.0) * 255.0

    r, g, bb = (gamma(xyz[0] * m[0] + xyz[1] * m[1] + xyz[2] * m[2]) for m in FROM_XYZ)
    return r, g, bb


def delta_e(p: Sequence[Column], q: Sequence[Column]) -> Column:
    """CIE76 colour difference of two L*a*b* colours."""
    return F.sqrt(sed(p, q))


def tidy(value: Column, digits: int) -> Column:
    """Rounded double without a negative zero."""
    return F.round(value, digits) + F.lit(0.0)
