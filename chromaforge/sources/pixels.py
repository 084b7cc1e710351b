"""Pixel relations (ord, x, y, r, g, b; all long) from tables, images and generators.

``ord`` counts pixels row by row (ord = y * width + x), so every operator can name pixels without an array.
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import clip, lab_to_rgb, rgb_to_lab
from .png import SIGNATURE, chunk

WIDTH = 100
#: The order in which kinds of files stand in for a missing one.
FALLBACK_GLOBS = ("*.tiff", "*.tif", "*.jpg", "*.jpeg", "*.png", "*.bmp")


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of 100 columns from the events table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id").cast("long")
    return e.select(
        i.alias("ord"),
        (i % WIDTH).alias("x"),
        F.expr(f"event_id div {WIDTH}").cast("long").alias("y"),
        ((F.col("user_id") * 37) % 256).cast("long").alias("r"),
        (F.floor("value") % 256).cast("long").alias("g"),
        ((i * 7) % 256).alias("b"),
    )


def from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered colours from the first three dimensions of the embeddings table."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    i = F.col("vec_id").cast("long")

    def channel(k: int) -> Column:
        return clip(F.floor((F.col("embedding")[k].cast("double") + 0.5) * 255), 0, 255).cast("long")

    return e.select(
        i.alias("ord"), (i % WIDTH).alias("x"), F.expr(f"vec_id div {WIDTH}").cast("long").alias("y"),
        channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"),
    )


def solid(spark: SparkSession, width: int = 100, height: int = 100, color: Sequence[int] = (200, 0, 0)) -> DataFrame:
    """A raster of one colour: what stands in for an image that can't be read, where that is asked for."""
    i = F.col("id")
    return spark.range(width * height).select(
        i.alias("ord"), (i % width).alias("x"), F.expr(f"id div {width}").alias("y"),
        *(F.lit(v).cast("long").alias(c) for v, c in zip(color, "rgb", strict=True)),
    )


def resolve(spark: SparkSession, folder: str, name: str) -> str | None:
    """Path of name in folder, else of the first file of the first fallback kind that has any (by name), else None."""
    files = [r.path for r in spark.read.format("binaryFile").load(folder).select("path").collect()]
    names = {p.rpartition("/")[2]: p for p in files}
    if name in names:
        return names[name]
    for glob in FALLBACK_GLOBS:
        hits = sorted(n for n in names if fnmatch.fnmatch(n, glob))
        if hits:
            return names[hits[0]]
    return None


def from_images(spark: SparkSession, path: str | Sequence[str], batch: int = 65_536) -> DataFrame:
    """All pixels of images: image, ord, x, y, r, g, b. Grey is repeated, alpha is dropped, broken files are skipped.

    Spark's image source gives one row an image; pixels leave it in batches and are dealt anew afterwards.
    """
    raw = spark.read.format("image").option("dropInvalid", True).load(path)
    raw = raw.select(
        F.col("image.origin").alias("image"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("data")
    )

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                a = np.frombuffer(row["data"], np.uint8).reshape(-1, row["c"])
                for at in range(0, len(a), batch):
                    part = a[at : at + batch].astype(np.int64)
                    i = np.arange(at, at + len(part))
                    bgr = part[:, :3] if row["c"] >= 3 else np.repeat(part[:, :1], 3, axis=1)
                    columns = [i, i % row["w"], i // row["w"], bgr[:, 2], bgr[:, 1], bgr[:, 0]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["image"]] * len(i)), *(pa.array(np.ascontiguousarray(c)) for c in columns)],
                        ["image", "ord", "x", "y", "r", "g", "b"],
                    )

    pixels = raw.mapInArrow(explode, "image string, ord long, x long, y long, r long, g long, b long")
    return pixels.repartition("image", F.expr(f"ord div {batch}"))  # else all pixels of an image stay in its task


def png(width: int, height: int, data: bytes, channels: int = 3) -> bytes:
    """An 8-bit image file: grey, RGB or RGBA by channels."""

    line = channels * width
    rows = b"".join(b"\0" + data[line * y : line * (y + 1)] for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def tiff(width: int, height: int, rgb: bytes) -> bytes:
    """An 8-bit RGB image file without compression, in one strip."""
    short, long = 3, 4
    at = 8 + 2 + 10 * 12 + 4  # of the bits of each sample, which stand after the directory; the pixels follow
    tags = [
        (256, short, 1, width), (257, short, 1, height), (258, short, 3, at), (259, short, 1, 1), (262, short, 1, 2),
        (273, long, 1, at + 6), (277, short, 1, 3), (278, short, 1, height), (279, long, 1, len(rgb)), (284, short, 1, 1),
    ]
    entries = b"".join(struct.pack("<HHII", *tag) for tag in tags)
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + entries + struct.pack("<I3H", 0, 8, 8, 8) + rgb


def rgb_strip(spark: SparkSession, start: Sequence[int], step: Sequence[int], n: int = 11) -> DataFrame:
    """n colours (i, r, g, b) in equal steps, cut off at 0 and 255."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("i"), *(clip(F.lit(s) + i * d, 0, 255).cast("long").alias(c) for s, d, c in zip(start, step, "rgb", strict=True))
    )


def with_lab(colors: DataFrame, names: Sequence[str] = ("l", "a", "b_lab")) -> DataFrame:
    """colors and their L*a*b* columns."""
    lab = rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return colors.select("*", *(v.alias(n) for v, n in zip(lab, names, strict=True)))


def lab_strip(spark: SparkSession, gray: int, step: float, n: int = 11) -> DataFrame:
    """n colours (i, l, a, b_lab, r, g, b) in equal steps of L from a grey on; L stays in 0..100.

    r, g and b are cut after six decimals are rounded: a whole number stays one whatever the last bits are.
    """
    base = [v for v in rgb_to_lab(F.lit(gray), F.lit(gray), F.lit(gray))]
    strip = spark.range(n).select(
        F.col("id").alias("i"), clip(base[0] + F.col("id") * step, 0.0, 100.0).alias("l"), base[1].alias("a"), base[2].alias("b_lab")
    )
    rgb = lab_to_rgb(F.col("l"), F.col("a"), F.col("b_lab"))
    return strip.select("*", *(F.floor(F.round(v, 6)).cast("long").alias(c) for v, c in zip(rgb, "rgb", strict=True)))
