"""PNG files written in bands: no task holds an image.

A band of rows is compressed by itself, to a point where another band's data may follow, and is one chunk of the file. The
file's checksum over all bands follows from the bands' own (checksum and length), so chunks are only strung together: a
task streams an image's bands to its file one by one, under another name until the file is whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels of a band, about; a band has one row at least.
BAND = 1_000_000
#: Modulus of the checksum, head of the compressed data, signature of the file.
MODULUS, HEAD, SIGNATURE = 65521, b"\x78\x9c", b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def join_checksums(first: int, second: int, length: int) -> int:
    """Adler-32 of two parts from those of each; length: bytes of the second.

    The low half is one and the sum of all bytes, the high half the sum of all low halves on the way.
    """
    low, low2 = first & 0xFFFF, second & 0xFFFF
    high = (first >> 16) + (second >> 16) + length * (low - 1)
    return high % MODULUS << 16 | (low + low2 - 1) % MODULUS


def bands(pixels: DataFrame, by: str = "image", size: int = BAND) -> DataFrame:
    """(by, width, height, band, data, adler, bytes): compressed bands of rows; pixels that are missing are black."""
    dims = pixels.groupBy(by).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    # a row an image; null names are no images
    placed = pixels.select(by, "x", "y", "r", "g", "b").join(dims, by)
    rows = F.greatest(F.lit(size) / F.col("width"), F.lit(1)).cast("long").alias("rows")
    placed = placed.select("*", rows).withColumn("band", F.floor(F.col("y") / F.col("rows")))

    def build(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        name, band = key
        width, height, rows = (int(g[c].iloc[0]) for c in ("width", "height", "rows"))
        top = band * rows
        lines = np.zeros((min(rows, height - top), 1 + 3 * width), np.uint8)  # each line begins with its filter, none
        lines[:, 1:].reshape(len(lines), width, 3)[g["y"] - top, g["x"]] = g[["r", "g", "b"]].to_numpy(np.uint8)
        raw, packer = lines.tobytes(), zlib.compressobj(6, zlib.DEFLATED, -15)
        data = packer.compress(raw) + packer.flush(zlib.Z_FINISH if top + len(lines) == height else zlib.Z_SYNC_FLUSH)
        return pd.DataFrame({by: [name], "width": [width], "height": [height], "band": [band], "data": [data], "adler": [zlib.adler32(raw)], "bytes": [len(raw)]})

    return placed.groupBy(by, "band").applyInPandas(build, f"{by} string, width long, height long, band long, data binary, adler long, bytes long")


def write(pixels: DataFrame, folder: str, by: str = "image", size: int = BAND) -> DataFrame:
    """Write each image to folder/<name>.png: (by, path, bands, bytes, adler). The files exist once the result is computed."""
    parts = bands(pixels, by, size).repartition(by).sortWithinPartitions(by, "band")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        name, out, sums = None, None, (0, 0, 1)

        def close() -> pa.RecordBatch:
            out.write(chunk(b"IDAT", struct.pack(">I", sums[2])) + chunk(b"IEND", b""))
            out.close()
            system.move(f"{root}/.{name}.part", f"{root}/{name}.png")
            return pa.RecordBatch.from_pydict({by: [name], "path": [f"{folder}/{name}.png"], "bands": [sums[0]], "bytes": [sums[1]], "adler": [sums[2]]})

        for batch in batches:
            for row in batch.to_pylist():
                if row[by] != name:
                    if out:
                        yield close()
                    name, sums = row[by], (0, 0, 1)
                    out = system.open_output_stream(f"{root}/.{name}.part")
                    out.write(SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", row["width"], row["height"], 8, 2, 0, 0, 0)))
                out.write(chunk(b"IDAT", (b"" if row["band"] else HEAD) + row["data"]))
                sums = (sums[0] + 1, sums[1] + row["bytes"], join_checksums(sums[2], row["adler"], row["bytes"]))
        if out:
            yield close()

    return parts.mapInArrow(stream, f"{by} string, path string, bands long, bytes long, adler long")
