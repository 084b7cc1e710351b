"""The cube histogram as a streaming aggregate: sums and counts merge, so pixels may arrive in any batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.histogram import cube_histogram


def stream_histogram(pixels: DataFrame, name: str, checkpoint: str, bins: int = 16) -> StreamingQuery:
    """Keep the histogram of a stream of pixels (ord, r, g, b) in the in-memory table name."""
    counts = cube_histogram(pixels, bins).withColumn("bins", F.lit(bins))
    writer = counts.writeStream.outputMode("complete").format("memory").queryName(name)
    return writer.option("checkpointLocation", checkpoint).start()
