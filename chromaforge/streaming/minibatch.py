"""Mini-batch K-means over a stream: centres and their pixel counts live from micro-batch to micro-batch.

A mini-batch is ``size`` pixels with consecutive ordinals, however the stream is cut: it is taken when all its pixels are
there and all mini-batches before it were taken; other pixels wait. So any cut, and any order of arrival, gives what
the table in order gives. The state of each micro-batch is written as tables beside the stream's checkpoint, by its number:
after a restart the stream repeats at most its last micro-batch, from the state of the one before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.assign import assign
from ..plans.shared import delete

_CENTERS = "k long, r double, g double, b double, had long, step long"

Centers = list[tuple[float, float, float, int]]


def update(pixels: DataFrame, centers: Centers) -> Centers:
    """Move every centre (r, g, b, had) towards the mean of its pixels by their share of all it has had: one aggregate."""
    near = assign(pixels, [c[:3] for c in centers])
    rows = near.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in "rgb")).collect()
    moved = list(centers)
    for x in rows:
        *center, had = moved[x.k]
        had += x.n
        moved[x.k] = (*(c + x.n / had * (v / x.n - c) for c, v in zip(center, (x.r, x.g, x.b), strict=True)), had)
    return moved


def begin(palette: Sequence[Sequence[int]]) -> Centers:
    return [(*map(float, c[:3]), 0) for c in palette]


def minibatches(pixels: DataFrame, palette: Sequence[Sequence[int]], size: int) -> Centers:
    """The same over a table (ord, r, g, b): all mini-batches in order, the last one as it is."""
    pixels, centers = pixels.select("ord", "r", "g", "b").persist(), begin(palette)
    try:
        steps = pixels.agg(F.expr(f"max(ord) div {size} + 1")).first()[0] or 0
        for step in range(steps):
            centers = update(pixels.filter(F.col("ord").between(step * size, (step + 1) * size - 1)), centers)
    finally:
        pixels.unpersist()
    return centers


class MiniBatches:
    """The state of one stream in a folder: centres, and pixels that wait for their mini-batch."""

    def __init__(self, folder: str, palette: Sequence[Sequence[int]], size: int) -> None:
        self.folder, self.palette, self.size = folder.rstrip("/"), palette, size

    def _at(self, batch: int) -> str:
        return f"{self.folder}/batch-{batch}"

    def _load(self, spark: SparkSession, batch: int) -> tuple[Centers, int, DataFrame | None]:
        if batch < 0:
            return begin(self.palette), 0, None
        rows = spark.read.schema(_CENTERS).parquet(f"{self._at(batch)}/centers").orderBy("k").collect()
        waiting = spark.read.schema("ord long, r long, g long, b long").parquet(f"{self._at(batch)}/waiting")
        return [(x.r, x.g, x.b, x.had) for x in rows], rows[0].step if rows else 0, waiting

    def _save(self, spark: SparkSession, batch: int, centers: Centers, step: int, waiting: DataFrame) -> None:
        waiting.write.mode("overwrite").parquet(f"{self._at(batch)}/waiting")
        rows = [(k, *c, step) for k, c in enumerate(centers)]
        spark.createDataFrame(rows, _CENTERS).coalesce(1).write.mode("overwrite").parquet(f"{self._at(batch)}/centers")

    def take(self, pixels: DataFrame, batch: int) -> None:
        """One micro-batch: the mini-batches that are complete now."""
        spark = pixels.sparkSession
        centers, step, waiting = self._load(spark, batch - 1)
        pixels = pixels.select("ord", "r", "g", "b")
        pixels = (pixels if waiting is None else pixels.unionByName(waiting)).withColumn("step", F.expr(f"ord div {self.size}")).persist()
        try:
            counts = pixels.groupBy("step").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == self.size)
            whole = {x.step for x in counts.collect()}  # a number a mini-batch
            while step in whole:
                centers = update(pixels.filter(F.col("step") == step), centers)
                step += 1
            self._save(spark, batch, centers, step, pixels.filter(F.col("step") >= step).drop("step"))
        finally:
            pixels.unpersist()
        if batch >= 2:  # the state before the last is what a restart may read
            delete(spark, self._at(batch - 2))

    def start(self, pixels: DataFrame, checkpoint: str) -> StreamingQuery:
        """Fold a stream of pixels (ord, r, g, b) until it has taken all there is; a later start goes on from there."""
        writer = pixels.writeStream.foreachBatch(self.take).trigger(availableNow=True)
        return writer.option("checkpointLocation", checkpoint).start()

    def result(self, spark: SparkSession, batch: int) -> Centers:
        """Centres after micro-batch number batch, with what still waits as the last mini-batches."""
        centers, _, waiting = self._load(spark, batch)
        if waiting is None:
            return centers
        steps = sorted(x.step for x in waiting.select(F.expr(f"ord div {self.size}").alias("step")).distinct().collect())
        for step in steps:
            centers = update(waiting.filter(F.expr(f"ord div {self.size}") == step), centers)
        return centers
