"""Bounds of Arrow batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from chromaforge.llm.chunks import slices
from chromaforge.llm.common import BATCH_BYTES, BATCH_ROWS, map_arrow

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_by_rows_and_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    before = spark.conf.get(ROWS)
    try:
        spark.conf.set(ROWS, 10_000)
        spark.conf.unset(BYTES)
        short = spark.range(0, 5000, 1, 1).select(F.lit("a").alias("text"))
        found = map_arrow(short, sizes, "n long, size long").collect()
        assert sum(r["n"] for r in found) == 5000
        assert max(r["n"] for r in found) <= BATCH_ROWS
        long = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 500_000).alias("text"))
        found = map_arrow(long, sizes, "n long, size long").collect()
        assert sum(r["n"] for r in found) == 200
        assert max(r["size"] for r in found) <= BATCH_BYTES + 1_000_000
        spark.conf.set(ROWS, 7)
        found = map_arrow(short, sizes, "n long, size long").collect()
        assert max(r["n"] for r in found) == 7
    finally:
        spark.conf.set(ROWS, before)


def test_slices_keep_every_row():
    texts = [None, "", "ab" * 10, "é" * 30, "x" * 100, None, "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    parts = list(slices(batch, 0, 50))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert [p.num_rows for p in parts] == [4, 1, 2]
    assert not list(slices(batch.slice(0, 0), 0, 50))
