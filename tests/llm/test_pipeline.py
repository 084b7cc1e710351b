"""The pipeline over a small table, its stages one by one, and the entry points."""

from pyspark.sql import functions as F

import corpus_pipeline
from chromaforge.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("places", F.lit("x"))
    count = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= count, name
        docs, count = out, out.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == count


def test_run_gives_pieces_of_kept_documents(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and all(0 < r.length <= 1024 for r in rows)


def test_every_operator_has_one_query():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
