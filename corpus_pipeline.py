"""Corpus pipeline over the documents table: each stage works on all that the one before kept.

Quality rules drop documents; of each group of near-duplicates (five-word shingles, similarity 0.8) one stays;
sentences that an earlier document has go; personal data and secrets get surrogates; what is left is packed into
token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chromaforge.llm import near_dup, packing, pii, quality, substring_dup
from chromaforge.llm.common import documents, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dup.remove(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace(docs, key="example key")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii_surrogates", surrogates),
    ("best_fit_packing", pack),
]

#: Near-duplicate sketches, surrogates and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
