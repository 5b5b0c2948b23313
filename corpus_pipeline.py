"""The corpus pipeline: documents pass a quality filter, lose near duplicates and secrets, and are packed for training."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairwave.llm import ngrams, packing, quality, secrets
from pairwave.llm.frames import forget, noted, stored, table
from pairwave.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least doc_id, of each group of near duplicates."""
    ship(spark)
    return ngrams.one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kinds."""
    ship(spark)
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("secrets", secret_stage), ("packing", packing_stage)]

#: No stage but the last could be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next stage's input. Then what the stage itself wrote goes, and its input."""
    docs, latest = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with noted() as paths:
            docs, path = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(spark, latest + [p for p in paths if p != path])
        latest = [path]
    return docs
