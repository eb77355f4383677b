"""The corpus pipeline: quality filter, line deduplication, near-duplicate removal, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder
and read again as the next one's documents. All but the last return the columns of ``documents``.

Texts are handed to Python workers in batches of at most ``ROWS`` rows, as both sides hold a batch whole. Stages are lazy, so
they set that for the session; :func:`run`, which writes their results, sets it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shredloom.llm import decontaminate, line_dedup, near_dup, packing, quality
from shredloom.session import batches_of, shared_dir, smaller_batches, table

ROWS = 1000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the classifier, trained on the labelled of them, rejects go."""
    smaller_batches(spark, ROWS)
    return quality.quality_filter(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: lines spread over many sources stay in one document; documents that lose all their text go."""
    return line_dedup.line_dedup(docs, drop_emptied=True)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group stays."""
    smaller_batches(spark, ROWS)
    return near_dup.near_dedup(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark item go."""
    smaller_batches(spark, ROWS)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: windows of what is left."""
    smaller_batches(spark, ROWS)
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", lines_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # a trained classifier, MinHash and best fit are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    with batches_of(spark, ROWS):
        for name, stage in STAGES:
            path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
