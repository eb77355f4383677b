"""One query for each operator, over its whole table with production parameters, and SQL where it can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shredloom.llm import ann, decontaminate, line_dedup, near_dup, ngram_lm, packing, pii, quality, toxicity, warc
from shredloom.session import shared_dir, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxic_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and secrets of all documents."""
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC files and read back through the data source."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_pages(table(spark, sf_dir, "pages"), folder)
    return warc.read_pages(spark, folder)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    docs = table(spark, sf_dir, "documents")
    return quality.kept_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with near duplicates, and the one that stays for each."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, under the n-gram model of all documents but itself, of each document whose id is divisible by 100."""
    docs = table(spark, sf_dir, "documents")
    return ngram_lm.scores(docs, docs.where("doc_id % 100 = 0"), ["doc_id"], own="doc_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without lines that are spread over many sources."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of all embeddings for each one whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all documents."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_near_dup": op5_near_dup,
    "op6_ngram_lm": op6_ngram_lm,
    "op7_line_dedup": op7_line_dedup,
    "op8_ann": op8_ann,
    "op9_decontaminate": op9_decontaminate,
    "op10_packing": op10_packing,
}
ORACLE: dict[str, str] = {"op3_warc": warc.ORACLE, "op7_line_dedup": line_dedup.ORACLE}
