"""Delimited, Feather and Parquet files, description files, and slices of Parquet artifacts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shredloom.config import Options


def read_table(spark: SparkSession, options: Options) -> DataFrame:
    """The file of the options by its ``file_type`` (csv, txt, tsv, ftr, feather, parquet)."""
    kind = (options.file_type or Path(options.file_name or "").suffix.lstrip(".")).lower()
    if kind in ("csv", "txt", "tsv"):
        return spark.read.csv(options.file_name, sep="," if kind == "csv" and options.SEP == "\t" else options.SEP, header=True, inferSchema=True, quote='"', escape='"', multiLine=True)
    if kind in ("ftr", "feather"):
        from pyarrow import feather

        return spark.createDataFrame(feather.read_table(options.file_name))
    if kind == "parquet":
        return spark.read.parquet(options.file_name)
    raise ValueError(f"no reader for files of type {kind!r}")


def read_description(spark: SparkSession, path: str, key_sep: str = "__") -> list[dict]:
    """Rows of a ``_Desc.csv`` file; dots in column names stand for the separator."""
    df = spark.read.csv(path, header=True, quote='"', escape='"')
    first = df.columns[0]
    rows = [r.asDict() for r in df.withColumn(first, F.regexp_replace(first, r"\.", key_sep)).collect()]
    return [{"column": r.pop(first), **r} for r in rows]


def parquet_footer(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """(columns, rows) without reading data pages."""
    df = spark.read.parquet(path)
    return df.columns, df.count()


def parquet_slice(spark: SparkSession, path: str, columns: list[str], offset: int, limit: int, order: str = "record_index") -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` by a dense number column: a range filter that reaches the scan."""
    df = spark.read.parquet(path).where((F.col(order) >= offset) & (F.col(order) < offset + limit))
    return df.select(*[c for c in columns if c in df.columns])
