"""Queries that write files from the test tables and read them back through the sources, the sinks and whole runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shredloom.config import Options
from shredloom.operators.shred import shred
from shredloom.operators.sinks import read_parquet, write_parquet, write_tsv
from shredloom.plans.roster import query
from shredloom.run import run_json
from shredloom.session import shared_dir, table
from shredloom.sources.records import read_raw
from shredloom.sources.tabular import read_table
from shredloom.streaming.loop import stream

_ORDERS = "SELECT o_orderkey AS id, o_orderstatus AS hdr__status, o_custkey AS hdr__cust FROM orders"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _plain(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _order_lines(spark: SparkSession, sf_dir: str, files: int = 3, **options: str) -> str:
    """Orders as JSON Lines files; the pattern that matches them."""
    folder = _folder(spark, "orders")
    record = F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust")).alias("hdr"))
    table(spark, sf_dir, "orders").select(F.to_json(record).alias("value")).repartition(files).write.options(**options).text(folder)
    return f"{_plain(folder)}/part-*"


def _typed(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("bigint").alias("id"), "hdr__status", F.col("hdr__cust").cast("bigint").alias("hdr__cust"))


@query(_ORDERS)
def source_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(shred(read_raw(spark, Options(file_glob=_order_lines(spark, sf_dir))).records).main)


@query(_ORDERS)
def source_gzip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(shred(read_raw(spark, Options(file_glob=_order_lines(spark, sf_dir, compression="gzip"))).records).main)


@query("SELECT count(*) AS n, 0 AS low, count(*) - 1 AS high, count(*) AS different FROM orders")
def source_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record numbers are dense over all files."""
    records = read_raw(spark, Options(file_glob=_order_lines(spark, sf_dir, 4))).records
    n = F.col("record_index")
    return records.agg(F.count("*").alias("n"), F.min(n).cast("int").alias("low"), F.max(n).alias("high"), F.count_distinct(n).alias("different"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def source_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "customer")
    table(spark, sf_dir, "customer").write.csv(folder, header=True, quote='"', escape='"')
    df = read_table(spark, Options(file_name=folder, file_type="csv", SEP=","))
    return df.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def sink_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "part")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    write_tsv(part, folder)
    cells = F.split("value", "\t", -1)
    return spark.read.text(folder).select(*[cells[i].cast(f.dataType).alias(f.name) for i, f in enumerate(part.schema)])


@query("SELECT s_suppkey, s_name, CASE WHEN s_nationkey >= 12 THEN s_acctbal END AS s_acctbal FROM supplier")
def sink_parquet_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, of which the second has one more column."""
    folder, supplier = _folder(spark, "supplier"), table(spark, sf_dir, "supplier")
    write_parquet({"s": supplier.where("s_nationkey < 12").select("s_suppkey", "s_name")}, folder, 0)
    for _ in range(2):  # a repeated batch replaces itself
        write_parquet({"s": supplier.where("s_nationkey >= 12").select("s_suppkey", "s_name", "s_acctbal")}, folder, 1)
    return read_parquet(spark, folder, "s").select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, value FROM events")
def stream_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON Lines through the streaming loop, one file for each batch."""
    lines, out = _folder(spark, "lines"), _folder(spark, "stream")
    record = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")
    table(spark, sf_dir, "events").select(F.to_json(record).alias("value")).repartition(3).write.text(lines)
    stream(spark, lines, _plain(out), f"{_plain(out)}-checkpoint", Options(table_name="e")).awaitTermination()
    return read_parquet(spark, _plain(out), "e").select("id", "kind", F.col("value").cast("double").alias("value"))


@query(_ORDERS)
def json_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run over files: its main table as written."""
    out = _plain(_folder(spark, "run"))
    report = run_json(spark, {"file_glob": _order_lines(spark, sf_dir), "table_name": "o", "out_path": out})
    return _typed(spark.read.parquet(*[p for p in report.artifacts["paths"] if p.endswith("/o")]))
