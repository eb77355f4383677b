"""Sinks: Parquet and TSV artifacts, catalog tables that follow drift, compaction, snapshots, and a resumable materializer.

Parquet and the Spark catalog are the primary targets. JDBC is optional and untested here, as there is neither a server nor a driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from shredloom.functions.scalars import as_text, escape_field, quote_name
from shredloom.naming import NameMap
from shredloom.operators.drift import EXTRA, pack_extra, with_columns_of
from shredloom.operators.profile import create_table


def write_parquet(tables: Mapping[str, DataFrame], folder: str, batch: int | None = None, workers: int = 4) -> list[str]:
    """A folder for each table; with a batch number a folder below it, so that repeating a batch replaces only itself."""
    paths = {t: f"{folder.rstrip('/')}/{t}" + ("" if batch is None else f"/b{batch:06d}") for t in tables}
    with ThreadPoolExecutor(max(1, workers)) as pool:
        list(pool.map(lambda t: tables[t].write.mode("overwrite").parquet(paths[t]), tables))
    return list(paths.values())


def read_parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """All batches of a table under the union of their columns."""
    return spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(f"{folder.rstrip('/')}/{table}")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with backslash escapes and ``\\N`` for NULL."""
    text = as_text(df)
    text.select(F.concat_ws("\t", *[escape_field(F.col(f"`{c}`")) for c in text.columns]).alias("value")).write.mode("overwrite").text(path)


def save_table(df: DataFrame, name_map: NameMap, mode: str = "append") -> None:
    """Append to a catalog table under its SQL names; columns that it lacks are added first, those it has more stay NULL."""
    spark = df.sparkSession
    named = df.select(*[F.col(f"`{c}`").alias(name_map.column(c.replace(".", name_map.key_sep))) for c in df.columns])
    table = name_map.table_sql
    if mode == "overwrite" or not spark.catalog.tableExists(table):
        named.write.mode("overwrite").format("parquet").saveAsTable(table)
        return
    known = {f.name.lower(): f.dataType for f in spark.table(table).schema}
    new = [f for f in named.schema if f.name.lower() not in known]
    if new:
        spark.sql(f"ALTER TABLE {quote_name(table)} ADD COLUMNS ({', '.join(f'{quote_name(f.name)} {f.dataType.simpleString()}' for f in new)})")
    columns = spark.table(table).columns
    shaped = with_columns_of(named, columns)
    kinds = {f.name: f.dataType for f in spark.table(table).schema}
    _widen(shaped, table, kinds)
    kinds = {f.name: f.dataType for f in spark.table(table).schema}
    shaped.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in columns]).write.insertInto(table)


def _widen(df: DataFrame, table: str, kinds: Mapping[str, DataType]) -> None:
    """Make those columns of the table text that can't hold what ``df`` brings: nothing is lost without a word.

    The table is written anew only then, beside the old one, and takes its name.
    """
    spark = df.sparkSession
    other = [c for c, k in kinds.items() if df.schema[c].dataType != k and k.simpleString() != "string"]
    if not other:
        return
    misfits = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").cast("string").try_cast(kinds[c]).isNull()).alias(c) for c in other]).first()
    wide = [c for c in other if misfits[c]]
    if wide:
        beside = f"{table}__wide"
        spark.sql(f"DROP TABLE IF EXISTS {quote_name(beside)}")
        spark.table(table).select(*[F.col(f"`{c}`").cast("string").alias(c) if c in wide else F.col(f"`{c}`") for c in kinds]).write.format("parquet").saveAsTable(beside)
        spark.sql(f"DROP TABLE {quote_name(table)}")
        spark.sql(f"ALTER TABLE {quote_name(beside)} RENAME TO {quote_name(table)}")


def create_from_profile(spark: SparkSession, table: str, rows: list[Mapping]) -> str:
    """Create a Parquet table with the columns and Spark types of a profile, if it isn't there; returns the SQL text of its DDL."""
    kinds = {"BIGINT": "bigint", "INT": "bigint", "TINYINT": "bigint", "SMALLINT": "bigint", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean", "DATETIME": "timestamp"}
    columns = [f"{quote_name(r['column'])} {kinds.get(re.match('[A-Z]*', str(r['Type']))[0], 'string')}" for r in rows]
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quote_name(table)} ({', '.join(columns)}) USING parquet")
    return create_table(table, rows)


def drop_tables(spark: SparkSession, names: list[str]) -> None:
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {quote_name(n)}")


def compact(spark: SparkSession, path: str, target: str, key: str | None = None, bytes_per_file: int = 256 << 20) -> int:
    """Rewrite a Parquet folder with fewer files, sorted by the key within each; returns the number of files."""
    df = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    files = max(1, -(-size // bytes_per_file))
    out = df.repartitionByRange(files, key).sortWithinPartitions(key) if key else df.repartition(files)
    out.write.mode("overwrite").parquet(target)
    return files


def snapshot(df: DataFrame, folder: str) -> None:
    """A backup: the rows as Parquet, and the schema beside them."""
    df.write.mode("overwrite").parquet(f"{folder}/data")
    Path(folder.removeprefix("file://")).mkdir(parents=True, exist_ok=True)
    Path(folder.removeprefix("file://"), "schema.json").write_text(df.schema.json(), encoding="utf-8")


def materialize_artifacts(spark: SparkSession, folder: str, progress: str, freeze: bool = True, key: str = "id", workers: int = 4) -> dict[str, int]:
    """Load every table folder of Parquet batches into the catalog, each batch once: what is done is kept in a JSON file.

    The first batch decides the columns; later ones put what is new into ``__extra__``, or without ``freeze`` add columns.
    """
    state_file = Path(progress)
    state: dict[str, list[str]] = json.loads(state_file.read_text()) if state_file.exists() else {}
    root = Path(folder)

    def one(table: str) -> int:
        done, n = set(state.get(table, [])), 0
        batches = sorted({str(p.parent) for p in (root / table).rglob("*.parquet")})
        for batch in batches:
            if batch in done:
                continue
            df = spark.read.parquet(batch)
            if freeze:
                allowed = [c for c in spark.table(table).columns if c != EXTRA] if spark.catalog.tableExists(table) else df.columns
                df = with_columns_of(pack_extra(df, allowed, key), [*allowed, EXTRA])
            save_table(df, NameMap.build(table, df.columns))
            done.add(batch)
            state[table] = sorted(done)
            part = state_file.with_suffix(".part")
            part.write_text(json.dumps(state))
            part.replace(state_file)
            n += 1
        return n

    tables = sorted(p.name for p in root.iterdir() if p.is_dir())
    # one writer of the progress file: batches of a table in order, tables one after another
    return {t: one(t) for t in tables}


def write_jdbc(df: DataFrame, url: str, name_map: NameMap, properties: Mapping[str, str]) -> None:
    """Append all columns as text over JDBC."""
    named = as_text(df).toDF(*[name_map.column(c) for c in df.columns])
    named.write.mode("append").jdbc(url, name_map.table_sql, properties=dict(properties))
