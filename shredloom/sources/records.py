"""Records from JSON, JSON Lines, gzip, ZIP and XML as VARIANT rows with their provenance.

A raw table has (record_index, source_ord, source_path, source_member, line_no, v) and the text that was read, ``raw``;
``record_index`` counts the object records densely in the order of sources, members and lines. Lines that don't parse are in a table
of rejects. Once :func:`written`, a raw table has the records' shapes, for inventories, instead of their texts.
"""

from __future__ import annotations

import gzip
import io
import json
import random
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shredloom.config import Options, as_list
from shredloom.plans.inventory import with_shape
from shredloom.session import materialize, whole_variants

TEXT_SUFFIXES = (".jsonl", ".ndjson")
MEMBER_SUFFIXES = (".json", *TEXT_SUFFIXES)


@dataclass
class Raw:
    """Records, and what could not be read."""

    records: DataFrame
    rejects: DataFrame


def resolve_sources(options: Options, sampled: bool = False) -> tuple[list[str], list[str]]:
    """(paths in order, warnings): named files and sorted glob matches together; ``file_name`` only where there are neither.

    A repeated path counts once, where it came first. With ``sampled``, a seeded choice of ``sample_max_sources``.
    """
    paths, warnings = list(options.file_names), []
    globs = [options.file_glob] if isinstance(options.file_glob, str) else list(options.file_glob or [])
    for pattern in globs:
        root, _, rest = _split_glob(pattern)
        hits = sorted(str(p) for p in Path(root).glob(rest) if p.is_file())
        if not hits:
            warnings.append(f"nothing matches {pattern}")
        paths += hits
    if not paths and not globs and options.file_name:
        paths = [options.file_name]
    paths = list(dict.fromkeys(map(str, paths)))
    if missing := [p for p in paths if not Path(p).is_file()]:
        raise FileNotFoundError(", ".join(missing))
    if sampled and options.sample_max_sources and len(paths) > options.sample_max_sources:
        random.Random(options.sample_seed).shuffle(paths)
        paths = paths[: options.sample_max_sources]
    return paths, warnings


def _split_glob(pattern: str) -> tuple[str, str, str]:
    parts = Path(pattern).parts
    first = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts) - 1)
    return str(Path(*parts[:first])) if first else ".", "/", str(Path(*parts[first:]))


def _parsed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("v", F.try_parse_json("raw"))


def number_records(lines: DataFrame, order: list[str], block: list[str]) -> DataFrame:
    """Add the dense ``record_index`` over rows whose ``v`` is an object, in ``order``.

    ``block`` names columns that divide the rows into contiguous pieces of the order, such as the splits of a file: rows are
    numbered within each piece, and only one count for each piece is summed globally.
    """
    kept = lines.where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    inner = kept.withColumn("__in", F.row_number().over(Window.partitionBy(*block).orderBy(*order)))
    # one row for each piece: a few hundred thousand at most, so that a global order of them is cheap
    counts = kept.groupBy(*block).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(c).alias(f"__{c}") for c in block], before.alias("__before"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in block]
    joined = inner.join(offsets, on=_all(same), how="inner")
    return joined.select((F.col("__in") - 1 + F.col("__before")).cast("bigint").alias("record_index"), *[c for c in lines.columns])


def _all(conditions: list) -> object:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def raw_from_json(df: DataFrame, column: str, order: str, path: str = "memory") -> DataFrame:
    """Raw records from a column of JSON texts; ``order`` is a column of dense record numbers."""
    # of an array, as a filter on a plain column would be pushed below it and parse every text once more
    return df.select(
        F.col(order).cast("bigint").alias("record_index"), F.lit(0).alias("source_ord"), F.lit(path).alias("source_path"), F.lit(None).cast("string").alias("source_member"),
        (F.col(order) + 1).cast("bigint").alias("line_no"), F.explode(F.array(F.try_parse_json(column))).alias("v"), F.col(column).alias("raw"),
    ).where("v is not null")


def written(records: DataFrame) -> DataFrame:
    """The same raw records from files, for those who read them more than once: they are made and parsed once."""
    with whole_variants(records.sparkSession):
        return materialize(with_shape(records).drop("raw"), "records")


def _text_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_path, block, source_member, line_no, raw) of text files; gzip is decompressed by the reader."""
    meta = F.col("_metadata")
    text = spark.read.text(paths).select(F.col("value").alias("raw"), meta["file_path"].alias("source_path"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("__id"))
    counts = text.groupBy("source_path", "block").agg(F.count("*").alias("__n"), F.min("__id").alias("__least"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("source_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("source_path", "block", "__least", before.alias("__before"))
    return text.join(offsets, ["source_path", "block"]).select(
        "source_path", "block", F.lit(None).cast("string").alias("source_member"), (F.col("__id") - F.col("__least") + F.col("__before") + 1).cast("bigint").alias("line_no"), "raw"
    )


def _documents(data: bytes, records_key: str | None) -> list[str]:
    """The records of a JSON document: of a list, or of the list under ``records_key``; else the document."""
    value = json.loads(data)
    if records_key and isinstance(value, dict) and isinstance(value.get(records_key), list):
        value = value[records_key]
    return [json.dumps(x, ensure_ascii=False) for x in (value if isinstance(value, list) else [value])]


def _numbered(lines: Iterable[bytes]) -> Iterator[tuple[int, str]]:
    for i, line in enumerate(lines, 1):
        if line.strip():
            yield i, line.decode("utf-8", "replace").rstrip("\r\n")


def member_rows(name: str, data: bytes, records_key: str | None) -> Iterator[tuple[int | None, str]]:
    """(line or None, JSON text) of the records in a named piece of data, by its suffix and first character."""
    low = name.lower()
    if low.endswith(".gz"):
        yield from member_rows(name[:-3], gzip.decompress(data), records_key)
    elif low.endswith(".xml"):
        yield None, json.dumps(xml_record(data), ensure_ascii=False)
    elif low.endswith(TEXT_SUFFIXES) or not (records_key or data.lstrip()[:1] in (b"{", b"[")):
        yield from _numbered(io.BytesIO(data))
    else:
        try:
            rows = _documents(data, records_key)
        except ValueError:
            lines = list(_numbered(io.BytesIO(data)))
            # several lines that are records of their own, else one broken document
            yield from lines if len(lines) > 1 and lines[0][1].lstrip().startswith("{") and lines[0][1].rstrip().endswith("}") else [(None, data.decode("utf-8", "replace"))]
            return
        for row in rows:
            yield None, row


def _holds_lines(path: str, limit: int = 16 << 20) -> bool:
    """Whether a file holds JSON Lines, whatever its name: its first line is a whole object and more follows, so it is no document."""
    if path.lower().endswith((".zip", ".xml", ".gz")):
        return False
    with open(path, "rb") as f:
        lines = (line for line in iter(lambda: f.readline(limit), b"") if line.strip())
        try:
            return isinstance(json.loads(next(lines, b"")), dict) and next(lines, None) is not None
        except ValueError:
            return False


def _binary_lines(spark: SparkSession, paths: list[str], options: Options) -> DataFrame:
    """Records of whole documents and archives, each file read in one task."""
    wanted, records_key = list(options.zip_members), options.records_key

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows: list[tuple] = []
                if path.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        names = archive.namelist()
                        members = [m for m in wanted if m in names] if wanted else sorted(m for m in names if m.lower().endswith((*MEMBER_SUFFIXES, ".xml", ".gz")))
                        for k, m in enumerate(members):
                            rows += [(path, k, m, line, text) for line, text in member_rows(m, archive.read(m), records_key)]
                else:
                    rows = [(path, 0, None, line, text) for line, text in member_rows(path, content, records_key)]
                columns = list(zip(*rows)) if rows else [()] * 5
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
                at = pa.array(range(len(rows)), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), at], ["source_path", "block", "source_member", "line_no", "raw", "at"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(one, "source_path string, block bigint, source_member string, line_no bigint, raw string, at bigint")


def read_raw(spark: SparkSession, options: Options, sampled: bool = False) -> Raw:
    """All records of the options' sources. Blank lines count in ``line_no`` only; what isn't an object is no record.

    Plain and gzipped JSON Lines, also those of other names, are split and read by Spark; documents, archives and XML are read file by file.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last of repeated keys counts
    paths, _ = resolve_sources(options, sampled)
    by_line = [p for p in paths if p.lower().removesuffix(".gz").endswith(TEXT_SUFFIXES) or (p.lower().endswith(".gz") and not options.records_key) or _holds_lines(p)]
    whole = [p for p in paths if p not in by_line]
    parts = []
    if by_line:
        parts.append(_text_lines(spark, by_line).withColumn("at", F.col("line_no")))
    if whole:
        parts.append(_binary_lines(spark, whole, options))
    if not parts:
        lines = spark.createDataFrame([], "source_path string, block bigint, source_member string, line_no bigint, raw string, at bigint")
    else:
        lines = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # from Arrow, as rows of a list would start Python workers on the executors only to hand them on
    resolved = pa.table({"source_ord": pa.array(range(len(paths)), pa.int32()), "__path": pa.array([str(Path(p).resolve()) for p in paths], pa.string())})
    order = spark.createDataFrame(resolved)
    clean = F.regexp_replace(F.url_decode(F.regexp_replace(F.regexp_replace("source_path", "^file:/+", "/"), r"\+", "%2B")), "/+", "/")
    lines = lines.withColumn("source_path", clean).join(F.broadcast(order), F.col("source_path") == F.col("__path")).drop("__path")
    parsed = _parsed(lines.where("trim(raw) <> ''"))
    records = number_records(parsed, ["source_ord", "block", "at"], ["source_ord", "block"])
    records = records.select("record_index", "source_ord", "source_path", "source_member", "line_no", "v", "raw")
    if options.max_records is not None:
        records = records.where(F.col("record_index") < options.max_records)
    rejects = parsed.where("v is null").select("source_path", "source_member", "line_no", F.lit("read.json").alias("stage"), F.lit("malformed JSON").alias("message"), "raw")
    return Raw(records, rejects)


def resume_after(records: DataFrame, cursor: dict | None, backtrack: int = 0) -> DataFrame:
    """Records after a cursor {source_path, source_member?, line_no?}; an unknown path leaves them all.

    Earlier sources are dropped, and in the cursor's source the lines up to ``line_no - backtrack``.
    """
    if not cursor or not cursor.get("source_path"):
        return records
    at = records.where((F.col("source_path") == cursor["source_path"])).agg(F.min("source_ord")).first()[0]
    if at is None:
        return records
    later = F.col("source_ord") > at
    line = (cursor.get("line_no") or 0) - backtrack
    here = (F.col("source_ord") == at) & F.coalesce(F.col("line_no") > line, F.lit(True))
    if cursor.get("source_member"):
        member = F.col("source_member")
        here = (F.col("source_ord") == at) & ((member > cursor["source_member"]) | ((member == cursor["source_member"]) & F.coalesce(F.col("line_no") > line, F.lit(True))))
    return records.where(later | here)


def xml_record(data: bytes | str) -> dict:
    """An XML document as nested dicts: attributes as ``@name``, text as ``#text``, repeated children as lists."""

    def value(node: ElementTree.Element) -> object:
        out: dict = {f"@{k}": v for k, v in node.attrib.items()}
        for child in node:
            name, got = child.tag, value(child)
            if name in out:
                out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), got]
            else:
                out[name] = got
        text = "".join([node.text or "", *(c.tail or "" for c in node)]).strip()
        if not out:
            return text or None
        if text:
            out["#text"] = text
        return out

    root = ElementTree.fromstring(data)  # noqa: S314
    return {root.tag: value(root)}


def dotted(value: dict, sep: str = ".") -> dict:
    """Nested dicts as one level with joined keys; lists stay."""
    out: dict = {}
    for key, inner in value.items():
        if isinstance(inner, dict):
            out.update({f"{key}{sep}{k}": v for k, v in dotted(inner, sep).items()})
        else:
            out[key] = inner
    return out


def parse_xml(df: DataFrame, column: str) -> DataFrame:
    """Replace a column of XML texts by VARIANT records with dot-joined keys; a text that isn't XML gives NULL."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(column).to_pylist():
                try:
                    out.append(json.dumps(dotted(xml_record(text)), ensure_ascii=False) if text else None)
                except ElementTree.ParseError:
                    out.append(None)
            yield b.set_column(b.schema.get_field_index(column), column, pa.array(out, pa.string()))

    return df.mapInArrow(one, df.schema).withColumn(column, F.try_parse_json(column))


def nsf_tables(raw: DataFrame, key_on: str, ext_keys: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(main, {key: table}) of records with dot-joined keys: each ``ext_keys`` list becomes a table with the record's key."""
    from shredloom.operators.shred import get_sql

    names = as_list(ext_keys)
    key = F.expr(get_sql("v", [key_on], "string")).alias(key_on)
    listed = raw.selectExpr("v", "json_object_keys(to_json(v)) AS __keys")
    columns = sorted(r[0] for r in listed.select(F.explode("__keys")).distinct().collect() if r[0] not in names)
    main = raw.select(*[F.expr(get_sql("v", [c], "string")).alias(c) for c in columns])
    subs = {}
    for name in names:
        inner = get_sql("v", [name])
        many = f"coalesce(try_cast({inner} AS array<variant>), CASE WHEN {inner} IS NULL THEN array() ELSE array({inner}) END)"
        subs[name] = raw.select(key, F.explode(F.expr(many)).alias("value")).withColumn("value", F.to_json("value"))
    return main, subs
