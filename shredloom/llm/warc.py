"""WARC files as a Spark data source (``format("warc")``), and a writer for tables of pages.

Planning lists the files and packs them into partitions of about ``partitionbytes``. Predicates on columns that come
from the record's own header (type, id, URI, date, length) or from the HTTP header are pushed into the reader, which
parses the WARC header first, then, only for records that passed, the HTTP header, and decodes (chunks, gzip or deflate
content) only payloads of records that passed both. With option ``payload=false`` no payload is decoded at all.

Options: ``path`` (file, folder or several, separated by commas), ``payload``, ``partitionbytes``, ``mode``
(``permissive``: look for the next record after a malformed one, and go on behind damaged or cut-off compression;
``failfast``: raise). No files or empty ones give no rows; repeated records come as often as they occur; a payload is held
whole, whatever its length, and batches are cut by bytes; headers that a record lacks are null.
"""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

SCHEMA = (
    "warc_type string, record_id string, target_uri string, warc_date string, content_type string, content_length bigint, "
    "headers map<string,string>, http_status int, http_content_type string, http_headers map<string,string>, payload binary, path string"
)
_FROM_WARC = {"warc_type", "record_id", "target_uri", "warc_date", "content_type", "content_length", "path"}
_FROM_HTTP = {"http_status", "http_content_type"}
_ARROW = pa.schema(
    [
        ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_type", pa.string()),
        ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("http_status", pa.int32()), ("http_content_type", pa.string()),
        ("http_headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("path", pa.string()),
    ]
)
BATCH_BYTES = 4 << 20

_TESTS: dict[type, Callable] = {
    ds.EqualTo: lambda x, f: x is not None and x == f.value,
    ds.EqualNullSafe: lambda x, f: x == f.value,
    ds.In: lambda x, f: x is not None and x in f.value,
    ds.GreaterThan: lambda x, f: x is not None and x > f.value,
    ds.GreaterThanOrEqual: lambda x, f: x is not None and x >= f.value,
    ds.LessThan: lambda x, f: x is not None and x < f.value,
    ds.LessThanOrEqual: lambda x, f: x is not None and x <= f.value,
    ds.StringStartsWith: lambda x, f: x is not None and x.startswith(f.value),
    ds.StringEndsWith: lambda x, f: x is not None and x.endswith(f.value),
    ds.StringContains: lambda x, f: x is not None and f.value in x,
    ds.IsNull: lambda x, f: x is None,
    ds.IsNotNull: lambda x, f: x is not None,
}


@dataclass
class Files(ds.InputPartition):
    uris: list[str]


def _parse_header(lines: list[bytes]) -> dict[str, str]:
    """Names in lower case; a line that begins with space continues the one before."""
    found: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            found[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if colon:
            name = key.strip().lower().decode("utf-8", "replace")
            found[name] = value.strip().decode("utf-8", "replace")
    return found


def _decoded(body: bytes, header: dict[str, str]) -> bytes:
    if header.get("transfer-encoding", "").lower() == "chunked":
        parts, at = [], 0
        while True:
            end = body.find(b"\r\n", at)
            try:
                size = int(body[at:end].split(b";")[0], 16) if end >= 0 else 0
            except ValueError:
                size = 0
            if not size:
                break
            parts.append(body[end + 2 : end + 2 + size])
            at = end + 2 + size + 2
        body = b"".join(parts)
    coding = header.get("content-encoding", "").lower()
    try:
        if coding in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif coding == "deflate":
            body = zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass  # a payload that isn't what its header says is given as it is
    return body


class Members(io.RawIOBase):
    """Gzip members one after another; what comes before damage is given, and the next member is looked for behind it."""

    def __init__(self, raw: io.BufferedIOBase, failfast: bool) -> None:
        self.raw, self.failfast = raw, failfast
        self.held, self.ready, self.member = b"", b"", None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer: memoryview) -> int:
        while not self.ready:
            if not self.held:
                self.held = self.raw.read(1 << 16)
                if not self.held:
                    if self.failfast and self.member:
                        raise EOFError("the last gzip member is cut off")
                    return 0
            if self.member is None:
                at = self.held.find(b"\x1f\x8b")
                if self.failfast and self.held[: max(at, 0)].strip(b"\0"):
                    raise ValueError("no gzip member")
                self.held = self.held[at:] if at >= 0 else b""
                self.member = zlib.decompressobj(31) if self.held else None
                continue
            try:
                self.ready = self.member.decompress(self.held, 1 << 20)
                self.held = self.member.unconsumed_tail
                if self.member.eof:
                    self.held, self.member = self.member.unused_data, None
            except zlib.error:
                if self.failfast:
                    raise
                self.held, self.member = self.held[2:], None
        n = min(len(buffer), len(self.ready))
        buffer[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict) -> None:
        path = options.get("path") or ""
        self.paths = [p.strip() for p in path.split(",") if p.strip()]
        if not self.paths:
            raise ValueError("option path is missing")
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.size = int(options.get("partitionbytes", 128 << 20))
        self.failfast = str(options.get("mode", "permissive")).lower() == "failfast"
        self.on_warc: list = []
        self.on_http: list = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        """Take what the headers can decide; give the rest back to Spark."""
        for f in filters:
            negated = isinstance(f, ds.Not)
            inner = f.child if negated else f
            column = getattr(inner, "attribute", ())
            if type(inner) in _TESTS and len(column) == 1 and not negated:
                if column[0] in _FROM_WARC:
                    self.on_warc.append(f)
                    continue
                if column[0] in _FROM_HTTP:
                    self.on_http.append(f)
                    continue
            yield f

    def partitions(self) -> Sequence[ds.InputPartition]:
        found: list[tuple[str, int]] = []
        for uri in self.paths:
            system, path = fs.FileSystem.from_uri(uri)
            scheme = uri[: uri.index("://") + 3] if "://" in uri else ""
            info = system.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(uri)
            if info.type == fs.FileType.Directory:
                files = [x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and x.base_name[0] not in "._"]
            else:
                files = [info]
            found += [(scheme + x.path, x.size or 0) for x in files if (x.size or 0) > 0]
        parts: list[Files] = []
        room = 0
        for uri, size in sorted(found):
            if not parts or room < size:
                parts.append(Files([]))
                room = self.size
            parts[-1].uris.append(uri)
            room -= size
        return parts or [Files([])]

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for uri in partition.uris:
            for row in self._records(uri):
                rows.append(row)
                held += len(row["payload"] or b"") + 500
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def _records(self, uri: str) -> Iterator[dict]:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw:
            stream = io.BufferedReader(raw, 1 << 20)
            if stream.peek(2)[:2] == b"\x1f\x8b":
                stream = io.BufferedReader(Members(stream, self.failfast), 1 << 20)
            while True:
                line = stream.readline()
                if not line:
                    return
                if not line.strip():
                    continue
                if not line.startswith(b"WARC/"):
                    if self.failfast:
                        raise ValueError(f"{uri}: no WARC record at {line[:40]!r}")
                    continue
                lines = []
                while (line := stream.readline()) and line.strip():
                    lines.append(line)
                header = _parse_header(lines)
                try:
                    length = int(header["content-length"])
                    if length < 0:
                        raise ValueError
                except (KeyError, ValueError):
                    if self.failfast:
                        raise ValueError(f"{uri}: a record has no valid Content-Length") from None
                    continue
                row = {
                    "warc_type": header.get("warc-type"), "record_id": header.get("warc-record-id"), "target_uri": header.get("warc-target-uri"),
                    "warc_date": header.get("warc-date"), "content_type": header.get("content-type"), "content_length": length,
                    "headers": list(header.items()), "http_status": None, "http_content_type": None, "http_headers": None, "payload": None, "path": uri,
                }
                if not all(_TESTS[type(f)](row[f.attribute[0]], f) for f in self.on_warc):
                    self._skip(stream, length)
                    continue
                left = length
                http: dict[str, str] = {}
                if (row["content_type"] or "").startswith("application/http"):
                    first = stream.readline(left)
                    left -= len(first)
                    lines = []
                    while left and (line := stream.readline(left)):
                        left -= len(line)
                        if not line.strip():
                            break
                        lines.append(line)
                    http = _parse_header(lines)
                    parts = first.split(None, 2)
                    if first.startswith(b"HTTP/") and len(parts) > 1 and parts[1].isdigit():
                        row["http_status"] = int(parts[1])
                    row["http_content_type"], row["http_headers"] = http.get("content-type"), list(http.items())
                if not all(_TESTS[type(f)](row[f.attribute[0]], f) for f in self.on_http):
                    self._skip(stream, left)
                    continue
                if self.payload:
                    body = stream.read(left)
                    if len(body) < left and self.failfast:
                        raise ValueError(f"{uri}: the last record is cut off")
                    row["payload"] = _decoded(body, http)
                else:
                    self._skip(stream, left)
                yield row

    @staticmethod
    def _skip(stream: io.BufferedReader, length: int) -> None:
        while length > 0 and (got := len(stream.read(min(length, 1 << 20)))):
            length -= got


class WarcDataSource(ds.DataSource):
    """``spark.read.format("warc").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:  # noqa: ANN001
        return WarcReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filter push-down into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def _record(kind: str, identity: str, uri: str | None, content_type: str, body: bytes) -> bytes:
    target = f"WARC-Target-URI: {uri}\r\n" if uri is not None else ""
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {identity}\r\n{target}WARC-Date: 2026-01-01T00:00:00Z\r\nContent-Type: {content_type}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def write_pages(pages: DataFrame, folder: str) -> int:
    """Write (page_id, url, html) as gzipped WARC files, one for each partition, and return the number of responses.

    Each page makes a request and a response record. A null URL gives records without a target; a null page an empty
    payload; rows with a null id are not written; rows that repeat an id are written each; an empty table gives files without
    pages; other columns are ignored. A file appears whole or not at all, also if its task is repeated.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        part = f"{path}/.{uuid.uuid4().hex}"
        n = 0
        with system.open_output_stream(part, compression=None) as out:
            out.write(gzip.compress(_record("warcinfo", "<urn:info>", None, "application/warc-fields", b"software: writer\r\n"), 1))
            for b in batches:
                for i, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    body = (html or "").encode()
                    get = f"GET {url} HTTP/1.1\r\n\r\n".encode()
                    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                    out.write(gzip.compress(_record("request", f"<urn:request:{i}>", url, "application/http; msgtype=request", get), 1))
                    out.write(gzip.compress(_record("response", f"<urn:page:{i}>", url, "application/http; msgtype=response", answer), 1))
                    n += 1
        system.move(part, f"{path}/part-{TaskContext.get().partitionId():06d}.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return pages.where("page_id is not null").select("page_id", "url", "html").mapInArrow(one, "n bigint").agg(F.sum("n")).first()[0] or 0


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, html) of the successful HTML responses in a folder that :func:`write_pages` wrote."""
    register(spark)
    records = spark.read.format("warc").load(folder)
    wanted = records.where("warc_type = 'response' and http_status = 200 and http_content_type like 'text/html%'")
    return wanted.select(F.regexp_extract("record_id", r"<urn:page:(-?\d+)>", 1).cast("bigint").alias("page_id"), F.col("target_uri").alias("url"), F.col("payload").cast("string").alias("html"))


ORACLE = "SELECT page_id, url, html FROM pages"
