"""Run reports and quarantine logs: what is counted and timed, what failed, and summaries and differences of both."""

from __future__ import annotations

import json
import time
import traceback
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shredloom.functions.scalars import plain

ENTRY = "timestamp string, stage string, index string, record string, context string, exception_type string, exception_message string"


def _now() -> str:
    return datetime.now(UTC).isoformat()


@dataclass
class RunReport:
    """Counters, timings, artifacts and issues of a run."""

    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    started_at: str = field(default_factory=_now)
    finished_at: str | None = None
    duration_s: float | None = None
    stats: dict[str, int] = field(default_factory=dict)
    timings_ms: dict[str, int] = field(default_factory=dict)
    artifacts: dict[str, Any] = field(default_factory=dict)
    issues: list[dict[str, Any]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._began = time.monotonic()

    def bump(self, name: str, by: int = 1) -> None:
        self.stats[name] = self.stats.get(name, 0) + by

    def add_time(self, name: str, ms: float) -> None:
        self.timings_ms[name] = self.timings_ms.get(name, 0) + round(ms)

    @contextmanager
    def timer(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self.add_time(name, 1000 * (time.monotonic() - began))

    def set_artifact(self, name: str, value: Any) -> None:
        self.artifacts[name] = plain(value)

    def issue(self, level: str, stage: str, message: str, **context: Any) -> None:
        self.issues.append({"level": level, "stage": stage, "message": message, "timestamp": _now(), "context": plain(context)})

    def warn(self, stage: str, message: str, **context: Any) -> None:
        self.issue("warning", stage, message, **context)

    def error(self, stage: str, message: str, **context: Any) -> None:
        self.issue("error", stage, message, **context)

    def exception(self, stage: str, error: BaseException, **context: Any) -> None:
        self.issue("error", stage, str(error), **context)
        self.issues[-1] |= {"exception_type": type(error).__name__, "exception_message": str(error), "traceback": "".join(traceback.format_exception(error))[-4000:]}

    def finish(self) -> RunReport:
        self.finished_at, self.duration_s = _now(), round(time.monotonic() - self._began, 6)
        return self

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def save(self, path: str) -> None:
        """Written aside and renamed, so that a reader never sees half of it."""
        target = Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_suffix(target.suffix + ".part")
        part.write_text(json.dumps(self.to_dict(), ensure_ascii=False, indent=2), encoding="utf-8")
        part.replace(target)


def throughput(stats: Mapping[str, int], timings_ms: Mapping[str, int], total: str = "pipeline.json.total") -> dict[str, float]:
    """Records, rows, files and megabytes for each second of the total time."""
    seconds = (timings_ms.get(total) or 0) / 1000
    pairs = {"records_per_s": stats.get("records_read", 0), "rows_per_s": stats.get("rows_emitted", 0), "files_per_s": stats.get("sources", 0), "mb_per_s": stats.get("bytes_read", 0) / 1e6}
    return {k: round(v / seconds, 3) for k, v in pairs.items()} if seconds > 0 else {}


def reject_rows(rejects: DataFrame) -> DataFrame:
    """Quarantine entries for rejected lines."""
    context = F.to_json(F.struct("source_path", "source_member", "line_no"))
    return rejects.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "stage", F.col("line_no").alias("index"), F.col("raw").alias("record"), context.alias("context"), F.lit("ValueError").alias("exception_type"), F.col("message").alias("exception_message"))


def write_quarantine(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def parse_quarantine(lines: DataFrame) -> DataFrame:
    """Entries of a log read as text (column ``value``); ``ok`` is false for a line that isn't JSON. Blank lines are skipped."""
    shown = lines.where("trim(value) <> ''")
    good = F.try_parse_json("value").isNotNull()
    e = shown.select(good.alias("ok"), F.from_json(F.when(good, F.col("value")), ENTRY).alias("e")).select("ok", "e.*")
    return e.withColumns({"stage": F.when(F.col("ok"), F.coalesce("stage", F.lit("(unknown)"))), "exception_type": F.when(F.col("ok"), F.coalesce(F.nullif("exception_type", F.lit("")), F.lit("(none)")))})


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return parse_quarantine(spark.read.text(path))


def quarantine_counts(entries: DataFrame, n: int = 50) -> DataFrame:
    """(kind, key, n): the most frequent stages, exceptions and pairs of both, ties by name; one pass over the log."""
    keys = F.array(
        F.struct(F.lit("stage").alias("kind"), F.col("stage").alias("key")), F.struct(F.lit("exception_type").alias("kind"), F.col("exception_type").alias("key")),
        F.struct(F.lit("stage_exception").alias("kind"), F.concat("stage", F.lit("::"), "exception_type").alias("key")),
    )
    counts = entries.where("ok").select(F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(F.count("*").alias("n"))
    return counts.withColumn("__r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "key"))).where(F.col("__r") <= n).drop("__r")


def quarantine_samples(entries: DataFrame, k: int = 3) -> DataFrame:
    """The first k entries of every stage by time and number."""
    order = Window.partitionBy("stage").orderBy("timestamp", F.col("index").cast("bigint"), "record")
    return entries.where("ok").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")


def quarantine_span(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count(F.when(F.col("ok"), 1)).alias("total_entries"), F.count(F.when(~F.col("ok"), 1)).alias("parse_errors"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))


def quarantine_by_table(entries: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """(table, n): entries by the table that their context or record names, under its SQL name."""
    found = F.coalesce(F.get_json_object("context", "$.table_sql"), F.get_json_object("context", "$.table"), F.get_json_object("record", "$.table"), F.lit("(unknown)"))
    for original, sql in (names or {}).items():
        found = F.when(found == original, sql).otherwise(found)
    return entries.where("ok").groupBy(found.alias("table")).agg(F.count("*").alias("n"))


def quarantine_report(spark: SparkSession, path: str, folder: str) -> dict[str, Any]:
    """Summary of a log, written as JSON, Markdown and HTML."""
    entries = read_quarantine(spark, path)
    top: dict[str, list] = {}
    for r in quarantine_counts(entries).orderBy("kind", F.desc("n"), "key").collect():
        top.setdefault(r.kind, []).append([r.key, r.n])
    summary = {**quarantine_span(entries).first().asDict(), "top": top, "samples": [r.asDict() for r in quarantine_samples(entries).drop("ok").collect()]}
    text = "\n".join(["# Quarantine", "", f"Entries: {summary['total_entries']}", f"Lines that don't parse: {summary['parse_errors']}", "", *(line for kind, rows in top.items() for line in [f"## {kind}", "", *(f"- {k}: {n}" for k, n in rows), ""])])
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "quarantine.json").write_text(json.dumps(summary, ensure_ascii=False, indent=2), encoding="utf-8")
    (out / "quarantine.md").write_text(text, encoding="utf-8")
    (out / "quarantine.html").write_text(f"<!DOCTYPE html><meta charset='utf-8'><pre>{text.replace('&', '&amp;').replace('<', '&lt;')}</pre>", encoding="utf-8")
    return summary


def issue_counts(issues: DataFrame) -> DataFrame:
    """(table, error, warning, info, total)."""
    return issues.groupBy("table").agg(*[F.count(F.when(F.col("level") == x, 1)).alias(x) for x in ("error", "warning", "info")], F.count("*").alias("total"))


def diff_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, before, after, delta) over the keys of two tables (key, value); a missing one counts 0."""
    joined = before.select("key", F.col("value").alias("__b")).join(after.select("key", F.col("value").alias("__a")), "key", "full")
    b, a = F.coalesce("__b", F.lit(0)), F.coalesce("__a", F.lit(0))
    return joined.select("key", b.alias("before"), a.alias("after"), (a - b).alias("delta"))


def diff_reports(before: Mapping[str, Any], after: Mapping[str, Any]) -> dict[str, dict[str, tuple[float, float, float]]]:
    """Stats, timings and issues by stage of two run reports as (before, after, delta)."""

    def pairs(a: Mapping[str, float], b: Mapping[str, float]) -> dict[str, tuple[float, float, float]]:
        return {k: (a.get(k, 0), b.get(k, 0), b.get(k, 0) - a.get(k, 0)) for k in sorted({*a, *b})}

    def stages(r: Mapping[str, Any]) -> dict[str, int]:
        out: dict[str, int] = {}
        for i in r.get("issues", []):
            out[i["stage"]] = out.get(i["stage"], 0) + 1
        return out

    return {"stats": pairs(before.get("stats", {}), after.get("stats", {})), "timings_ms": pairs(before.get("timings_ms", {}), after.get("timings_ms", {})), "issues": pairs(stages(before), stages(after))}


def diff_report_markdown(diff: Mapping[str, Mapping[str, tuple]]) -> str:
    lines = ["# Run differences", ""]
    for part, rows in diff.items():
        lines += [f"## {part}", "", "| key | before | after | delta |", "| --- | ---: | ---: | ---: |", *(f"| {k} | {b} | {a} | {d:+} |" for k, (b, a, d) in rows.items()), ""]
    return "\n".join(lines)


def total_ms(timings: Mapping[str, float], duration_s: float = 0) -> float:
    """The run's time: of the pipeline, else its duration, else the sum of what was timed."""
    for name in ("pipeline.json.total", "pipeline.tabular.total"):
        if timings.get(name, 0) > 0:
            return timings[name]
    return 1000 * duration_s if duration_s > 0 else sum(v for v in timings.values() if v > 0)


def bottleneck(timings: Mapping[str, float], duration_s: float = 0) -> tuple[str, dict[str, float]]:
    """(what a run's time is bound by, shares of the total in percent)."""
    whole = total_ms(timings, duration_s)
    share = lambda *names: 100 * sum(max(0, timings.get(n, 0)) for n in names) / whole if whole > 0 else 0.0
    shares = {
        "load": share("json.db.load", "tabular.db.load"), "alter": share("db.alter"), "to_sql": share("db.to_sql"), "tsv": share("db.load_data.tsv_write"), "flatten": share("json.flatten"), "parse": share("io.json_parse"),
        "finalize": share("json.db.index", "tabular.db.index", "json.db.optimize", "tabular.db.optimize"),
    }
    if shares["load"] >= 55:
        return ("db-load-bound-drift-ddl" if shares["alter"] >= 5 else "db-load-bound"), shares
    for name, least in (("flatten", 50), ("parse", 35), ("finalize", 35)):
        if shares[name] >= least:
            return f"{name}-bound", shares
    return "mixed", shares


def top_timings(timings: Mapping[str, int], n: int = 8) -> list[tuple[str, int]]:
    return sorted(((k, v) for k, v in timings.items() if v > 0), key=lambda x: -x[1])[:n]
