"""Whole runs as functions: read, shape, write, report. The command line is a thin layer over them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from shredloom.config import Options, conflicts, for_file, with_mode
from shredloom.naming import table_identifier
from shredloom.operators.drift import DriftState
from shredloom.operators.profile import create_table, profile
from shredloom.operators.reports import RunReport, reject_rows, throughput, write_quarantine
from shredloom.operators.shred import shred
from shredloom.operators.sinks import write_parquet, write_tsv
from shredloom.operators.structure import auto_except, dict_path_stats
from shredloom.sources.records import read_raw, resume_after
from shredloom.sources.tabular import read_table

Extract = Callable[[DataFrame, Options], Mapping[str, DataFrame]]


def detected_branches(records: DataFrame, options: Options) -> list[str]:
    """Paths of the first ``auto_except_sample_records`` records that are used as maps, without those below another one."""
    sample = records.where(records["record_index"] < options.auto_except_sample_records)
    stats = dict_path_stats(sample, options.KEY_SEP)
    found = sorted(r.path for r in auto_except(stats, options.auto_except_min_observations, options.auto_except_unique_keys, options.auto_except_novelty).collect())
    return [p for p in found if not any(p.startswith(q + options.KEY_SEP) for q in found)]


def run_json(spark: SparkSession, config: Mapping[str, Any] | Options, mode: str | None = None, extract: Extract | None = None, dry_run: bool = False, **cli: Any) -> RunReport:
    """Read JSON sources, shred them, and write their tables as Parquet (and TSV) below ``out_path``.

    ``extract(records, options)`` may replace the shredding: it returns tables by name. Records after ``resume_cursor`` of the
    config are taken if there is one; with ``auto_except`` branches used as maps are kept apart; ``schema_mode`` freeze packs
    columns that a former run into the same folder didn't have into ``extra_column_name``. Input is shredded once: counts are
    taken from what was written. Raises ValueError for options that exclude each other.
    """
    options, stages = with_mode(config.to_dict() if isinstance(config, Options) else config, mode, **cli)
    if problems := conflicts(options):
        raise ValueError("; ".join(problems))
    report = RunReport()
    base = options.table_name or "base"
    out = options.out_path or f"runs/{base}_{report.run_id}"
    with report.timer("pipeline.json.total"):
        raw = read_raw(spark, options, sampled=options.sample_max_sources is not None)
        records = resume_after(raw.records, options.extra.get("resume_cursor"), int(options.extra.get("resume_backtrack_lines") or 0))
        excepted = list(options.except_keys)
        if options.auto_except:
            with report.timer("json.auto_except"):
                excepted += [p for p in detected_branches(records, options) if p not in excepted]
        report.set_artifact("except_keys", excepted)
        with report.timer("json.flatten"):
            if extract is None:
                shredded = shred(records, options.index_key, excepted, options.KEY_SEP, expand=options.excepted_expand_dict, compat=options.compat)
                tables = shredded.tables(base)
                for w in shredded.plan.warnings:
                    report.warn("json.flatten", w)
            else:
                tables = dict(extract(records, options))
        if options.schema_mode == "freeze" and options.extra.get("schema_state"):
            state = DriftState.from_dict(options.extra["schema_state"])
            state.start_batch()
            tables = {t: state.admit(t, df) for t, df in tables.items()}
        report.set_artifact("columns", {t: df.columns for t, df in tables.items()})
        report.bump("tables_total", len(tables))
        if dry_run or not (stages["load"] or options.persist_parquet_files):
            return report.finish()
        with report.timer("io.parquet"):
            paths = write_parquet(tables, f"{out}/parquet", workers=max(1, options.db_load_parallel_tables or 4))
        report.set_artifact("paths", paths)
        written = {t: spark.read.parquet(p) for t, p in zip(tables, paths)}
        for t, df in written.items():
            n = df.count()
            report.bump("rows_emitted", n)
            if t == base:
                report.bump("records_read", n)
        if options.persist_tsv_files:
            with report.timer("io.tsv"):
                for t, df in written.items():
                    write_tsv(df, f"{out}/tsv/{t}")
                    report.bump("tsv_files_persisted")
        write_quarantine(reject_rows(raw.rejects), f"{out}/quarantine")
    report.set_artifact("throughput", throughput(report.stats, report.timings_ms))
    return report.finish()


def run_tabular(spark: SparkSession, path: str, config: Mapping[str, Any] | Options | None = None, out: str | None = None) -> tuple[str, DataFrame]:
    """(DDL of the profiled file, its rows); with ``out`` these are written as Parquet."""
    options = for_file(path, Options.of(config))
    df = read_table(spark, options)
    ddl = create_table(table_identifier(options.table_name), [r.asDict() for r in profile(df, options.KEYs).collect()])
    if out:
        df.write.mode("overwrite").parquet(out)
    return ddl, df
