"""Command line: version, modes, naming, run reports, tabular and JSON runs, reviews and quarantine summaries."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from shredloom import __version__
from shredloom.config import PRESETS, conflicts, with_mode
from shredloom.naming import index_identifier, table_identifier


def _json(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8")) if path else {}


def run_json(args: argparse.Namespace) -> int:
    """Read, shred and write Parquet tables; saves a run report beside them."""
    from shredloom import run
    from shredloom.session import local_session

    given = {"index_key": args.index_key, "max_records": args.max_records, "except_keys": args.except_key, "file_names": args.input or None, "out_path": args.out}
    config = _json(args.config)
    options, _ = with_mode(config, args.mode, **given)
    if problems := conflicts(options):
        print("\n".join(problems), file=sys.stderr)
        return 2
    spark = local_session(args.cores)
    report = run.run_json(spark, config, args.mode, dry_run=args.dry_run, **given)
    if args.dry_run:
        print(json.dumps(report.artifacts["columns"], indent=2))
    else:
        report.save(f"{options.out_path or 'runs/' + (options.table_name or 'base') + '_' + report.run_id}/report.json")
    spark.stop()
    return 0


def run_tabular(args: argparse.Namespace) -> int:
    """Profile a file, print its DDL, and write it as Parquet."""
    from shredloom import run
    from shredloom.session import local_session

    spark = local_session(args.cores)
    print(run.run_tabular(spark, args.input, _json(args.config), args.out)[0])
    spark.stop()
    return 0


def review_pack(args: argparse.Namespace) -> int:
    from shredloom.operators.review import write_pack
    from shredloom.session import local_session

    spark = local_session(args.cores)
    tables = {p.name: spark.read.option("recursiveFileLookup", "true").parquet(str(p)) for p in sorted(Path(args.folder).iterdir()) if p.is_dir()}
    print("\n".join(write_pack(args.out, args.base, tables)))
    spark.stop()
    return 0


def quarantine(args: argparse.Namespace) -> int:
    from shredloom.operators.reports import quarantine_report
    from shredloom.session import local_session

    spark = local_session(args.cores)
    summary = quarantine_report(spark, args.input, args.out)
    print(json.dumps({k: summary[k] for k in ("total_entries", "parse_errors")}))
    spark.stop()
    return 0


def report(args: argparse.Namespace) -> int:
    from shredloom.operators.reports import bottleneck, diff_report_markdown, diff_reports, top_timings

    a = _json(args.before)
    if args.after:
        print(diff_report_markdown(diff_reports(a, _json(args.after))))
    else:
        kind, shares = bottleneck(a.get("timings_ms", {}), a.get("duration_s") or 0)
        print(json.dumps({"bottleneck": kind, "shares": shares, "top": top_timings(a.get("timings_ms", {})), "stats": a.get("stats", {})}, indent=2))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shredloom")
    p.add_argument("--cores", default="*")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version").set_defaults(run=lambda a: print(__version__) or 0)
    sub.add_parser("modes").set_defaults(run=lambda a: print("\n".join(f"{m}: {', '.join(s)}" for m, (s, _) in PRESETS.items())) or 0)
    n = sub.add_parser("table-name")
    n.add_argument("name")
    n.set_defaults(run=lambda a: print(table_identifier(a.name)) or 0)
    n = sub.add_parser("index-name")
    n.add_argument("table")
    n.add_argument("column")
    n.set_defaults(run=lambda a: print(index_identifier(a.table, a.column)) or 0)
    j = sub.add_parser("json")
    j.add_argument("input", nargs="*")
    j.add_argument("--config", default="")
    j.add_argument("--mode")
    j.add_argument("--out")
    j.add_argument("--index-key")
    j.add_argument("--except-key", action="append", type=str)
    j.add_argument("--max-records", type=int)
    j.add_argument("--dry-run", action="store_true")
    j.set_defaults(run=run_json)
    t = sub.add_parser("tabular")
    t.add_argument("input")
    t.add_argument("--config", default="")
    t.add_argument("--out")
    t.set_defaults(run=run_tabular)
    r = sub.add_parser("report")
    r.add_argument("before")
    r.add_argument("after", nargs="?")
    r.set_defaults(run=report)
    v = sub.add_parser("review")
    v.add_argument("folder")
    v.add_argument("base")
    v.add_argument("out")
    v.set_defaults(run=review_pack)
    q = sub.add_parser("quarantine")
    q.add_argument("input")
    q.add_argument("out")
    q.set_defaults(run=quarantine)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except ModuleNotFoundError as e:
        print(f"missing dependency: {e.name}; install it and try again", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
