"""Reviews of table families: relations by name, row counts, differences between snapshots, and diagrams."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shredloom.functions.scalars import clip, human_int


def _suffix(base: str, name: str, sep: str) -> tuple[str, str] | None:
    """(prefix, rest) of a table below ``base``; also with the older marks -SUB and _SUB."""
    for mark in ("", "-SUB", "_SUB"):
        prefix = base + mark + sep
        if name.startswith(prefix):
            return prefix, name[len(prefix) :]
    return None


def table_edges(base: str, tables: Iterable[str], sep: str = "__") -> list[tuple[str, str, str]]:
    """(parent, child, label): every table below the base under its nearest ancestor that is a table."""
    known = {str(t) for t in tables if str(t)} | {base}
    edges = []
    for child in sorted(known - {base}):
        split = _suffix(base, child, sep)
        if split is None:
            continue
        prefix, rest = split
        parts = [p for p in rest.split(sep) if p]
        cuts = (i for i in range(len(parts) - 1, 0, -1) if prefix + sep.join(parts[:i]) in known)
        cut = next(cuts, 0)
        edges.append((prefix + sep.join(parts[:cut]) if cut else base, child, sep.join(parts[cut:]) or rest))
    return edges


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, n): all counts in one job."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def depth_groups(counts: DataFrame, base: str, sep: str = "__") -> DataFrame:
    """(depth, tables, n): the base has depth 0."""
    rest = F.substring(F.col("table"), len(base) + len(sep) + 1, 10_000)
    depth = F.when(F.col("table") == base, 0).otherwise(F.size(F.split(rest, sep)))
    return counts.groupBy(depth.alias("depth")).agg(F.count("*").alias("tables"), F.sum("n").alias("n"))


def totals(counts: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables, rows and columns in all."""
    return counts.agg(F.count("*").alias("tables"), F.sum("n").alias("rows")).crossJoin(columns.agg(F.count("*").alias("columns")))


def diff_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table, column, change) between two snapshots (table, column, type)."""
    tables = before.select("table").distinct().withColumn("b", F.lit(1)).join(after.select("table").distinct().withColumn("a", F.lit(1)), "table", "full")
    whole = tables.where("a is null or b is null").select("table", F.lit(None).cast("string").alias("column"), F.when(F.col("a").isNull(), "table_removed").otherwise("table_added").alias("change"))
    both = tables.where("a is not null and b is not null").select("table")
    columns = before.withColumnRenamed("type", "old").join(after.withColumnRenamed("type", "new"), ["table", "column"], "full").join(both, "table", "left_semi")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "type_changed")
    return whole.unionByName(columns.select("table", "column", change.alias("change")).where("change is not null"))


def diff_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table, rows_before, rows_after, delta) for tables of both snapshots whose number of rows changed."""
    joined = before.select("table", F.col("n").alias("rows_before")).join(after.select("table", F.col("n").alias("rows_after")), "table")
    return joined.withColumn("delta", F.col("rows_after") - F.col("rows_before")).where("delta <> 0")


def snapshot(base: str, tables: Mapping[str, DataFrame], counts: bool = True) -> dict[str, Any]:
    """A review document: every table with its columns, types and rows."""
    n = {r.table: r.n for r in row_counts(tables).collect()} if counts and tables else {}
    return {"base_table": base, "tables": [{"name_sql": t, "columns": [{"name": c, "column_type": k} for c, k in df.dtypes], "indexes": [], "rows": n.get(t)} for t, df in tables.items()]}


def diff_snapshots(spark: SparkSession, before: Mapping[str, Any], after: Mapping[str, Any]) -> dict[str, Any]:
    """Tables and columns that were added, removed or changed, index and row differences."""
    names = [{t["name_sql"]: t for t in doc.get("tables", [])} for doc in (before, after)]
    rows = [[(t, c["name"], c["column_type"]) for t, x in side.items() for c in x["columns"]] for side in names]
    kind = "table string, column string, type string"
    changed: dict[str, dict[str, Any]] = {}
    for r in diff_columns(*(spark.createDataFrame(x, kind) for x in rows)).where("column is not null").collect():
        changed.setdefault(r.table, {}).setdefault(f"cols_{r.change}", []).append(r.column)
    for t in names[0].keys() & names[1].keys():
        old, new = names[0][t], names[1][t]
        a, b = ({json.dumps(i, sort_keys=True) for i in x.get("indexes", [])} for x in (old, new))
        if a != b:
            changed.setdefault(t, {}).update(indexes_added=len(b - a), indexes_removed=len(a - b))
        if old.get("rows") is not None and new.get("rows") is not None and old["rows"] != new["rows"]:
            changed.setdefault(t, {}).update(rows_before=old["rows"], rows_after=new["rows"])
    return {
        "tables_added": sorted(names[1].keys() - names[0].keys()), "tables_removed": sorted(names[0].keys() - names[1].keys()),
        "tables_changed": {t: {k: sorted(v) if isinstance(v, list) else v for k, v in x.items()} for t, x in sorted(changed.items())},
    }


def diff_markdown(diff: Mapping[str, Any]) -> str:
    lines = ["# Schema differences", "", f"Added tables: {', '.join(diff['tables_added']) or '-'}", f"Removed tables: {', '.join(diff['tables_removed']) or '-'}", ""]
    for t, x in diff["tables_changed"].items():
        lines += [f"## {t}", *(f"- {k}: {', '.join(v) if isinstance(v, list) else v}" for k, v in x.items()), ""]
    return "\n".join(lines)


def label(base: str, table: str, sep: str = "__") -> str:
    """A table's name below the base, with slashes."""
    split = _suffix(base, table, sep)
    return split[1].replace(sep, "/") if split else table


def mermaid(base: str, tables: Mapping[str, Iterable[str]], sep: str = "__") -> str:
    """An entity diagram of the family."""
    word = lambda t: "".join(c if c.isalnum() or c == "_" else "_" for c in t)
    lines = ["erDiagram"]
    for t, columns in tables.items():
        lines += [f"  {word(t)} {{", *(f"    string {word(c)}" for c in columns), "  }"]
    lines += [f"  {word(p)} ||--o{{ {word(c)} : \"{name}\"" for p, c, name in table_edges(base, tables, sep)]
    return "\n".join(lines)


def svg(base: str, tables: Iterable[str], sep: str = "__") -> str:
    """A picture of the family: one box for each table, by depth, and 1:N lines."""
    edges = table_edges(base, tables, sep)
    depth = {base: 0}
    for parent, child, _ in sorted(edges, key=lambda e: e[1].count(sep)):
        depth[child] = depth.get(parent, 0) + 1
    slots: dict[int, int] = {}
    at = {}
    for t in sorted(depth, key=lambda t: (depth[t], t)):
        at[t] = (20 + 260 * depth[t], 20 + 60 * slots.get(depth[t], 0))
        slots[depth[t]] = slots.get(depth[t], 0) + 1
    parts = []
    for parent, child, _ in edges:
        (x, y), (u, v) = at[parent], at[child]
        parts.append(f'<line x1="{x + 220}" y1="{y + 20}" x2="{u}" y2="{v + 20}" stroke="#888"/><text x="{(x + 220 + u) // 2}" y="{(y + v) // 2 + 16}" font-size="10">1:N</text>')
    for t, (x, y) in at.items():
        shown = t if t == base else label(base, t, sep)
        parts.append(f'<rect x="{x}" y="{y}" width="220" height="40" fill="#fff" stroke="#333"/><text x="{x + 8}" y="{y + 24}" font-size="12">{html.escape(shown)}</text>')
    width, height = 300 + 260 * max(depth.values()), 40 + 60 * max(slots.values())
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif">{"".join(parts)}</svg>'


def join_sql(base: str, table: str, tables: Iterable[str], key: str = "id", sep: str = "__", limit: int = 5) -> str:
    """SQL that joins the base with every ancestor of a table and the table itself."""
    parent = {c: p for p, c, _ in table_edges(base, tables, sep)}
    chain = [table]
    while parent.get(chain[0], base) != base:
        chain.insert(0, parent[chain[0]])
    joins = " ".join(f"LEFT JOIN `{t}` AS t{i} ON t0.`{key}` = t{i}.`{key}`" for i, t in enumerate(chain, 1))
    return f"SELECT * FROM `{base}` AS t0 {joins} LIMIT {limit}"


def samples(df: DataFrame, n: int = 5) -> list[dict[str, Any]]:
    """The first rows with values cut to 160 characters."""
    return [r.asDict() for r in df.limit(n).select(*[clip(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns]).collect()]


def catalog_tables(spark: SparkSession, like: str = "") -> dict[str, DataFrame]:
    """Tables and views of the current database whose names begin so."""
    return {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.name.startswith(like)}


def write_pack(folder: str, base: str, tables: Mapping[str, DataFrame], sep: str = "__") -> list[str]:
    """Review files: JSON, Markdown, Mermaid, SVG and one static HTML page."""
    doc = snapshot(base, tables)
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    lines = [f"# {base}", ""]
    for t in doc["tables"]:
        lines += [f"## {t['name_sql']}", "", f"Rows: {human_int(t['rows'])}", "", *(f"- `{c['name']}` {c['column_type']}" for c in t["columns"]), ""]
    picture = svg(base, tables, sep)
    files = {
        "review.json": json.dumps(doc, ensure_ascii=False, indent=2), "review.md": "\n".join(lines), "schema.mmd": mermaid(base, {t: df.columns for t, df in tables.items()}, sep), "schema.svg": picture,
        "review.html": f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(base)}</title>{picture}<pre>{html.escape(chr(10).join(lines))}</pre>",
    }
    for name, text in files.items():
        (out / name).write_text(text, encoding="utf-8")
    return sorted(files)
