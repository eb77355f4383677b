"""Column profiles: SQL types, coverage, distinct and modal values, entropy, key candidates, and DDL from these.

One aggregation gives the moments of all columns, one two-level aggregation over the unpivoted values the distinct and modal
counts and the entropy; both combine on the map side. What comes to the driver is one row for each column.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (("TINYINT", 1), ("SMALLINT", 2), ("MEDIUMINT", 3), ("INT", 4), ("BIGINT", 8))
SCHEMA = (
    "column string, Type string, min string, max string, mean double, std double, top string, uniq bigint, uniq_ratio double, freq double, "
    "Coverage double, Null_ratio double, entr double, is_key boolean, Failed boolean, Example string"
)


@dataclass(frozen=True)
class Limits:
    ratio: float = 1.5
    min_year: int = 1900
    max_year: int = 2100
    unique: float = 0.5
    frequent: float = 1e-3
    coverage: float = 0.999


def next_power_of_2(n: int) -> int:
    return 1 << max(0, n - 1).bit_length() if n > 0 else 0


def text_type(longest: int, ratio: float = 1.5) -> str:
    """VARCHAR up to 64 characters, then TEXT, MEDIUMTEXT and LONGTEXT; Unknown where nothing is known."""
    room = int(longest * ratio)
    if room < 1:
        return "Unknown"
    if (size := next_power_of_2(room)) <= 64:
        return f"VARCHAR({size})"
    return "TEXT" if room <= 0xFFFF else "MEDIUMTEXT" if room <= 0xFFFFFF else "LONGTEXT"


def whole_type(least: int, most: int, limits: Limits = Limits(), compat: bool = False) -> str:
    """The smallest integer type with room to grow; YEAR and BOOLEAN for values that look like these.

    With ``compat`` only the maximum is tested, so that a large negative value may not fit.
    """
    if limits.min_year < least and most < limits.max_year:
        return "YEAR"
    if (least, most) == (0, 1):
        return "BOOLEAN"
    reach = most if compat else max(most, -least)
    for name, size in INTEGERS:
        top = 2 ** (8 * size - 1) - 1
        if least >= 0:
            if 2 * top > most * limits.ratio:
                return f"{name} UNSIGNED"
        elif top > reach * limits.ratio:
            return name
    return "BIGINT UNSIGNED" if least >= 0 else "BIGINT"


def infer_type(kind: T.DataType, stats: Mapping[str, Any], limits: Limits = Limits(), compat: bool = False) -> str:
    """SQL type of a column from its aggregates (n, low, high, longest, whole, single)."""
    if not stats["n"]:
        return "BOOLEAN" if compat and isinstance(kind, T.DoubleType | T.FloatType) else "Unknown"
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "DATETIME"
    if isinstance(kind, T.BooleanType):
        return "BOOLEAN"
    if isinstance(kind, T.NumericType):
        if stats["whole"]:
            return whole_type(int(stats["low"]), int(stats["high"]), limits, compat)
        return "DATETIME" if compat else "FLOAT" if stats["single"] else "DOUBLE"
    return text_type(stats["longest"] or 0, limits.ratio)


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def aggregate_columns(df: DataFrame) -> dict[str, dict[str, Any]]:
    """Moments of every column in one pass."""
    out = []
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        text = c.cast("string") if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) else F.to_json(c)
        parts = {"n": F.count(c)}
        if _numeric(f.dataType):
            v = c.cast("double")
            parts |= {"low": F.min(c), "high": F.max(c), "mean": F.avg(v), "std": F.stddev_samp(v), "whole": F.bool_and(v % 1 == 0), "single": F.bool_and(v.cast("float").cast("double") == v)}
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType | T.DateType):
            parts |= {"low": F.min(c), "high": F.max(c)}
        else:
            parts |= {"shortest": F.min(F.length(text)), "longest": F.max(F.length(text))}
        parts["example"] = F.min(text)
        out += [e.alias(f"{i}:{k}") for k, e in parts.items()]
    row = df.agg(F.count("*").alias("rows"), *out).first().asDict()
    names = ("n", "low", "high", "mean", "std", "whole", "single", "shortest", "longest", "example")
    return {f.name: {"rows": row["rows"], **{k: row.get(f"{i}:{k}") for k in names}} for i, f in enumerate(df.schema)}


def value_counts(df: DataFrame) -> DataFrame:
    """(column, value, n) for every different value; NULL is a value of its own."""
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), (F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) else F.col(f"`{f.name}`").cast("string")).alias("value")) for f in df.schema])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def spread(df: DataFrame) -> DataFrame:
    """(column, uniq, top_n, top, entr): entropy in bits over values other than NULL, -1 and the empty text."""
    counted = value_counts(df)
    real = F.col("value").isNotNull() & ~F.col("value").isin("", "-1", "-1.0")
    n = F.when(real, F.col("n").cast("double"))
    return counted.groupBy("column").agg(
        F.count("*").alias("uniq"), F.max("n").alias("top_n"), F.max_by("value", F.struct(F.col("n"), F.col("value"))).alias("top"),
        (F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entr"),
    )


def profile(df: DataFrame, keys: Iterable[str] = (), limits: Limits = Limits(), keep_datetime: bool = True, key_sep: str = "__", compat: bool = False) -> DataFrame:
    """One row for each column. ``keys`` are keys whatever their values; without ``keep_datetime`` dates become VARCHAR(64)."""
    forced = set(keys)
    stats = aggregate_columns(df)
    spreads = {r["column"]: r for r in spread(df).collect()}
    rows = []
    for f in df.schema:
        s, d = stats[f.name], spreads.get(f.name)
        n = s["rows"]
        kind = infer_type(f.dataType, s, limits, compat)
        text = s["longest"] is not None
        uniq, freq = (d.uniq, d.top_n / n) if d and n else (0, None)
        coverage = s["n"] / n if n else None
        is_key = bool(n and coverage > limits.coverage and uniq / n > limits.unique and freq < limits.frequent and kind != "TEXT")
        if kind == "DATETIME" and not keep_datetime:
            kind = "VARCHAR(64)"
        low, high = (s["shortest"], s["longest"]) if text else (s["low"], s["high"])
        rows.append(
            (
                f.name.replace(".", key_sep), kind, None if low is None else str(low), None if high is None else str(high), s["mean"], s["std"], d.top if d else None, uniq, uniq / n if n else None, freq,
                coverage, 1 - coverage if n else None, d.entr if d else None, is_key or f.name in forced, kind == "Unknown", s["example"],
            )
        )
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def fit_row_size(types: Mapping[str, str], limit: int = 8000) -> dict[str, str]:
    """Long VARCHARs become TEXT where the row would be larger than the limit (3 bytes a character)."""
    size = {c: int(t[8:-1]) for c, t in types.items() if t.startswith("VARCHAR(")}
    if sum(size.values()) * 3 <= limit:
        return dict(types)
    return {c: "TEXT" if size.get(c, 0) > 255 else t for c, t in types.items()}


def create_table(table: str, rows: Iterable[Mapping[str, Any]], forced_null: bool = False) -> str:
    """CREATE TABLE from profile rows; columns of unknown type are left out."""
    rows = [r for r in rows if r["Type"] not in (None, "", "Unknown")]
    types = fit_row_size({r["column"]: r["Type"] for r in rows})
    lines = [f"  `{r['column']}` {types[r['column']]}{'' if forced_null or r['Null_ratio'] else ' NOT NULL'}" for r in rows]
    return f"CREATE TABLE `{table}` (\n" + ",\n".join(lines) + "\n)"


def spark_type(sql_type: str) -> T.DataType:
    """The Spark type that holds a SQL type's values."""
    base, unsigned = sql_type.split("(")[0].split(" ")[0], sql_type.endswith("UNSIGNED")
    order = [T.ByteType(), T.ShortType(), T.IntegerType(), T.IntegerType(), T.LongType(), T.DecimalType(20, 0)]
    for i, (name, _) in enumerate(INTEGERS):
        if base == name:
            return order[i + (unsigned and i != 2)]
    return {"YEAR": T.ShortType(), "BOOLEAN": T.BooleanType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "DATETIME": T.TimestampType()}.get(base, T.StringType())


def entropy_of(counts: Iterable[int]) -> float | None:
    """Entropy in bits of counts on the driver."""
    counts = [c for c in counts if c]
    total = sum(counts)
    return -sum(c / total * math.log2(c / total) for c in counts) if total else None
