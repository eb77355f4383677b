"""Scalar functions as Column expressions, and the small helpers that run on the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HTML_TAGS = ("p", "sub", "sup", "i", "b")


def identifier(c: Column) -> Column:
    """Runs of other characters than ASCII letters and digits become one ``_``; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, "[^0-9A-Za-z]+", "_"), "^_|_$", "")


def nan_to_null(c: Column) -> Column:
    """NULL for texts that only say nan, whatever case and spaces."""
    return F.when(~F.coalesce(c.rlike(r"(?i)^\s*nan\s*$"), F.lit(False)), c)


def sanitise_nan(df: DataFrame, floats: bool = True) -> DataFrame:
    """:func:`nan_to_null` on all string columns, and with ``floats`` NaN to NULL on the floating ones."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = nan_to_null(c)
        elif floats and isinstance(f.dataType, T.FloatType | T.DoubleType):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def iso_datetime(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, or NULL where the value is no date."""
    return F.date_format(F.try_to_timestamp(c.cast("string")), "yyyy-MM-dd HH:mm:ss")


def nullish(c: Column, floating: bool = False) -> Column:
    return c.isNull() | F.isnan(c) if floating else c.isNull()


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text: nested ones and VARIANT as JSON, bytes as UTF-8, others by cast."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.VariantType)
        c = F.to_json(c) if nested else F.decode(c, "UTF-8") if isinstance(f.dataType, T.BinaryType) else c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def escape_field(c: Column) -> Column:
    """A field of a tab-separated load file: backslash escapes, and ``\\N`` for NULL."""
    for raw, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"), ("\x1a", "\\Z")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return F.coalesce(c, F.lit("\\N"))


def shield_html(c: Column) -> Column:
    """Inline HTML tags written so that an XML parser takes them for text: ``<p>`` becomes ``%_lt_;p%_gt_;``."""
    for tag in _HTML_TAGS:
        c = F.regexp_replace(c, rf"<(/?){tag}>", rf"%_lt_;$1{tag}%_gt_;")
    return c


def unshield_html(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%_lt_;"), F.lit("<")), F.lit("%_gt_;"), F.lit(">"))


def clip(c: Column, limit: int = 160) -> Column:
    """At most ``limit`` characters, the last an ellipsis where something is missing."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^0-9A-Za-z._-]+", "_"), "^_+|_+$", "")


def path_depth(c: Column, sep: str = "__") -> Column:
    """0 for the root, else the number of parts."""
    return F.when(c == "root", F.lit(0)).otherwise(F.size(F.split(c, re.escape(sep))))


def column_role(table: Column, column: Column, base: str, key: str = "id") -> Column:
    """PK for the key of the base table, FK for that of others and for ``*_id``, else empty."""
    return F.when(column == key, F.when(table == base, "PK").otherwise("FK")).when(column.endswith("_id"), "FK").otherwise("")


def human_int(n: int | None) -> str:
    return "-" if n is None else f"{n:,}"


def human_bytes(n: float | None) -> str:
    if n is None:
        return "-"
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if abs(n) < 1024 or unit == "TB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return ""


def plain(value: Any, items: int = 50, chars: int = 500) -> Any:
    """A value that JSON can hold, with long texts and collections cut."""
    if isinstance(value, Mapping):
        return {str(k): plain(v, items, chars) for k, v in list(value.items())[:items]}
    if isinstance(value, list | tuple | set):
        return [plain(v, items, chars) for v in list(value)[:items]]
    if isinstance(value, str):
        return value if len(value) <= chars else value[: chars - 1] + "…"
    return value if value is None or isinstance(value, bool | int | float) else str(value)


def dump_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)


def quote_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_value(value: Any) -> str:
    return "NULL" if value is None else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
