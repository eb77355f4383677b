"""Identifiers of at most 64 characters for tables, columns and indexes, stable across schema drift."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field
from hashlib import md5

LIMIT = 64


def sanitize(name: object, fill: str = "_") -> str:
    """Only ASCII letters, digits and single ``fill`` characters, none at the ends."""
    return fill.join(re.findall(r"[0-9A-Za-z]+", str(name or "")))


def _longest_tail(parts: list[str], glue: str, limit: int) -> str:
    """As many of the last parts as fit."""
    for i in range(len(parts)):
        if len(tail := glue.join(parts[i:])) <= limit:
            return tail
    return ""


def table_identifier(name: object, limit: int = LIMIT) -> str:
    """The longest tail of telling words (of two or more characters and no mere number) that fits."""
    text = str(name)
    if len(text) <= limit:
        return text
    telling = [w for w in text.split("_") if len(w) > 1 and not w.isdigit()]
    return _longest_tail(telling, "_", limit).rstrip("_") or text[:limit]


def _short(column: str, sep: str, limit: int) -> str:
    if len(column) <= limit:
        return column
    return (_longest_tail(column.split(sep), sep, limit) if sep in column else "") or column[:limit]


def _free(name: str, taken: set[str], count: int, limit: int) -> str:
    """``name``, or with the first of _1 to _999 that isn't taken; beyond these ``col_<count>``."""
    if name not in taken:
        return name
    for i in range(1, 1000):
        tail = f"_{i}"
        if (trial := name[: limit - len(tail)] + tail) not in taken:
            return trial
    return f"col_{count}"


def column_identifiers(columns: Iterable[object], sep: str = "__", limit: int = LIMIT) -> tuple[list[str], dict[str, str]]:
    """Different names for all columns in order, and those that changed."""
    out: list[str] = []
    taken: set[str] = set()
    changed: dict[str, str] = {}
    for column in map(str, columns):
        name = _free(_short(column, sep, limit), taken, len(out), limit)
        out.append(name)
        taken.add(name)
        if name != column:
            changed[column] = name
    return out, changed


def index_identifier(table: str, column: str, prefix: str = "IDX", limit: int = LIMIT) -> str:
    """Upper-case name; beyond the limit it ends in eight hex digits of its MD5."""
    name = sanitize(f"{prefix}_{table}_{column}").upper()
    if len(name) <= limit:
        return name
    mark = md5(name.encode()).hexdigest()[:8].upper()  # noqa: S324
    return name[: limit - 9].rstrip("_") + "_" + mark


@dataclass(frozen=True)
class NameMap:
    """Canonical to SQL names of one table; adding columns never changes those that it has."""

    table_original: str
    table_sql: str
    key_sep: str = "__"
    columns_original: tuple[str, ...] = ()
    columns_sql: tuple[str, ...] = ()
    column_map: dict[str, str] = field(default_factory=dict)

    @classmethod
    def build(cls, table: object, columns: Iterable[object] = (), key_sep: str = "__", limit: int = LIMIT) -> NameMap:
        """Map for a table; dots in column names stand for the separator."""
        original = tuple(str(c).replace(".", key_sep) for c in columns)
        sql = tuple(column_identifiers(original, key_sep, limit)[0])
        return cls(str(table), table_identifier(table, limit), key_sep, original, sql, dict(zip(original, sql)))

    def extended(self, columns: Iterable[object], limit: int = LIMIT) -> NameMap:
        """With the columns that are new."""
        original, sql, known = list(self.columns_original), list(self.columns_sql), dict(self.column_map)
        taken = set(sql)
        for column in (str(c).replace(".", self.key_sep) for c in columns):
            if column not in known:
                name = _free(_short(column, self.key_sep, limit), taken, len(sql), limit)
                original.append(column)
                sql.append(name)
                taken.add(name)
                known[column] = name
        return NameMap(self.table_original, self.table_sql, self.key_sep, tuple(original), tuple(sql), known)

    def column(self, name: str) -> str:
        return self.column_map.get(name, name)

    def changed(self) -> dict[str, str]:
        return {a: b for a, b in self.column_map.items() if a != b}

    def fits(self, table: object, columns: Iterable[str], key_sep: str = "__") -> bool:
        return (self.table_original, self.key_sep, self.columns_original) == (str(table), key_sep, tuple(columns))

    def to_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    @classmethod
    def from_dict(cls, data: Mapping) -> NameMap:
        lists = {k: tuple(data.get(k, ())) for k in ("columns_original", "columns_sql")}
        return cls(str(data["table_original"]), str(data["table_sql"]), str(data["key_sep"]), **lists, column_map=dict(data.get("column_map", {})))


def load_name_map(value: object) -> NameMap | None:
    """A NameMap from itself or its dict; None for anything else."""
    if isinstance(value, NameMap):
        return value
    try:
        return NameMap.from_dict(value) if isinstance(value, Mapping) else None
    except (KeyError, TypeError):
        return None


def distinct_tables(names: Iterable[str], limit: int = LIMIT) -> dict[str, str]:
    """SQL names of several tables, kept apart where shortening would make two the same."""
    out: dict[str, str] = {}
    for i, name in enumerate(names):
        out[name] = _free(table_identifier(name, limit), set(out.values()), i, limit)
    return out
