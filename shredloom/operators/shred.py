"""Shredding: one main table, one table for each list and one for each excepted branch, from VARIANT records.

The inventory of paths is turned into a :class:`ShredPlan` on the driver: names, types and JSON paths of every table's
columns. Applying the plan is a lazy ``select`` (and one ``LATERAL variant_explode`` for a list), so Catalyst prunes what
a caller doesn't use.

Rules: scalars become columns named by the joined keys; a list never is in the main table, and an empty one is nowhere; the
first element decides whether a list's objects become rows (other elements are dropped) or every element becomes a value;
within an item objects are flattened and lists stay as JSON cells; columns without any value are left out; a record is known
by its ``index_key`` (0 and false are valid), else by its number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredloom.naming import NameMap
from shredloom.plans.inventory import Found, kind_sql, take_inventory

_TYPES = {"BIGINT": "bigint", "DECIMAL": "double", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean"}
CONTEXT = ("__source_path__", "__source_member__", "__line_no__", "__record_index__")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def get_sql(source: str, keys: Iterable[str], dtype: str = "variant") -> str:
    """SQL of the value below ``source`` at a path of keys, whatever characters these have."""
    keys = list(keys)
    for i, k in enumerate(keys):
        if "'" in k and '"' in k:  # a path can't quote such a key
            inner = f"element_at(try_cast({get_sql(source, keys[:i])} AS map<string, variant>), {_literal(k)})"
            return get_sql(inner, keys[i + 1 :], dtype)
    path = "$" + "".join(f"['{k}']" if '"' in k else f'["{k}"]' for k in keys)
    return source if dtype == "variant" and not keys else f"try_variant_get({source}, {_literal(path)}, '{dtype}')"


def merged_type(dtypes: Iterable[str]) -> str:
    """One type for a path: its own, double for whole and other numbers together, else string."""
    kinds = {_TYPES.get(d, "string") for d in dtypes}
    return kinds.pop() if len(kinds) == 1 else "double" if kinds == {"bigint", "double"} else "string"


@dataclass(frozen=True)
class Field:
    """A column: where its value is, its type, and whether objects or lists can be there too and must be left out."""

    name: str
    paths: tuple[tuple[str, ...], ...]
    dtype: str
    guarded: bool = False
    cell: bool = False

    def sql(self, source: str) -> str:
        each = []
        for keys in self.paths:
            value, typed = get_sql(source, keys), get_sql(source, keys, self.dtype)
            if self.cell:
                kind = kind_sql(value)
                each.append(f"CASE WHEN {kind} IN ('OBJECT', 'ARRAY') THEN to_json({value}) ELSE try_cast({value} AS string) END")
            elif self.guarded:
                each.append(f"CASE WHEN {kind_sql(value)} NOT IN ('OBJECT', 'ARRAY') THEN {typed} END")
            else:
                each.append(typed)
        return each[0] if len(each) == 1 else f"coalesce({', '.join(each)})"


@dataclass
class ListTable:
    keys: tuple[str, ...]
    rows: list[Field] = field(default_factory=list)
    value: Field | None = None
    mixed: bool = False
    guarded: bool = False
    stray: bool = False


@dataclass
class ShredPlan:
    """Everything that is needed to select the tables; the driver-side description of a shredding."""

    sep: str
    index_key: str
    id_type: str
    id_keys: tuple[str, ...] | None
    main: list[Field]
    lists: dict[str, ListTable]
    excepted: dict[str, list[tuple[str, ...]]]
    warnings: list[str] = field(default_factory=list)

    def columns(self) -> dict[str, list[str]]:
        out = {"": [self.index_key, *(f.name for f in self.main)]}
        for name, t in self.lists.items():
            out[name] = [self.index_key, *sorted({f.name for f in t.rows} | ({t.value.name} if t.value else set()))]
        return out

    def name_maps(self, base: str) -> dict[str, NameMap]:
        return {name: NameMap.build(f"{base}{self.sep}{name}" if name else base, columns, self.sep) for name, columns in self.columns().items()}


@dataclass
class Shredded:
    main: DataFrame
    subs: dict[str, DataFrame]
    excepted: dict[str, DataFrame]
    plan: ShredPlan

    def tables(self, base: str) -> dict[str, DataFrame]:
        """All tables by name."""
        sep = self.plan.sep
        return {base: self.main} | {f"{base}{sep}{k}": v for k, v in self.subs.items()} | {f"{base}{sep}excepted{sep}{k}": v for k, v in self.excepted.items()}


def _fields(found: list[Found], name_of: Callable[[tuple[str, ...]], str], sep: str) -> list[Field]:
    """A column for each name; where nested keys and a literal key give the same name, the nested value counts."""
    by_name: dict[str, dict[tuple[str, ...], list[Found]]] = {}
    for f in found:
        if f.kind in ("value", "list"):
            by_name.setdefault(name_of(f.keys), {}).setdefault(f.keys, []).append(f)
    also: dict[tuple[str, ...], set[str]] = {}
    for f in found:
        also.setdefault(f.keys, set()).add(f.kind)
    parents = {f.keys[:i] for f in found for i in range(1, len(f.keys))}
    out = []
    for name, paths in sorted(by_name.items()):
        each = [f for fs in paths.values() for f in fs]
        cell = any(f.kind == "list" for f in each)
        f = Field(name, tuple(sorted(paths, key=len, reverse=True)), "string" if cell else merged_type(f.dtype for f in each), False, cell)
        out.append(Field(f.name, f.paths, f.dtype, _needs_guard(f, also, parents), cell))
    return out


def _needs_guard(f: Field, also: dict[tuple[str, ...], set[str]], parents: set[tuple[str, ...]]) -> bool:
    """Whether objects or lists are at the column's paths too."""
    return any(also[k] & {"object", "rows", "values", "empty"} for k in f.paths)


def make_plan(found: list[Found], index_key: str = "id", sep: str = "__", except_keys: Iterable[str] = (), compat: bool = False) -> ShredPlan:
    """The plan of an inventory. With ``compat``, nested index keys and bare except names lose data as they always did."""
    joined = lambda keys: sep.join(keys).replace(".", sep)
    top = [f for f in found if f.list_keys is None]
    warnings: list[str] = []
    excluded = {sep.join(f.keys) for f in top if f.kind == "except"} | {f.keys[-1] for f in top if f.kind == "except"}
    keys = next((f.keys for f in top if f.kind == "value" and f.keys == (index_key,)), None)
    if keys is None and not compat:
        keys = next((f.keys for f in top if f.kind == "value" and joined(f.keys) == index_key), None)
    if index_key in excluded:
        keys = None
    ids = [f for f in top if f.keys == keys and f.kind == "value"] if keys else []
    if any(f.keys == (index_key,) and f.kind in ("rows", "values") for f in top):
        warnings.append(f"some records have a list as {index_key}: they are known by their number")
    id_type = "bigint" if not ids or merged_type(f.dtype for f in ids) == "bigint" else "string"
    main = [f for f in _fields(top, joined, sep) if f.name != index_key]
    lists: dict[str, ListTable] = {}
    for f in top:
        if f.kind in ("rows", "values"):
            lists.setdefault(joined(f.keys), ListTable(f.keys))
    for name, t in lists.items():
        kinds = {f.kind for f in top if f.keys == t.keys}
        t.mixed = {"rows", "values"} <= kinds
        t.guarded = "object" in kinds
        t.stray = any(f.kind == "stray" for f in found if f.list_keys == t.keys)
        if "rows" in kinds:
            items = [f for f in found if f.list_keys == t.keys and f.keys]
            t.rows = _fields(items, lambda k, name=name: name if joined(k) == name else f"{name}{sep}{joined(k)}", sep)
        if "values" in kinds:
            each = [f for f in found if f.list_keys == t.keys and not f.keys]
            nested = any(f.kind == "list" for f in each)
            t.value = Field(name, ((),), "string" if nested else merged_type(f.dtype for f in each if f.kind == "value"), cell=nested)
    excepted: dict[str, list[tuple[str, ...]]] = {}
    for wanted in except_keys:
        paths = sorted({f.keys for f in top if f.kind == "except" and (sep.join(f.keys) == wanted or (not compat and f.keys[-1] == wanted))})
        if paths:
            excepted[wanted] = paths
    return ShredPlan(sep, index_key, id_type, keys, main, dict(sorted(lists.items())), excepted, warnings)


def _id_sql(plan: ShredPlan) -> str:
    if plan.id_keys is None:
        return "record_index"
    value = get_sql("v", plan.id_keys)
    if plan.id_type == "bigint":
        return f"coalesce({get_sql('v', plan.id_keys, 'bigint')}, record_index)"
    text = f"CASE WHEN {kind_sql(value)} NOT IN ('OBJECT', 'ARRAY') THEN try_cast({value} AS string) END"
    return f"coalesce(nullif({text}, ''), cast(record_index AS string))"


def apply_plan(records: DataFrame, plan: ShredPlan, typed: bool = True, expand: bool = False) -> Shredded:
    """Lazy tables of a plan. Untyped, all columns but the key are text; ``expand`` spreads the keys of excepted objects."""
    spark = records.sparkSession

    def column(f: Field, source: str) -> str:
        shown = f if typed else Field(f.name, f.paths, "string", f.guarded, f.cell)
        return f"{shown.sql(source)} AS `{f.name}`"

    key = f"{_id_sql(plan)} AS `{plan.index_key}`"
    main = records.selectExpr(key, *(column(f, "v") for f in plan.main))
    subs = {}
    for name, t in plan.lists.items():
        value = get_sql("v", t.keys)
        # tests of kinds cost time: they are made only where the inventory has seen something else
        lists = records.selectExpr(key, f"CASE WHEN {kind_sql(value)} = 'ARRAY' THEN {value} END AS __list" if t.guarded else f"{value} AS __list")
        first = f"{kind_sql("try_variant_get(__list, '$[0]', 'variant')")} = 'OBJECT'" if t.mixed else "true" if t.value is None else "false"
        items = spark.sql(f"SELECT `{plan.index_key}`, {first} AS __rows, t.value AS __item FROM {{lists}}, LATERAL variant_explode(__list) AS t", lists=lists)
        if t.stray:
            items = items.where(f"NOT __rows OR {kind_sql('__item')} = 'OBJECT'")
        fields: dict[str, list[str]] = {}
        for f in t.rows:
            shown = f if typed else Field(f.name, f.paths, "string", f.guarded, f.cell)
            fields.setdefault(f.name, []).append(f"CASE WHEN __rows THEN {shown.sql('__item')} END" if t.value else shown.sql("__item"))
        if t.value:
            alone = not t.rows
            value = t.value if typed else Field(name, ((),), "string", cell=t.value.cell)
            fields.setdefault(name, []).append(value.sql("__item") if alone else f"CASE WHEN NOT __rows THEN {value.sql('__item')} END")
        picked = [f"coalesce({', '.join(f'cast({e} AS string)' for e in each)}) AS `{n}`" if len(each) > 1 else f"{each[0]} AS `{n}`" for n, each in sorted(fields.items())]
        subs[name] = items.selectExpr(f"`{plan.index_key}`", *picked)
    excepted = {name.replace(".", plan.sep): _excepted(records, plan, paths, key, expand) for name, paths in plan.excepted.items()}
    return Shredded(main, subs, excepted, plan)


def _excepted(records: DataFrame, plan: ShredPlan, paths: list[tuple[str, ...]], key: str, expand: bool) -> DataFrame:
    """Raw payloads of a branch with their provenance; an object at the path's parent must hold the key, its value may be null."""
    out = None
    context = [F.col(c) if c in records.columns else F.lit(None) for c in ("source_path", "source_member", "line_no", "record_index")]
    kinds = ("string", "string", "bigint", "bigint")
    for keys in paths:
        value = get_sql("v", keys)
        part = records.selectExpr("*", f"{value} AS __value", key).where("__value IS NOT NULL")
        kind = kind_sql("__value")
        text = f"CASE WHEN {kind} IN ('OBJECT', 'ARRAY') THEN to_json(__value) ELSE try_cast(__value AS string) END"
        name = f"CASE {kind} WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' WHEN 'STRING' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'BIGINT' THEN 'int' WHEN 'VOID' THEN 'NoneType' ELSE 'float' END"
        columns = [
            F.col(f"`{plan.index_key}`"), F.expr(text).alias("value"), F.lit(plan.sep.join(keys)).alias("__except_path__"), F.expr(name).alias("__except_raw_type__"), F.to_json("__value").alias("__except_raw_json__"),
            *(c.cast(k).alias(n) for c, k, n in zip(context, kinds, CONTEXT)),
        ]
        if expand:
            spread = part.where(f"{kind} = 'OBJECT'").select(F.explode(F.expr("json_object_keys(to_json(__value))")).alias("k")).distinct()
            names = sorted(r.k for r in spread.collect())
            extra = [F.expr(get_sql("__value", [n], "string")).alias(n) for n in names if n != plan.index_key and n not in CONTEXT]
            taken = {n for n in names}
            columns = [c for c, n in zip(columns, (plan.index_key, "value", "__except_path__", "__except_raw_type__", "__except_raw_json__", *CONTEXT)) if n != "value" or "value" not in taken] + extra
        part = part.select(*columns)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def shred(records: DataFrame, index_key: str = "id", except_keys: Iterable[str] = (), sep: str = "__", typed: bool = True, expand: bool = False, compat: bool = False) -> Shredded:
    """Inventory, plan and tables of raw records in one call."""
    except_keys = list(except_keys)
    plan = make_plan(take_inventory(records, except_keys, sep), index_key, sep, except_keys, compat)
    return apply_plan(records, plan, typed, expand)


def prune_empty(df: DataFrame, key: str) -> DataFrame:
    """Without columns that have no value; one aggregation."""
    others = [c for c in df.columns if c != key]
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in others]).first() if others else {}
    return df.select(key, *[f"`{c}`" for c in others if counts[c]])


def drop_dummy_lists(df: DataFrame, mark: str = "__List") -> DataFrame:
    """Without columns whose name holds ``mark`` and whose values are all empty lists."""
    names = [c for c in df.columns if mark in c]
    if not names:
        return df
    full = df.agg(*[F.coalesce(F.max(F.when(F.col(f"`{c}`").isNotNull() & (F.trim(F.col(f"`{c}`").cast("string")) != "[]"), 1)), F.lit(0)).alias(c) for c in names]).first()
    return df.drop(*[c for c in names if not full[c]])


def key_first(df: DataFrame, key: str, by_name: bool = False) -> DataFrame:
    """The key first, then the columns as they are or by name."""
    rest = [c for c in df.columns if c != key]
    return df.select(f"`{key}`", *[f"`{c}`" for c in (sorted(rest) if by_name else rest)])


def without_branches(df: DataFrame, paths: Iterable[str], sep: str = "__") -> DataFrame:
    """Without flat columns of these paths and of what is below them."""
    paths = [p for p in paths]
    return df.select(*[f"`{c}`" for c in df.columns if not any(c == p or c.startswith(p + sep) for p in paths)])


def simplify_names(df: DataFrame, table: str = "") -> DataFrame:
    """``__`` and ``.`` become ``_``, and a leading table name goes."""
    out, taken = [], set()
    for c in df.columns:
        name = c.replace("__", "_").replace(".", "_")
        prefix = table.replace("__", "_").replace(".", "_") + "_"
        if table and name.startswith(prefix) and name[len(prefix) :] not in taken | {x for x in df.columns if x != c}:
            name = name[len(prefix) :]
        out.append(name)
        taken.add(name)
    return df.toDF(*out)


def one_hot(df: DataFrame, column: str, max_values: int = 5) -> DataFrame:
    """Replace an array column by 0/1 columns, one for each value, if it has at most ``max_values`` different ones."""
    values = [r[0] for r in df.select(F.explode(column).alias("x")).where("x is not null").distinct().orderBy("x").limit(max_values + 1).collect()]
    if len(values) > max_values:
        return df
    flags = [F.coalesce(F.array_contains(column, v).cast("int"), F.lit(0)).alias(f"{column}__{v}") for v in values]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], *flags)


def rejoin(main: DataFrame, subs: Iterable[DataFrame], key: str = "id") -> DataFrame:
    """The main table with each sub-table's rows, by left joins on the key."""
    out = main
    for sub in subs:
        out = out.join(sub, key, "left")
    return out
