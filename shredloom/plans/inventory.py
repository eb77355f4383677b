"""Which paths, kinds and types occur in a table of VARIANT records.

One pass: Spark gives the shape of each record, every task counts its different shapes and walks one example of each, so that only
counters of paths and kinds are shuffled. Records whose shape doesn't tell everything are walked themselves. (Exploding level by level
in SQL reads the input once for each level and infers every nested schema again; turning every record into text and walking
it in Python takes several times as long.)
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longer shapes are hardly ever repeated, and so many of them are kept by a task.
LONGEST, SHAPES = 8192, 2000


@dataclass(frozen=True)
class Found:
    """A path of ``keys``, of a record or, with ``list_keys``, of an item of that list.

    ``kind`` is value, null, object, empty (a list), list (a cell in an item), rows (a list whose first element is an object),
    values (any other list), stray (an element of a rows list that is no object) or except (a branch that is kept apart);
    ``dtype`` is a scalar's type; ``n`` counts the records that have it. Elements of a values list have no keys.
    """

    list_keys: tuple[str, ...] | None
    keys: tuple[str, ...]
    kind: str
    dtype: str
    n: int


def kind_sql(value: str) -> str:
    """OBJECT, ARRAY, VOID or the scalar type of a VARIANT expression; NULL if there is none."""
    return f"regexp_extract(schema_of_variant({value}), '^[A-Z]+', 0)"


def scalar_type(value: Any) -> str:
    if isinstance(value, bool):
        return "BOOLEAN"
    if isinstance(value, int):
        return "BIGINT" if -(2**63) <= value < 2**63 else "DECIMAL"
    return "DOUBLE" if isinstance(value, float) else "STRING"


_TOKEN = re.compile(r"(?P<key>`(?:[^`]|``)*`|[^\s`<>,:()]+): |(?P<open>OBJECT<|ARRAY<)|(?P<close>>)|(?P<scalar>[A-Z_]+)(?:\((?P<digits>\d+),(?P<scale>\d+)\))?")
_EXAMPLES = {"BIGINT": "0", "DOUBLE": "0.5", "FLOAT": "0.5", "BOOLEAN": "true", "VOID": "null"}


def example(shape: str) -> Any:
    """The smallest value of a shape as ``schema_of_variant`` gives it: every list has one element, or none if nothing is known of it."""
    ends: list[str] = []

    def token(m: re.Match) -> str:
        if m["key"]:
            return json.dumps(m["key"][1:-1].replace("``", "`") if m["key"][0] == "`" else m["key"]) + ":"
        if m["open"]:
            ends.append("}" if m["open"] == "OBJECT<" else "]")
            return "{" if m["open"] == "OBJECT<" else "["
        if m["close"]:
            return ends.pop()
        if m["scalar"] == "VOID" and ends and ends[-1] == "]":
            return ""
        if m["scalar"] == "DECIMAL":  # whole ones of more digits don't come here
            return "0" if m["scale"] == "0" else "0.5"
        return _EXAMPLES.get(m["scalar"], '""')

    return json.loads(_TOKEN.sub(token, shape))


def with_shape(records: DataFrame) -> DataFrame:
    """The records with their ``shape`` where that tells all about their paths, kinds and types, else NULL.

    A shape merges the elements of a list: it doesn't tell which are null or hold empty lists, nor of different kinds what they are.
    It doesn't tell either whether whole decimals of 19 digits and more were integers. Records without their text may hold nulls anywhere.
    """
    raw, s = F.col("raw"), F.col("__shape")
    hidden = F.coalesce(raw.contains("null") | raw.rlike(r"\[\s*\]"), F.lit(True)) if "raw" in records.columns else F.lit(True)
    unclear = (F.length(s) > LONGEST) | s.contains("VARIANT") | (s.rlike("ARRAY<[OVA]") & hidden) | s.rlike(r"DECIMAL\((19|[23]\d),0\)")
    # of an array, so that it is evaluated once
    shaped = records.select(*records.columns, F.explode(F.array(F.expr("schema_of_variant(v)"))).alias("__shape"))
    return shaped.withColumn("shape", F.when(~unclear, s)).drop("__shape")


def shapes(records: DataFrame) -> DataFrame:
    """(shape, j) of each record: its shape where that tells all, else its JSON text. Of written ones only the shapes are read if these do."""
    if "shape" not in records.columns:
        return with_shape(records).select("shape", F.when(F.col("shape").isNull(), F.to_json("v")).alias("j"))
    unclear = records.where("shape is null").select("shape", F.to_json("v").alias("j"))
    return records.where("shape is not null").select("shape", F.lit(None).cast("string").alias("j")).unionByName(unclear)


def each_example(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
    """(record, how many have its shape) of what :func:`shapes` gives."""
    seen: Counter = Counter()
    for b in batches:
        for pair in pc.value_counts(b.column(0)).to_pylist():
            if pair["values"] and pair["values"].startswith("OBJECT<"):
                seen[pair["values"]] += pair["counts"]
        if len(seen) > SHAPES:
            yield from ((example(s), n) for s, n in seen.items())
            seen.clear()
        for text in b.column(1).drop_null().to_pylist():
            if isinstance(value := json.loads(text), dict):
                yield value, 1
    yield from ((example(s), n) for s, n in seen.items())


def _walk(record: dict, seen: set, excepted: frozenset[str], sep: str) -> None:
    """Add every path of a record."""
    todo: list[tuple] = [(None, (), record)]
    while todo:
        owner, above, node = todo.pop()
        for key, value in node.items():
            keys = (*above, key)
            if key in excepted or (excepted and sep.join(keys) in excepted):
                seen.add((owner, keys, "except", ""))
            elif isinstance(value, dict):
                seen.add((owner, keys, "object", ""))
                todo.append((owner, keys, value))
            elif isinstance(value, list):
                if owner is not None:
                    seen.add((owner, keys, "list", ""))
                elif not value:
                    seen.add((owner, keys, "empty", ""))
                elif isinstance(value[0], dict):
                    seen.add((owner, keys, "rows", ""))
                    for item in value:
                        if isinstance(item, dict):
                            todo.append((keys, (), item))
                        else:
                            seen.add((keys, (), "stray", ""))
                else:
                    seen.add((owner, keys, "values", ""))
                    for item in value:
                        nested = isinstance(item, dict | list)
                        seen.add((keys, (), "list" if nested else "null" if item is None else "value", "" if nested or item is None else scalar_type(item)))
            elif value is None:
                seen.add((owner, keys, "null", ""))
            else:
                seen.add((owner, keys, "value", scalar_type(value)))


def take_inventory(records: DataFrame, except_keys: Iterable[str] = (), sep: str = "__") -> list[Found]:
    """All paths of ``records.v``; one row for each path and kind comes to the driver."""
    excepted = frozenset(except_keys)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for record, times in each_example(batches):
            paths: set = set()
            _walk(record, paths, excepted, sep)
            for p in paths:
                seen[p] += times
        if seen:
            rows = [(None if o is None else list(o), list(k), kind, dtype, n) for (o, k, kind, dtype), n in seen.items()]
            kinds = (pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["list_keys", "keys", "kind", "dtype", "n"])

    counted = shapes(records).mapInArrow(one, "list_keys array<string>, keys array<string>, kind string, dtype string, n bigint")
    groups = counted.groupBy("list_keys", "keys", "kind", "dtype").agg(F.sum("n").alias("n")).collect()
    return [Found(None if g.list_keys is None else tuple(g.list_keys), tuple(g["keys"]), g.kind, g.dtype, g.n) for g in groups]
