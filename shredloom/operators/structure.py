"""Structure of nested records: branches and their types, drifting paths, map-like objects, and rebuilt texts."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredloom.plans.inventory import each_example, shapes

#: A task keeps about so many different results before it hands them over; objects of at most FEW keys are counted by these.
KEPT, FEW = 200_000, 32
NODES = "record_index bigint, parent string, path string, key string, kind string, branch_type string, dtype string, in_list boolean, list_len int, objects int, sample string"


def _branch(value: object) -> str:
    if isinstance(value, dict):
        return "Dict"
    return "Value" if not isinstance(value, list) else "List of Dict" if any(isinstance(x, dict) for x in value) else "List of Value"


def _objects(items: list) -> list[dict]:
    """The objects of a list and of the lists in it."""
    while list in map(type, items):
        items = [y for x in items for y in (x if type(x) is list else [x])]
    return [x for x in items if type(x) is dict]


def _nodes(index: int, record: dict, sep: str, items: int | None = None) -> Iterator[tuple]:
    todo: list[tuple] = [("", False, record)]
    while todo:
        parent, inside, node = todo.pop()
        for key, value in node.items():
            path = f"{parent}{sep}{key}" if parent else key
            kind = "dict" if isinstance(value, dict) else "list" if isinstance(value, list) else "value"
            size = objects = sample = None
            if kind == "dict":
                todo.append((path, False, value))
            elif kind == "list":
                size = len(value)
                found = _objects(value[:items])
                objects = len(found)
                todo += [(path, True, x) for x in found]
            elif value is not None:
                sample = str(value)[:80]
            yield index, parent, path, key, kind, _branch(value), type(value).__name__, inside, size, objects, sample


def nodes(records: DataFrame, sep: str = "__", items: int | None = None) -> DataFrame:
    """One row for each branch of every record, in one pass: its parent, path, key, kind (dict, list, value), branch type and type.

    Items of a list share its path; ``in_list`` says that a branch belongs to an object in a list, ``objects`` how many objects are
    directly in a list. ``items`` looks at a list's first items only. That is many rows: counts are better made within the tasks.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_index", pa.int64()), *((n, pa.string()) for n in ("parent", "path", "key", "kind", "branch_type", "dtype")), ("in_list", pa.bool_()), ("list_len", pa.int32()), ("objects", pa.int32()), ("sample", pa.string())])
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                found = [r for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if text for r in _nodes(i, json.loads(text), sep, items)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return records.select("record_index", F.to_json("v").alias("j")).where("j like '{%'").mapInArrow(one, NODES)


def _batches(rows: Iterable[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of texts, and of an ``n`` if there is one, as batches."""

    def column(name: str, values: tuple) -> pa.Array:
        if name == "n":
            return pa.array(values, pa.int64())
        try:
            return pa.array(values, pa.string())
        except UnicodeEncodeError:  # half a surrogate pair, which the JVM also replaces so
            return pa.array([None if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())

    rows = iter(rows)
    while some := list(islice(rows, 10_000)):
        yield pa.RecordBatch.from_arrays([column(n, c) for n, c in zip(names, zip(*some))], names)


def _different(records: DataFrame, names: list[str], of: Callable[[tuple], Iterable[tuple]], sep: str) -> DataFrame:
    """What ``of`` gives for the branches of all records, each once: every task looks at one example of each shape."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple] = set()
        for record, _ in each_example(batches):
            found.update(x for node in _nodes(0, record, sep) for x in of(node))
            if len(found) > KEPT:
                yield from _batches(found, names)
                found.clear()
        yield from _batches(found, names)

    return shapes(records).mapInArrow(one, ", ".join(f"{n} string" for n in names)).distinct()


def key_pairs(records: DataFrame, sep: str = "__") -> DataFrame:
    """Distinct (type, dtype, parent, branch): a branch of an object in a list is a value in it, a list of objects also has a node ``List``."""

    def pairs(node: tuple) -> Iterator[tuple]:
        _, parent, path, _, _, own, _, inside, *_ = node
        yield ("Value in List of Dict", "list", parent, path) if inside else (own, "dict", parent, path)
        if own == "List of Dict" or (own == "List of Value" and inside):
            yield "List", "list", path, f"{path}{sep}List"

    return _different(records, ["type", "dtype", "parent", "branch"], pairs, sep)


def raw_paths(records: DataFrame, sep: str = "__") -> DataFrame:
    """Every ``path`` of the records, once."""
    return _different(records, ["path"], lambda node: [(node[2],)], sep)


def branch_vote(pairs: DataFrame) -> DataFrame:
    """(parent, branch, type): the type with the most distinct pairs, of equal ones the first by name."""
    counted = pairs.distinct().groupBy("parent", "branch", "type").agg(F.count("*").alias("n"))
    # largest count, then the smallest name: the least of (-count, name)
    return counted.groupBy("parent", "branch").agg(F.min(F.struct((-F.col("n")).alias("n"), "type"))["type"].alias("type"))


def dict_path_stats(records: DataFrame, sep: str = "__", approximate: bool = False) -> DataFrame:
    """(path, observations, dict_keys_total, unique_keys) of the objects below the top level; items of lists share its path.

    One pass over the records, in which every task counts the keys of each path, and one aggregation of these counts.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()  # objects by path
        few: Counter = Counter()  # by path and keys, of objects with few
        many: dict[str, Counter] = {}  # keys by path

        def counts() -> Iterator[tuple]:
            for (path, keys), n in few.items():
                own = many.setdefault(path, Counter())
                for k in keys:
                    own[k] += n
            yield from ((path, None, n) for path, n in seen.items() if path)
            yield from ((path, k, n) for path, own in many.items() for k, n in own.items())
            for kept in (seen, few, many):
                kept.clear()

        for b in batches:
            for i, text in enumerate(b.column(0).to_pylist()):
                if i % 100 == 99 and len(few) + sum(map(len, many.values())) > KEPT:
                    yield from _batches(counts(), ["path", "key", "n"])
                value = _loads(text) if text else None
                todo = [("", value)] if isinstance(value, dict) else []
                while todo:
                    parent, node = todo.pop()
                    if parent and len(node) <= FEW:
                        few[parent, tuple(node)] += 1
                    elif parent:
                        many.setdefault(parent, Counter()).update(node.keys())
                    for key, value in node.items():
                        kind = type(value)
                        if kind is dict or kind is list:
                            found = [value] if kind is dict else _objects(value)
                            if found:
                                path = f"{parent}{sep}{key}" if parent else key
                                seen[path] += len(found)
                                todo += [(path, x) for x in found]
        yield from _batches(counts(), ["path", "key", "n"])

    texts = records.select((F.col("raw") if "raw" in records.columns else F.to_json("v")).alias("j"))
    found = texts.mapInArrow(one, "path string, key string, n bigint")
    if approximate:
        unique = F.approx_count_distinct("key")
    else:
        unique, found = F.count("key"), found.groupBy("path", "key").agg(F.sum("n").alias("n"))
    n, of_key = F.col("n"), F.col("key").isNotNull()
    return found.groupBy("path").agg(
        F.coalesce(F.sum(F.when(~of_key, n)), F.lit(0)).alias("observations"), F.coalesce(F.sum(F.when(of_key, n)), F.lit(0)).alias("dict_keys_total"), unique.alias("unique_keys")
    )


def _loads(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:  # an integer of thousands of digits; the text itself was parsed before
        return json.loads(text, parse_int=float)


def auto_except(stats: DataFrame, min_observations: int = 20, min_unique: int = 512, novelty: float = 2.0) -> DataFrame:
    """Paths of objects that are used as maps: seen often, with many different keys, and new ones in each."""
    ratio = F.col("unique_keys") / F.col("observations")
    return stats.where((F.col("observations") >= min_observations) & (F.col("unique_keys") >= min_unique) & (ratio >= novelty)).withColumn("novelty", ratio)


def top_profile(stats: DataFrame, n: int = 30) -> DataFrame:
    """The n paths with the most different keys, then the most new ones in each, then by name."""
    ratio = F.col("unique_keys") / F.greatest(F.col("observations"), F.lit(1))
    return stats.withColumn("novelty", ratio).orderBy(F.desc("unique_keys"), F.desc("novelty"), "path").limit(n)


def estimate(seconds: float, sampled: int, total: int, sampled_bytes: int | None = None, total_bytes: int | None = None) -> tuple[float, float]:
    """(least, most) seconds for all sources, from a sample's by number and by bytes."""
    by = [seconds * total / sampled] if sampled else []
    if sampled_bytes and total_bytes:
        by.append(seconds * total_bytes / sampled_bytes)
    return (min(by), max(by)) if by else (0.0, 0.0)


def union_view(records: DataFrame, except_keys: Iterable[str] = (), sep: str = "__", items: int = 30) -> DataFrame:
    """One row for each path of all records together: coverage, modes of kind, branch and data type, drift, and list lengths.

    A path of several kinds or types drifts in type; one that not all records have drifts in coverage. Modes break ties by name.
    """
    total = records.agg(F.count("*")).first()[0]
    found = nodes(records, sep, items)
    # one node for each path of a record, as items of a list share it
    each = found.groupBy("record_index", "path").agg(F.min("parent").alias("parent"), *[F.min(c).alias(c) for c in ("kind", "branch_type", "dtype", "sample")], F.max("list_len").alias("list_len"))

    def mode(c: str) -> list:
        return [F.mode(c, True).alias(c), F.count_distinct(c).alias(f"n_{c}")]

    stats = each.groupBy("path").agg(
        F.min("parent").alias("parent"), F.count("*").alias("present"), *mode("kind"), *mode("branch_type"), *mode("dtype"),
        F.min("list_len").alias("list_min"), F.max("list_len").alias("list_max"), F.avg("list_len").alias("list_avg"), F.slice(F.array_sort(F.collect_set("sample")), 1, 3).alias("samples"),
    )
    drift = (F.col("n_kind") > 1) | (F.col("n_branch_type") > 1) | ((F.col("kind") == "value") & (F.col("n_dtype") > 1))
    children = stats.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n_children"))
    path = F.col("path")
    excepted = F.lit(False)
    for k in except_keys:
        excepted = excepted | (path == k) | path.startswith(k + sep)
    return stats.join(children, "path", "left").select(
        "path", F.when(F.col("parent") == "", "root").otherwise(F.col("parent")).alias("parent"), "kind", "branch_type", "dtype", "present", F.lit(total).alias("total"), (F.col("present") / total).alias("coverage"),
        drift.alias("type_drift"), (F.col("present") / total < 0.999999).alias("cov_drift"), (drift | (F.col("present") / total < 0.999999)).alias("exception"), excepted.alias("excepted"),
        "list_min", "list_max", "list_avg", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.size(F.split("path", sep)).alias("depth"), "samples",
    )


def raw_tree(records: DataFrame, sep: str = "__", items: int = 30) -> DataFrame:
    """(parent, path, branch_type, dtype, n) of the records' branches, looking at the first ``items`` of each list."""
    return nodes(records, sep, items).groupBy("parent", "path", "branch_type", "dtype").agg(F.count("*").alias("n"))


def key_diff(raw_paths: DataFrame, flat_paths: DataFrame, except_keys: Iterable[str] = (), sep: str = "__") -> DataFrame:
    """(path, status) for two tables of paths: missing from the flat side (perhaps because excepted), or extra there."""
    excepted = F.lit(False)
    for k in except_keys:
        excepted = excepted | (F.col("path") == k) | F.col("path").startswith(k + sep)
    gone = raw_paths.select("path").distinct().join(flat_paths.select("path").distinct(), "path", "left_anti")
    new = flat_paths.select("path").distinct().join(raw_paths.select("path").distinct(), "path", "left_anti")
    return gone.select("path", F.when(excepted, "missing_excepted").otherwise("missing").alias("status")).unionByName(new.select("path", F.lit("extra").alias("status")))


def rebuild_text(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, text, tokens, density, collisions) from a map of token to positions: tokens in order of position.

    Of several tokens at one position the first by name is taken, the others are collisions; density is the share of positions
    up to the last that have a token.
    """
    at = df.select(key, F.expr(f"flatten(transform(filter(map_entries(`{column}`), e -> e.value IS NOT NULL), e -> transform(e.value, a -> struct(a AS at, e.key AS token))))").alias("__at"))
    # a key's tokens move together, and only if its rows aren't together yet
    by_place = at.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("__at"))).alias("__at")).where("size(__at) > 0")
    firsts = by_place.select(key, "__at", F.expr("filter(__at, (x, i) -> i = 0 OR NOT x.at <=> __at[i - 1].at)").alias("__one"))
    n = F.size("__one").cast("bigint")
    return firsts.select(
        key, F.array_join(F.transform("__one", lambda x: x["token"]), " ").alias("text"), n.alias("tokens"), (n / (F.array_max(F.transform("__one", lambda x: x["at"])) + 1)).alias("density"),
        (F.size("__at") - n).alias("collisions"),
    )
