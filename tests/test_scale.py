"""Faults that only larger tables showed, on small ones with settings that bring them out."""

import json

import pytest
from pyspark.sql import functions as F

from shredloom.config import Options
from shredloom.operators import shred, structure
from shredloom.plans import inventory, roster
from shredloom.sources import records


@pytest.fixture
def settings(spark):
    """Set Spark settings for one test."""
    before = {}

    def put(name, value):
        before.setdefault(name, spark.conf.get(name))
        spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.set(name, value)


def test_numbers_are_dense_however_ranges_are_joined(spark, settings):
    """Adaptive execution joins ranges by their bytes, which differ between the rows and their counts."""
    settings("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    settings("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    settings("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    settings("spark.sql.shuffle.partitions", "40")
    df = spark.range(20000).select((F.col("id") * 7 % 20011).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    got = [(r.k, r.record_index) for r in roster._numbered(df, "k").select("k", "record_index", "wide").orderBy("k").collect()]
    assert [i for _, i in got] == list(range(20000))


ODD = [
    {"id": 1, "a": [{"x": 1}, None], "b": [None, {"x": 1}], "c": [], "d": [None], "e": [[{"z": 1}]], "f": {"g": {}}},
    {"id": 2, "a": [{"x": []}, {"x": [{"y": 1}]}, {"w": {"u": []}}, {"w": {"u": [{"t": 1}]}}], "c": [[], {"q": 1}], "f": {"g": {"h": 1.5}}},
    {"id": 3, "a": [{"x": {"v": 1}}, {"x": "s"}], "c": [1, 2.5], "f": [1], "n": 12345678901234567890, "m": 17.0},
    {"id": 4, "k: <,>`x": {"": 1, "OBJECT<": "null", "é\n": [True]}, "n": 1, "m": [17.0, 3], "d": [0.25, 1]},
]


def texts(spark, *items):
    return roster.raw_from_json(spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "i long, j string"), "j", "i")


@pytest.mark.parametrize("given", [[x] for x in ODD] + [ODD, [x for x in ODD for _ in range(3)]])
def test_shapes_tell_what_the_records_do(spark, given):
    """Inventory and structure from shapes, from written ones and from the records alone are the same."""
    raw = texts(spark, *given)
    ways = [raw, roster.written(raw), raw.drop("raw")]
    pairs = [{tuple(r) for r in structure.key_pairs(w).collect()} for w in ways]
    assert pairs[0] == pairs[1] == pairs[2]
    plans = [shred.make_plan(inventory.take_inventory(w)) for w in ways]
    assert plans[0] == plans[1] == plans[2]
    assert {r.path for r in structure.raw_paths(raw).collect()} == {r.path for r in structure.nodes(raw).select("path").distinct().collect()}


def test_few_rows_leave_the_tasks(spark):
    """Branches, pairs and keys are counted within the tasks: rows that are shuffled don't follow the records."""
    raw = texts(spark, *({"id": i, "l": [{"x": i, "y": {"z": 1}}] * 3} for i in range(2000))).coalesce(1)
    stats = {r.path: tuple(r)[1:] for r in structure.dict_path_stats(raw).collect()}
    assert stats == {"l": (6000, 12000, 2), "l__y": (6000, 6000, 1)}
    for df in (structure.key_pairs(raw), structure.raw_paths(raw), structure.dict_path_stats(raw)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "explode(array(named_struct" not in plan and "Expand" not in plan
    assert len([f for f in inventory.take_inventory(raw)]) == 5 and inventory.shapes(raw).where("j is not null").count() == 0


def test_maps_are_counted_key_by_key(spark):
    wide = texts(spark, *({"id": i, "idx": {f"w{i}_{j}": [j] for j in range(100)} | {"same": [0]}, "e": {}, "o": [[{}], 1, None]} for i in range(20)))
    for way in (wide, wide.drop("raw")):
        assert {r.path: tuple(r)[1:] for r in structure.dict_path_stats(way).collect()} == {"idx": (20, 2020, 2001), "e": (20, 0, 0), "o": (20, 0, 0)}


def test_every_text_is_parsed_once(spark):
    plan = texts(spark, {"id": 1}).select("v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1


def test_texts_are_rebuilt_without_moving_words(spark):
    words = spark.createDataFrame([(1, {"b": [0, 2], "a": [0, 5], "n": []}), (1, {"c": [2]}), (2, {"x": []}), (3, None)], "id int, idx map<string,array<int>>")
    df = structure.rebuild_text(words.repartition(3, "id"), "id", "idx")
    assert [tuple(r) for r in df.collect()] == [(1, "a b a", 3, 0.5, 2)]
    plan = structure.rebuild_text(words.repartition(3, "id"), "id", "idx")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan


def test_lines_of_any_name_are_read_by_spark(spark, tmp_path):
    """A worker that takes a file whole needs memory for all of it."""
    (tmp_path / "a.txt").write_text('\n{"id":1}\n\n{"id":2}\nbroken\n')
    (tmp_path / "b.json").write_text('{"id":3}\n')
    (tmp_path / "c.json").write_text('{\n"id":4}\n')
    raw = records.read_raw(spark, Options.of(file_glob=str(tmp_path / "*")))
    got = raw.records.select("record_index", "line_no", F.to_json("v").alias("j")).orderBy("record_index").collect()
    assert [tuple(r) for r in got] == [(0, 2, '{"id":1}'), (1, 4, '{"id":2}'), (2, None, '{"id":3}'), (3, None, '{"id":4}')]
    assert [(r.line_no, r.raw) for r in raw.rejects.collect()] == [(5, "broken")]
    lines = records.read_raw(spark, Options.of(file_glob=str(tmp_path / "a.txt"))).records
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "binaryFile" not in plan
