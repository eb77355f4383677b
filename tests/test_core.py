"""Rules of shredding, naming, types, drift, reports, sources, sinks and streaming on small fixtures."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shredloom import cli, config, naming
from shredloom.functions import scalars
from shredloom.operators import drift, profile, reports, review, shred, sinks, structure
from shredloom.sources import records as rec
from shredloom.sources import tabular
from shredloom.streaming import loop


def raw(spark, *items):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "i long, j string")
    return rec.raw_from_json(df, "j", "i")


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- names


def test_identifiers():
    assert len(naming.table_identifier("A" * 74)) == 64 and naming.table_identifier("x_1_b_" + "long" * 15) == "long" * 15
    names, changed = naming.column_identifiers(["prefix__" + "X" * 80] * 2)
    assert len(set(names)) == 2 and all(0 < len(n) <= 64 for n in names) and changed
    assert naming.index_identifier("t", "col" * 30) == naming.index_identifier("t", "col" * 30) and len(naming.index_identifier("t", "col" * 30)) <= 64
    m = naming.NameMap.build("t", ["a", "b"])
    assert m.extended(["b", "c", "a", "d"]).columns_sql == ("a", "b", "c", "d")
    assert naming.NameMap.from_dict(m.to_dict()) == m == naming.load_name_map(m.to_dict()) and naming.load_name_map(3) is None
    assert naming.sanitize("__a--b c_") == "a_b_c"
    assert len(set(naming.distinct_tables(["p_" + "q" * 64, "r_" + "q" * 64]).values())) == 2


def test_config_and_modes():
    o = config.Options.of({"FILE_SEP": ",", "save_local_dir": "x", "schema_mode": "evolve_then_freeze", "what": 1})
    assert (o.SEP, o.persist_parquet_dir, o.schema_mode, o.extra) == (",", "x", "hybrid", {"what": 1})
    assert config.Options.of(o.to_dict()) == o
    o, stages = config.with_mode({"chunk_size": 7}, "ingest-fast", chunk_size=9)
    assert o.chunk_size == 9 and o.json_streaming_load and not stages["index"]
    with pytest.raises(ValueError, match="unknown mode"):
        config.with_mode({}, "nope")
    assert config.conflicts(config.Options(persist_tsv_files=True))
    assert config.masked({"db": {"password": "x", "user": "u"}}) == {"db": {"password": "***", "user": "u"}}
    assert config.as_list("a, b,,") == ["a", "b"] and config.as_bool("No", True) is False and config.as_int("x", 4) == 4


# --- shredding


def test_basic_and_excepted(spark):
    s = shred.shred(raw(spark, {"id": 1, "a": 1, "items": [{"x": 10}, {"x": 11}]}, {"id": 2, "a": {"y": 2}, "items": [{"x": 20}]}), except_keys=["a"])
    assert s.main.columns == ["id"] and s.subs["items"].columns == ["id", "items__x"] and s.subs["items"].count() == 3
    e = rows(s.excepted["a"].orderBy("id"))
    assert [(x["value"], x["__except_raw_type__"], x["__line_no__"]) for x in e] == [("1", "int", 1), ('{"y":2}', "dict", 2)]


def test_lists(spark):
    s = shred.shred(raw(spark, {"id": 1, "xs": [], "m": [{"a": 1}, 5]}, {"id": 2, "m": [5, {"a": 1}]}, {"id": 3, "m": [None, {"a": 1}]}))
    assert "xs" not in s.subs
    got = {(r["id"], r["m"], r["m__a"]) for r in rows(s.subs["m"])}
    assert got == {(1, None, 1), (2, "5", None), (2, '{"a":1}', None), (3, None, None), (3, '{"a":1}', None)}


def test_items_flatten_and_keep_lists(spark):
    s = shred.shred(raw(spark, {"id": 1, "items": [{"t": {"u": 1}, "ys": [{"z": 1}]}]}))
    assert list(s.subs) == ["items"] and rows(s.subs["items"]) == [{"id": 1, "items__t__u": 1, "items__ys": '[{"z":1}]'}]


def test_nested_path_wins_and_nulls_are_pruned(spark):
    s = shred.shred(raw(spark, {"id": 1, "a": {"b": 2}, "a__b": 1, "never": None, "d": {}}))
    assert rows(s.main) == [{"id": 1, "a__b": 2}]


@pytest.mark.parametrize(("value", "known"), [(None, "0"), ("", "0"), ("k", "k")])
def test_ids_fall_back(spark, value, known):
    assert str(rows(shred.shred(raw(spark, {"id": value, "x": 1})).main)[0]["id"]) == known


def test_zero_false_list_and_nested_ids(spark):
    assert [r["id"] for r in rows(shred.shred(raw(spark, {"id": 0}, {"id": 5})).main)] == [0, 5]
    assert rows(shred.shred(raw(spark, {"id": False, "x": 1})).main)[0]["id"] == "false"
    s = shred.shred(raw(spark, {"id": [1], "x": 1}))
    assert rows(s.main)[0]["id"] == 0 and s.plan.warnings
    n = shred.shred(raw(spark, {"h": {"id": 7}, "xs": [1]}), index_key="h__id")
    assert rows(n.main) == [{"h__id": 7}] and rows(n.subs["xs"]) == [{"h__id": 7, "xs": 1}]
    c = shred.shred(raw(spark, {"h": {"id": 7}, "xs": [1]}), index_key="h__id", compat=True)
    assert rows(c.subs["xs"])[0]["h__id"] == 0


def test_bare_except_name(spark):
    data = raw(spark, {"id": 1, "a": {"foo": 1}, "l": [{"foo": 2, "x": 3}]})
    s = shred.shred(data, except_keys=["foo"])
    assert rows(s.excepted["foo"])[0]["__except_path__"] == "a__foo" and rows(s.subs["l"]) == [{"id": 1, "l__x": 3}]
    assert not shred.shred(data, except_keys=["foo"], compat=True).excepted


def test_odd_keys_and_untyped(spark):
    s = shred.shred(raw(spark, {"id": 1, "@k": {"#t": "v"}, "x.y": 2, "q'\"": 3, "f": 1.5, "b": True}), typed=False)
    assert rows(s.main) == [{"id": 1, "@k__#t": "v", "b": "true", "f": "1.5", "q'\"": "3", "x__y": "2"}]


def test_empty_input(spark):
    s = shred.shred(raw(spark, {"id": 1}).where("false"))
    assert s.main.count() == 0 and not s.subs


def test_frame_helpers(spark):
    df = spark.createDataFrame([(1, None, "[]", ["a", "b"]), (2, None, "[]", ["a"])], "id int, e string, c__List string, tags array<string>")
    assert shred.prune_empty(df, "id").columns == ["id", "c__List", "tags"] and shred.drop_dummy_lists(df).columns == ["id", "e", "tags"]
    assert [r["tags__b"] for r in rows(shred.one_hot(df, "tags").orderBy("id"))] == [1, 0]
    assert shred.one_hot(df, "tags", 1).columns == df.columns


# --- drift


def test_drift_modes(spark):
    one, two = spark.createDataFrame([(1, "a")], "id int, x string"), spark.createDataFrame([(2, "b", 3)], "id int, x string, new int")
    shapes = {}
    for mode in ("evolve", "freeze", "hybrid"):
        state = drift.DriftState(mode)
        out = []
        for b in (one, two):
            state.start_batch()
            out.append(state.admit("t", b))
        shapes[mode] = rows(drift.union_merge(out).orderBy("id"))[1]
        assert drift.DriftState.from_dict(state.to_dict()) == state
    assert shapes["evolve"] == {"id": 2, "x": "b", "new": 3}
    assert shapes["freeze"] == shapes["hybrid"] == {"id": 2, "x": "b", "__extra__": '{"new":3}'}
    assert drift.pack_extra(one, ["x"]).first()["__extra__"] is None


# --- profiles


@pytest.mark.parametrize(
    ("kind", "stats", "normal", "compat"),
    [
        (T.LongType(), {"n": 1, "low": 0, "high": 1, "whole": True}, "BOOLEAN", "BOOLEAN"),
        (T.LongType(), {"n": 1, "low": 1950, "high": 2050, "whole": True}, "YEAR", "YEAR"),
        (T.LongType(), {"n": 1, "low": -(10**6), "high": 5, "whole": True}, "MEDIUMINT", "TINYINT"),
        (T.LongType(), {"n": 1, "low": 0, "high": 150, "whole": True}, "TINYINT UNSIGNED", "TINYINT UNSIGNED"),
        (T.DoubleType(), {"n": 1, "low": 0.5, "high": 1.5, "whole": False, "single": True}, "FLOAT", "DATETIME"),
        (T.DoubleType(), {"n": 0}, "Unknown", "BOOLEAN"),
        (T.StringType(), {"n": 0}, "Unknown", "Unknown"),
        (T.StringType(), {"n": 1, "longest": 0}, "Unknown", "Unknown"),
        (T.StringType(), {"n": 1, "longest": 1}, "VARCHAR(1)", "VARCHAR(1)"),
        (T.StringType(), {"n": 1, "longest": 70}, "TEXT", "TEXT"),
        (T.StringType(), {"n": 1, "longest": 70_000}, "MEDIUMTEXT", "MEDIUMTEXT"),
    ],
)
def test_types(kind, stats, normal, compat):
    assert (profile.infer_type(kind, stats), profile.infer_type(kind, stats, compat=True)) == (normal, compat)


def test_profile_and_ddl(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a", None) for i in range(2000)], "k int, s string, e string")
    p = {r["column"]: r for r in rows(profile.profile(df, ["s"]))}
    assert p["k"]["is_key"] and p["s"]["is_key"] and p["s"]["uniq"] == 2 and p["s"]["Coverage"] == 0.5 and p["e"]["Failed"]
    assert profile.create_table("t", p.values()) == "CREATE TABLE `t` (\n  `k` SMALLINT UNSIGNED NOT NULL,\n  `s` VARCHAR(1)\n)"
    assert profile.fit_row_size({"a": "VARCHAR(3000)", "b": "VARCHAR(64)"}) == {"a": "TEXT", "b": "VARCHAR(64)"}
    assert profile.profile(df.where("false")).count() == 3


# --- structure


def test_structure(spark):
    data = raw(spark, {"id": 1, "m": {"a": 1}, "l": [{"x": 1}, 2]}, {"id": 2, "m": 5})
    view = {r["path"]: r for r in rows(structure.union_view(data))}
    assert view["m"]["type_drift"] and view["l"]["cov_drift"] and view["l"]["list_max"] == 2 and view["l__x"]["depth"] == 2
    votes = spark.createDataFrame([("Value", "a", "", "p"), ("Dict", "a", "", "p")], "type string, dtype string, parent string, branch string")
    assert rows(structure.branch_vote(votes)) == [{"parent": "", "branch": "p", "type": "Dict"}]
    maps = raw(spark, *({"id": i, "high": {f"k{i}_{j}": j for j in range(3)}, "stable": {"a": 1}} for i in range(12)))
    assert [r["path"] for r in rows(structure.auto_except(structure.dict_path_stats(maps), 5, 10, 1.0))] == ["high"]
    text = spark.createDataFrame([(1, {"beta": [1], "alpha": [0], "delta": [3], "gamma": [2]})], "id int, idx map<string,array<int>>")
    assert structure.rebuild_text(text, "id", "idx").first()["text"] == "alpha beta gamma delta"


# --- sources


def test_sources(spark, tmp_path):
    (tmp_path / "02.jsonl").write_text('{"id":3}\n\nbroken\n{"id":4}\n[1]\n')
    with gzip.open(tmp_path / "01.jsonl.gz", "wt") as f:
        f.write('{"id":1}\n{"id":2}\n')
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("b.json", '[{"id":6},{"id":7}]')
        z.writestr("a.jsonl", '{"id":5}\n')
        z.writestr("c.xml", "<r><v k='1'>t</v><v>u</v></r>")
    (tmp_path / "d.json").write_text('{"data":[{"id":8}]}')
    o = config.Options.of(file_glob=str(tmp_path / "*"), records_key="data")
    got = rec.read_raw(spark, config.Options.of(file_glob=[str(tmp_path / "0*"), str(tmp_path / "z.zip"), str(tmp_path / "d.json")], records_key=None))
    ids = [(r["record_index"], r["j"]) for r in rows(got.records.select("record_index", F.to_json("v").alias("j")).orderBy("record_index"))]
    assert [i for i, _ in ids] == list(range(9)) and [json.loads(j).get("id") for _, j in ids] == [1, 2, 3, 4, 5, 6, 7, None, None]
    assert [(r["line_no"], r["raw"]) for r in rows(got.rejects)] == [(3, "broken")]
    assert rows(got.records.where("record_index = 3"))[0]["line_no"] == 4
    assert len(rec.resolve_sources(o)[0]) == 4 and rec.resolve_sources(config.Options.of(file_glob="/nowhere/*"))[1]
    with pytest.raises(FileNotFoundError):
        rec.resolve_sources(config.Options.of(file_names=["/nowhere"]))
    pick = config.Options.of(file_glob=str(tmp_path / "*"), sample_max_sources=2, sample_seed=7)
    assert rec.resolve_sources(pick, True) == rec.resolve_sources(pick, True) and len(rec.resolve_sources(pick, True)[0]) == 2
    left = rec.resume_after(got.records, {"source_path": str(tmp_path / "02.jsonl"), "line_no": 1})
    assert left.count() == 6 and rec.resume_after(got.records, {"source_path": "unknown"}).count() == 9


def test_xml_and_tables(spark, tmp_path):
    assert rec.dotted(rec.xml_record("<r><v k='1'>t</v></r>")) == {"r.v.@k": "1", "r.v.#text": "t"}
    df = rec.parse_xml(spark.createDataFrame([("<a><b>1</b></a>",), ("<broken",), (None,)], "x string"), "x")
    assert sorted(str(r[0]) for r in df.select(F.to_json("x")).collect()) == ["None", "None", '{"a.b":"1"}']
    (tmp_path / "t.csv").write_text("id,name\n1,a\n2,\n")
    t = tabular.read_table(spark, config.for_file(str(tmp_path / "t.csv"), config.Options()))
    assert t.count() == 2 and dict(t.dtypes)["id"] == "int"


# --- reports and reviews


def test_reports(spark, tmp_path):
    r = reports.RunReport()
    r.bump("n", 2)
    with r.timer("t"):
        pass
    r.exception("s", ValueError("x"))
    r.finish().save(f"{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text())["stats"] == {"n": 2}
    kind, shares = reports.bottleneck({"pipeline.json.total": 10000, "io.json_parse": 300, "json.flatten": 1200, "json.db.load": 7000, "db.alter": 900})
    assert kind == "db-load-bound-drift-ddl" and shares["load"] == 70
    assert reports.diff_reports({"stats": {"a": 1}}, {"stats": {"b": 2}})["stats"] == {"a": (1, 0, -1), "b": (0, 2, 2)}
    (tmp_path / "q.jsonl").write_text('{"stage":"s","exception_type":"E"}\nbad\n\n{"stage":"s"}\n')
    summary = reports.quarantine_report(spark, f"{tmp_path}/q.jsonl", f"{tmp_path}/out")
    assert (summary["total_entries"], summary["parse_errors"], summary["top"]["stage"]) == (2, 1, [["s", 2]])


def test_review(spark, tmp_path):
    names = ["w", "w__authorships", "w__authorships__i", "w__excepted__abstract_inverted_index", "w-SUB__x"]
    assert ("w__authorships", "w__authorships__i", "i") in review.table_edges("w", names)
    picture = review.svg("w", names)
    assert "authorships" in picture and "excepted/abstract_inverted_index" in picture and "1:N" in picture
    a = review.snapshot("t", {"t": spark.createDataFrame([(1, "x")], "a int, b string")})
    b = review.snapshot("t", {"t": spark.createDataFrame([(1, 2), (2, 2)], "a bigint, c int"), "u": spark.range(1)})
    d = review.diff_snapshots(spark, a, b)
    assert d["tables_added"] == ["u"] and d["tables_changed"]["t"] == {"cols_added": ["c"], "cols_removed": ["b"], "cols_type_changed": ["a"], "rows_after": 2, "rows_before": 1}
    assert "review.json" in review.write_pack(str(tmp_path), "t", {"t": spark.range(2).toDF("id")})


def test_scalars(spark):
    df = spark.createDataFrame([("a\tb\\", float("nan"), " NaN", "2024-01-02T03:04:05"), (None, 1.0, "x", "bad")], "s string, d double, n string, t string")
    got = rows(df.select(scalars.escape_field(F.col("s")).alias("e"), scalars.iso_datetime(F.col("t")).alias("t"), scalars.nan_to_null(F.col("n")).alias("n")))
    assert [tuple(r.values()) for r in got] == [("a\\tb\\\\", "2024-01-02 03:04:05", None), ("\\N", None, "x")]
    assert scalars.human_bytes(2048) == "2.0 KB" and scalars.quote_value("a'b") == "'a\\'b'"


# --- sinks, streaming, command line


def test_sinks(spark, tmp_path):
    one, two = spark.createDataFrame([(1, "a")], "id int, x string"), spark.createDataFrame([(2, "b", 3)], "id int, x string, y int")
    sinks.write_parquet({"t_mat": one}, f"{tmp_path}/p", 0)
    sinks.write_parquet({"t_mat": two}, f"{tmp_path}/p", 1)
    assert sinks.read_parquet(spark, f"{tmp_path}/p", "t_mat").count() == 2
    sinks.write_tsv(two, f"{tmp_path}/tsv")
    assert spark.read.text(f"{tmp_path}/tsv").first()[0] == "2\tb\t3"
    assert sinks.compact(spark, f"{tmp_path}/p/t_mat", f"{tmp_path}/c", "id") == 1
    sinks.drop_tables(spark, ["t_mat", "t_app"])
    assert sinks.materialize_artifacts(spark, f"{tmp_path}/p", f"{tmp_path}/progress.json") == {"t_mat": 2}
    assert sinks.materialize_artifacts(spark, f"{tmp_path}/p", f"{tmp_path}/progress.json") == {"t_mat": 0}
    assert [r["__extra__"] for r in rows(spark.table("t_mat").orderBy("id"))] == [None, '{"y":3}']
    for df in (one, two):
        sinks.save_table(df, naming.NameMap.build("t_app", df.columns))
    assert rows(spark.table("t_app").orderBy("id")) == [{"id": 1, "x": "a", "y": None}, {"id": 2, "x": "b", "y": 3}]
    sinks.drop_tables(spark, ["t_mat", "t_app"])


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id":1,"a":1}\n')
    o = config.Options.of(schema_mode="hybrid", table_name="b")
    loop.stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", o).awaitTermination()
    (tmp_path / "in" / "b.jsonl").write_text('{"id":2,"a":2,"new":5}\nbroken\n')
    loop.stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", o).awaitTermination()
    got = rows(sinks.read_parquet(spark, f"{tmp_path}/out", "b").orderBy("id"))
    assert [(r["id"], r["a"], r["__extra__"]) for r in got] == [("1", "1", None), ("2", "2", '{"new":"5"}')]


def test_cli(capsys):
    assert cli.main(["version"]) == 0 and cli.main(["modes"]) == 0 and cli.main(["table-name", "x"]) == 0
    assert "finalize" in capsys.readouterr().out


def test_save_table_widens_columns_that_do_not_fit(spark):
    spark.sql("DROP TABLE IF EXISTS t_wide")
    for rows in ([(1, 5)], [(2, None)]):
        df = spark.createDataFrame(rows, "id bigint, n int")
        sinks.save_table(df, naming.NameMap.build("t_wide", df.columns))
    df = spark.createDataFrame([(3, "seven"), (4, "8")], "id bigint, n string")
    sinks.save_table(df, naming.NameMap.build("t_wide", df.columns))
    assert {(r.id, r.n) for r in spark.table("t_wide").collect()} == {(1, "5"), (2, None), (3, "seven"), (4, "8")}
    sinks.drop_tables(spark, ["t_wide"])


def test_run_json_options(spark, tmp_path):
    import json

    from shredloom import run

    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"id": i, "map": {f"k{i}_{j}": j for j in range(3)}, "stable": {"a": 1}, "items": [{"x": i}]}) for i in range(30)) + "\nnot json\n")
    config = {"file_glob": f"{tmp_path}/*.jsonl", "table_name": "b", "auto_except": True, "auto_except_unique_keys": 10, "auto_except_min_observations": 5, "auto_except_novelty": 1.0}
    report = run.run_json(spark, {**config, "out_path": f"{tmp_path}/o", "persist_tsv_files": True, "json_streaming_load": True})
    assert report.artifacts["except_keys"] == ["map"] and report.stats["records_read"] == 30 and report.stats["tsv_files_persisted"] == 3
    assert set(report.artifacts["columns"]) == {"b", "b__items", "b__excepted__map"}
    cursor = {"resume_cursor": {"source_path": str(tmp_path / "a.jsonl"), "line_no": 25}, "out_path": f"{tmp_path}/r"}
    assert run.run_json(spark, {**config, **cursor}).stats["records_read"] == 5
    own = run.run_json(spark, config, extract=lambda records, options: {"mine": records.select("record_index")}, out_path=f"{tmp_path}/x")
    assert own.stats == {"tables_total": 1, "rows_emitted": 30} and own.artifacts["columns"] == {"mine": ["record_index"]}
    with pytest.raises(ValueError, match="frozen"):
        run.run_json(spark, config, "ingest-fast-freeze", schema_alter=True)
