"""Queries over the test tables, one or more for each operator, with the SQL to check them.

Nested input is made from the flat tables (orders with their line items as JSON, and so on), shredded, and compared with the
flat tables. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shredloom.functions import scalars
from shredloom.operators import drift, profile, reports, review, shred, structure
from shredloom.session import materialize, table
from shredloom.sources.records import raw_from_json, resume_after, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _pieces(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records {id, hdr: {...}, parts: [...], items: [{...}]}, one for each order; numbered by its key."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_returnflag", F.struct(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("l_shipdate"), "l_linestatus").alias("ship"), F.array("l_suppkey", "l_partkey").alias("refs")))).alias("items")
    )
    # made and parsed by all cores, however few files there are; by the key of the join, so that nothing is shuffled for it
    orders = table(spark, sf_dir, "orders").repartition(_pieces(spark), "o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    record = F.struct(
        F.col("o_orderkey").alias("id"), F.struct("o_orderstatus", "o_totalprice", "o_orderpriority", "o_custkey").alias("hdr"), F.transform("items", lambda x: x["l_partkey"]).alias("parts"), F.col("items")
    )
    return raw_from_json(orders.select("o_orderkey", F.to_json(record).alias("j")), "j", "o_orderkey", "orders.jsonl")


def shredded_orders(spark: SparkSession, sf_dir: str, **options: Any) -> shred.Shredded:
    """:func:`nested_orders`, written as the inventory and each table read them, and shredded."""
    return shred.shred(written(nested_orders(spark, sf_dir)), **options)


@query("SELECT o_orderkey AS id, o_orderstatus AS hdr__o_orderstatus, o_totalprice AS hdr__o_totalprice, o_orderpriority AS hdr__o_orderpriority, o_custkey AS hdr__o_custkey FROM orders")
def shred_main_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredded_orders(spark, sf_dir).main


@query(
    """SELECT l_orderkey AS id, l_linenumber AS items__l_linenumber, l_partkey AS items__l_partkey, l_quantity AS items__l_quantity, l_tax AS items__l_tax, l_returnflag AS items__l_returnflag
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
)
def shred_sub_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_returnflag")
    return shredded_orders(spark, sf_dir).subs["items"].select("id", *[f"items__{n}" for n in names])


@query("SELECT l_orderkey AS id, l_partkey AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def shred_scalar_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredded_orders(spark, sf_dir).subs["parts"]


@query("SELECT l_orderkey AS id, l_linestatus AS items__ship__l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS items__ship__l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def shred_item_nested_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredded_orders(spark, sf_dir).subs["items"].select("id", "items__ship__l_linestatus", "items__ship__l_shipdate")


@query("SELECT l_orderkey AS id, l_linenumber AS items__l_linenumber, l_suppkey AS first, l_partkey AS second FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def shred_item_nested_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = shredded_orders(spark, sf_dir).subs["items"]
    cell = F.from_json("items__refs", "array<bigint>")
    return items.select("id", "items__l_linenumber", cell[0].alias("first"), cell[1].alias("second"))


@query(
    """SELECT c.c_custkey AS id, o.o_orderkey AS orders__k FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey"""
)
def shred_empty_and_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders hold an empty list, and give no row."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.lit(None).cast("int").alias("never"))).alias("orders"))
    joined = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    record = F.struct(F.col("c_custkey").alias("id"), F.coalesce("orders", F.array().cast("array<struct<k:bigint,never:int>>")).alias("orders"), F.lit(None).cast("string").alias("nothing"))
    raw = raw_from_json(joined.select("c_custkey", F.to_json(record, {"ignoreNullFields": "false"}).alias("j")), "j", "c_custkey")
    return shred.shred(raw).subs["orders"]


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose ``x`` is a number, an object, or a list, by the key."""
    k = F.col("n_nationkey")
    text = F.when(k % 3 == 0, F.format_string('{"id":%d,"x":%d}', k, k)).when(k % 3 == 1, F.format_string('{"id":%d,"x":{"name":"%s"}}', k, F.col("n_name")))
    text = text.otherwise(F.format_string('{"id":%d,"x":[{"r":%d},7]}', k, F.col("n_regionkey")))
    return raw_from_json(table(spark, sf_dir, "nation").select(k.cast("bigint").alias("k"), text.alias("j")), "j", "k")


@query(
    """SELECT CAST(n_nationkey AS BIGINT) AS id, 'main' AS tab, CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey AS BIGINT) END AS x, CASE WHEN n_nationkey % 3 = 1 THEN n_name END AS name, CAST(NULL AS BIGINT) AS r FROM nation
    UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'sub', NULL, NULL, CAST(n_regionkey AS BIGINT) FROM nation WHERE n_nationkey % 3 = 2"""
)
def shred_mixed_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shred.shred(_mixed(spark, sf_dir))
    main = s.main.select("id", F.lit("main").alias("tab"), "x", F.col("x__name").alias("name"), F.lit(None).cast("bigint").alias("r"))
    return main.unionByName(s.subs["x"].select("id", F.lit("sub").alias("tab"), F.lit(None).cast("bigint").alias("x"), F.lit(None).cast("string").alias("name"), F.col("x__r").alias("r")))


@query("SELECT o_orderkey AS id, 'hdr' AS path, 'dict' AS kind, o_orderstatus AS status, o_custkey AS cust, o_orderkey AS rec FROM orders")
def except_full_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = shredded_orders(spark, sf_dir, except_keys=["hdr"]).excepted["hdr"]
    return e.select(
        "id", F.col("__except_path__").alias("path"), F.col("__except_raw_type__").alias("kind"), F.get_json_object("value", "$.o_orderstatus").alias("status"),
        F.get_json_object("__except_raw_json__", "$.o_custkey").cast("bigint").alias("cust"), F.col("__record_index__").alias("rec"),
    )


@query("SELECT o_orderkey AS id, 'hdr__o_custkey' AS path, 'int' AS kind, CAST(o_custkey AS VARCHAR) AS value FROM orders")
def except_bare_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bare name that is nested keeps its payload."""
    e = shredded_orders(spark, sf_dir, except_keys=["o_custkey"]).excepted["o_custkey"]
    return e.select("id", F.col("__except_path__").alias("path"), F.col("__except_raw_type__").alias("kind"), "value")


@query("SELECT o_orderkey AS id, o_orderstatus, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def except_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredded_orders(spark, sf_dir, except_keys=["hdr"], expand=True).excepted["hdr"].select("id", "o_orderstatus", "o_custkey")


@query("SELECT l_orderkey AS id, l_linenumber AS items__l_linenumber, l_quantity AS items__l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def except_in_list_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = shredded_orders(spark, sf_dir, except_keys=["l_tax", "ship", "refs", "l_partkey", "l_returnflag"]).subs["items"]
    return items


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """Dense numbers in the order of a unique key: sorted by range, so that only counts of ranges are summed in one place.

    The ranges are written, as every run of a plan may sample and join them otherwise.
    """
    parted = materialize(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "ranges")
    inner = parted.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(key)))
    counts = parted.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return inner.join(before, "__part").withColumn("record_index", F.col("__in") - 1 + F.col("__before")).drop("__part", "__in", "__before")


@query(
    """SELECT CASE WHEN o_orderkey % 7 = 0 THEN CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS VARCHAR) ELSE 'k' || o_orderkey END AS id, o_custkey AS c FROM orders"""
)
def id_fallback_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 14 == 0, F.format_string('{"c":%d}', F.col("o_custkey"))).when(k % 7 == 0, F.format_string('{"id":"","c":%d}', F.col("o_custkey"))).otherwise(F.format_string('{"id":"k%d","c":%d}', k, F.col("o_custkey")))
    orders = _numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return shred.shred(raw_from_json(orders.select("record_index", text.alias("j")), "j", "record_index")).main


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS props__k FROM events")
def events_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"id":'), "event_id", F.lit(',"props":'), "props", F.lit("}")).alias("j"))
    return shred.shred(raw_from_json(events, "j", "event_id")).main


@query("SELECT conv_id AS id, turn AS turns__turn, role AS turns__role, text AS turns__text FROM conversations")
def conversations_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    raw = raw_from_json(talks.select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("id"), "turns")).alias("j")), "j", "conv_id")
    return shred.shred(raw).subs["turns"]


@query("SELECT vec_id AS id, count(*) AS n, round(sum(CAST(x AS DOUBLE)), 3) AS total FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
def shred_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    raw = raw_from_json(e.select("vec_id", F.to_json(F.struct(F.col("vec_id").alias("id"), "embedding")).alias("j")), "j", "vec_id")
    return shred.shred(raw).subs["embedding"].groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("embedding").cast("double")), 3).alias("total"))


@query("SELECT o_orderkey AS id, o_orderstatus AS hdr_o_orderstatus, o_totalprice AS hdr_o_totalprice, o_orderpriority AS hdr_o_orderpriority, o_custkey AS hdr_o_custkey FROM orders")
def rename_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.simplify_names(shredded_orders(spark, sf_dir).main)


@query("SELECT l_orderkey AS id, l_linenumber, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def rename_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.simplify_names(shredded_orders(spark, sf_dir).subs["items"], "items").select("id", "l_linenumber", "l_returnflag")


@query("SELECT o_orderkey AS id, o_orderstatus AS hdr__o_orderstatus, l_linenumber AS items__l_linenumber, l_quantity AS items__l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def rejoin_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shredded_orders(spark, sf_dir)
    return shred.rejoin(s.main.select("id", "hdr__o_orderstatus"), [s.subs["items"].select("id", "items__l_linenumber", "items__l_quantity")])


@query("SELECT o_orderkey AS id, o_totalprice AS hdr__o_totalprice, l_linenumber AS items__l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def rejoin_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shredded_orders(spark, sf_dir)
    return s.main.join(s.subs["items"].where("items__l_returnflag = 'R'"), "id").select("id", "hdr__o_totalprice", "items__l_linenumber")


@query(
    """SELECT l_orderkey AS id, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS flags__A, max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS flags__N, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS flags__R FROM lineitem GROUP BY l_orderkey"""
)
def onehot_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_returnflag").alias("flags"))
    return shred.one_hot(lists, "flags")


# --- drift


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two batches of orders, the second with a column that the first hasn't."""
    orders = table(spark, sf_dir, "orders")
    first = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return first, orders.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"))


def _through(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    state = drift.DriftState(mode)
    out = []
    for batch in _halves(spark, sf_dir):
        state.start_batch()
        out.append(state.admit("orders", batch))
    return drift.union_merge(out)


_EXTRA = "SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS extra_cust FROM orders"


@query(_EXTRA)
def freeze_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "freeze").select("id", "status", F.get_json_object("__extra__", "$.cust").cast("bigint").alias("extra_cust"))


@query(_EXTRA)
def hybrid_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "hybrid").select("id", "status", F.get_json_object("__extra__", "$.cust").cast("bigint").alias("extra_cust"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS cust FROM orders")
def evolve_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, "evolve")


@query("SELECT * FROM (VALUES ('three of forty missing', true), ('share of 0.79', false), ('share of 0.8', true), ('too wide', false)) AS t(case_name, eligible)")
def union_merge_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = [f"c{i}" for i in range(400)]
    cases = [
        ("three of forty missing", drift.merge_eligible([wide[:40], wide[:37]])), ("share of 0.79", drift.merge_eligible([wide[:200], wide[:158]])),
        ("share of 0.8", drift.merge_eligible([wide[:200], wide[:160]])), ("too wide", drift.merge_eligible([wide[:257], wide[:257]])),
    ]
    return spark.createDataFrame(cases, "case_name string, eligible boolean")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def column_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("unknown"))
    return drift.intersection(nation, ["id", "name", "absent"])[0]


# --- profiles


def _profile_sql(name: str, columns: dict[str, str]) -> str:
    parts = []
    for c, kind in columns.items():
        number = kind == "number"
        mean, std = (f"round(avg(CAST({c} AS DOUBLE)), 4)", f"round(stddev_samp(CAST({c} AS DOUBLE)), 4)") if number else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) / count(*) AS coverage, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS uniq, {mean} AS mean, {std} AS std, "
            f"round((SELECT max(n) FROM (SELECT count(*) AS n FROM {name} GROUP BY {c})) / count(*), 8) AS freq FROM {name}"
        )
    return " UNION ALL ".join(parts)


def _profiled(df: DataFrame) -> DataFrame:
    return profile.profile(df).select("column", F.col("Coverage").alias("coverage"), "uniq", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("freq", 8).alias("freq"))


_LINEITEM = {"l_orderkey": "number", "l_linenumber": "number", "l_quantity": "number", "l_discount": "number", "l_returnflag": "text", "l_shipdate": "date"}
_ORDERS = {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_orderdate": "date", "o_orderpriority": "text"}
_CUSTOMER = {"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_mktsegment": "text"}


@query(_profile_sql("lineitem", _LINEITEM))
def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(table(spark, sf_dir, "lineitem").select(*_LINEITEM))


@query(_profile_sql("orders", _ORDERS))
def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(table(spark, sf_dir, "orders").select(*_ORDERS))


@query(_profile_sql("customer", _CUSTOMER))
def profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(table(spark, sf_dir, "customer").select(*_CUSTOMER))


def _entropy_sql(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}.{c}' AS \"column\", round(-sum(p * log2(p)), 6) AS entr FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM {name} WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) NOT IN ('', '-1', '-1.0') GROUP BY {c})" for c in columns
    )


@query(_entropy_sql("lineitem", ["l_returnflag", "l_linenumber", "l_suppkey"]) + " UNION ALL " + _entropy_sql("events", ["event_type", "user_id"]))
def entropy_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [profile.spread(table(spark, sf_dir, t).select(*cs)).select(F.concat(F.lit(f"{t}."), "column").alias("column"), F.round("entr", 6).alias("entr")) for t, cs in (("lineitem", ["l_returnflag", "l_linenumber", "l_suppkey"]), ("events", ["event_type", "user_id"]))]
    return parts[0].unionByName(parts[1])


def _key_sql(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) / count(*) > 0.999 AND (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) / count(*) > 0.5 AND (SELECT max(n) FROM (SELECT count(*) AS n FROM {name} GROUP BY {c})) / count(*) < 0.001 AS is_key FROM {name}" for c in columns
    )


@query(_key_sql("orders", list(_ORDERS)) + " UNION ALL " + _key_sql("customer", list(_CUSTOMER)))
def key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of orders and customers; with fewer than 1000 rows nothing can be a key."""
    parts = [profile.profile(table(spark, sf_dir, t).select(*cs)).select("column", "is_key") for t, cs in (("orders", _ORDERS), ("customer", _CUSTOMER))]
    return parts[0].unionByName(parts[1])


def _type_sql(name: str, columns: dict[str, str]) -> str:
    def text(c: str) -> str:
        room = f"CAST(floor(max(length({c})) * 1.5) AS BIGINT)"
        return f"CASE WHEN {room} <= 64 THEN 'VARCHAR(' || CAST(CAST(pow(2, ceil(log2({room}))) AS BIGINT) AS VARCHAR) || ')' WHEN {room} <= 65535 THEN 'TEXT' WHEN {room} <= 16777215 THEN 'MEDIUMTEXT' ELSE 'LONGTEXT' END"

    def whole(c: str) -> str:
        low, high = f"min({c})", f"max({c})"
        ladder = " ".join(f"WHEN {low} >= 0 AND {2 * (2 ** (8 * b - 1) - 1)} > {high} * 1.5 THEN '{t} UNSIGNED' WHEN {low} < 0 AND {2 ** (8 * b - 1) - 1} > greatest({high}, -{low}) * 1.5 THEN '{t}'" for t, b in profile.INTEGERS)
        return f"CASE WHEN {low} > 1900 AND {high} < 2100 THEN 'YEAR' WHEN {low} = 0 AND {high} = 1 THEN 'BOOLEAN' {ladder} ELSE 'BIGINT' END"

    def number(c: str) -> str:
        return f"CASE WHEN bool_and({c} % 1 = 0) THEN {whole(c)} WHEN bool_and(CAST(CAST({c} AS FLOAT) AS DOUBLE) = {c}) THEN 'FLOAT' ELSE 'DOUBLE' END"

    made = {"text": text, "whole": whole, "number": number, "date": lambda c: f"max(CASE WHEN {c} IS NOT NULL THEN 'DATETIME' END)"}
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {made[k](c)} AS sql_type FROM {name}" for c, k in columns.items())


_TYPED = {
    "orders": {"o_orderkey": "whole", "o_custkey": "whole", "o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "date", "o_orderpriority": "text"},
    "lineitem": {"l_linenumber": "whole", "l_quantity": "number", "l_discount": "number", "l_returnflag": "text"},
    "customer": {"c_custkey": "whole", "c_name": "text", "c_acctbal": "number"},
    "part": {"p_partkey": "whole", "p_name": "text", "p_size": "whole"},
    "labels": {"quality": "whole", "toxic": "whole"},
    "pages": {"url": "text", "html": "text"},
    "documents": {"text": "text", "lang": "text"},
}


@query(" UNION ALL ".join(_type_sql(t, cs) for t, cs in _TYPED.items()))
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for t, cs in _TYPED.items():
        df = table(spark, sf_dir, t).select(*cs)
        stats = profile.aggregate_columns(df)
        rows += [(f.name, profile.infer_type(f.dataType, stats[f.name])) for f in df.schema]
    return spark.createDataFrame(rows, "column string, sql_type string")


@query(f"SELECT \"column\", '`' || \"column\" || '` ' || sql_type || ' NOT NULL' AS line FROM ({_type_sql('orders', _TYPED['orders'])})")
def ddl_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(*_TYPED["orders"])
    ddl = profile.create_table("orders", [r.asDict() for r in profile.profile(df).collect()])
    lines = [x.strip().rstrip(",") for x in ddl.splitlines()[1:-1]]
    return spark.createDataFrame([(x.split("`")[1], x) for x in lines], "column string, line string")


# --- structure

_PAIRS = """SELECT * FROM (VALUES ('Value', 'dict', '', 'id'), ('Dict', 'dict', '', 'hdr'), ('Value', 'dict', 'hdr', 'hdr__o_orderstatus'), ('Value', 'dict', 'hdr', 'hdr__o_totalprice'),
 ('Value', 'dict', 'hdr', 'hdr__o_orderpriority'), ('Value', 'dict', 'hdr', 'hdr__o_custkey'), ('List of Value', 'dict', '', 'parts'), ('List of Dict', 'dict', '', 'items'), ('List', 'list', 'items', 'items__List'),
 ('Value in List of Dict', 'list', 'items', 'items__l_linenumber'), ('Value in List of Dict', 'list', 'items', 'items__l_partkey'), ('Value in List of Dict', 'list', 'items', 'items__l_quantity'),
 ('Value in List of Dict', 'list', 'items', 'items__l_tax'), ('Value in List of Dict', 'list', 'items', 'items__l_returnflag'), ('Value in List of Dict', 'list', 'items', 'items__ship'), ('Value in List of Dict', 'list', 'items', 'items__refs'),
 ('Value', 'dict', 'items__ship', 'items__ship__l_shipdate'), ('Value', 'dict', 'items__ship', 'items__ship__l_linestatus'), ('List', 'list', 'items__refs', 'items__refs__List')) AS t(type, dtype, parent, branch)"""


@query(_PAIRS)
def key_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.key_pairs(nested_orders(spark, sf_dir))


@query(f"SELECT parent, branch, type FROM ({_PAIRS})")
def branch_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.branch_vote(structure.key_pairs(nested_orders(spark, sf_dir)))


@query(
    "SELECT 'hdr' AS path, count(*) AS observations, 4 * count(*) AS dict_keys_total, 4 AS unique_keys FROM orders UNION ALL SELECT 'items', count(*), 7 * count(*), 7 FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "UNION ALL SELECT 'items__ship', count(*), 2 * count(*), 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
)
def dict_path_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.dict_path_stats(nested_orders(spark, sf_dir))


def _inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw records {id, idx: {word: [positions]}}; a word is what spaces and line breaks divide."""
    # texts are shuffled once; all their words stay where they are
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(_pieces(spark), "doc_id")
    docs = texts.select("doc_id", F.posexplode(F.split("text", r"[ \n]+")).alias("at", "w")).where("w <> ''")
    words = docs.groupBy("doc_id", "w").agg(F.array_sort(F.collect_list("at")).alias("at"))
    maps = words.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("idx"))
    return maps


@query(
    """WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[ \n]+')) AS w FROM documents), k AS (SELECT doc_id, w FROM w WHERE w <> '')
    SELECT 'idx' AS path, count(DISTINCT doc_id) AS observations, count(*) AS dict_keys_total, count(DISTINCT w) AS unique_keys FROM k"""
)
def auto_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _inverted(spark, sf_dir).select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "idx")).alias("j"))
    found = structure.auto_except(structure.dict_path_stats(raw_from_json(maps, "j", "doc_id")))
    return found.select("path", "observations", "dict_keys_total", "unique_keys")


@query(
    """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \n]+')) AS w, unnest(range(len(regexp_split_to_array(text, '[ \n]+')))) AS pos FROM documents)
    SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS text, count(*) AS tokens FROM w WHERE w <> '' GROUP BY doc_id"""
)
def rebuild_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.rebuild_text(_inverted(spark, sf_dir), "doc_id", "idx").select("doc_id", "text", "tokens")


_VIEW = """SELECT * FROM (VALUES ('id', 'value', 25, 1.0, false, false, 0), ('x', 'value', 25, 1.0, true, false, 2), ('x__name', 'value', 8, 0.32, false, true, 0), ('x__r', 'value', 8, 0.32, false, true, 0)) AS t(path, kind, present, coverage, type_drift, cov_drift, n_children)"""


@query(f"SELECT path, kind, CAST(present AS BIGINT) AS present, CAST(coverage AS DOUBLE) AS coverage, type_drift, cov_drift, n_children FROM ({_VIEW})")
def union_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.union_view(_mixed(spark, sf_dir)).select("path", "kind", "present", "coverage", "type_drift", "cov_drift", "n_children")


@query(f"SELECT path, CAST(present AS BIGINT) AS present FROM ({_VIEW}) ORDER BY present DESC, path LIMIT 3")
def top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.union_view(_mixed(spark, sf_dir)).orderBy(F.desc("present"), "path").limit(3).select("path", "present")


@query("SELECT * FROM (VALUES ('hdr', 'missing_excepted'), ('hdr__o_orderstatus', 'missing_excepted'), ('hdr__o_totalprice', 'missing_excepted'), ('hdr__o_orderpriority', 'missing_excepted'), ('hdr__o_custkey', 'missing_excepted'), ('items__ship', 'missing')) AS t(path, status)")
def raw_vs_flat_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = written(nested_orders(spark, sf_dir))
    s = shred.shred(raw, except_keys=["hdr"])
    flat = sorted({c for cs in s.plan.columns().values() for c in cs} | set(s.subs))
    return structure.key_diff(structure.raw_paths(raw), spark.createDataFrame([(c,) for c in flat], "path string"), ["hdr"])


# --- scalar functions


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS price FROM part")
def nan_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 5 == 0, " NaN ").otherwise(F.col("p_name")).alias("name"), F.when(k % 3 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("price"))
    return scalars.sanitise_nan(part)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS day FROM orders")
def datetime_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 10 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.iso_datetime(text).alias("day"))


@query("SELECT page_id, trim(regexp_replace(url, '[^0-9A-Za-z]+', '_', 'g'), '_') AS name FROM pages")
def sanitize_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.identifier(F.col("url")).alias("name"))


@query("SELECT doc_id, CASE WHEN length(text) > 160 THEN substr(text, 1, 159) || '…' ELSE text END AS shown FROM documents")
def clipped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.clip(F.col("text")).alias("shown"))


@query(r"SELECT doc_id, replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't'), chr(10), chr(92) || 'n') AS field FROM documents")
def escaped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.escape_field(F.col("text")).alias("field"))


@query("SELECT page_id, regexp_replace(html, '<(/?)(p|sub|sup|i|b)>', '%_lt_;\\1\\2%_gt_;', 'g') AS html FROM pages")
def shielded_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.shield_html(F.col("html")).alias("html"))


# --- reports and reviews


def _quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log entry for each document: its source is the stage, its language the exception; every 50th line is broken."""
    entry = F.to_json(F.struct(F.format_string("2026-01-01T%08d", "doc_id").alias("timestamp"), F.col("source").alias("stage"), F.col("lang").alias("exception_type"), F.col("doc_id").alias("index")))
    return table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 50 == 7, "{broken").otherwise(entry).alias("value"))


@query(
    """WITH e AS (SELECT source, lang FROM documents WHERE doc_id % 50 <> 7), c AS (SELECT 'stage' AS kind, source AS key, count(*) AS n FROM e GROUP BY source UNION ALL SELECT 'exception_type', lang, count(*) FROM e GROUP BY lang
    UNION ALL SELECT 'stage_exception', source || '::' || lang, count(*) FROM e GROUP BY source, lang) SELECT kind, key, n FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) <= 50"""
)
def quarantine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quarantine_counts(reports.parse_quarantine(_quarantine(spark, sf_dir)))


@query("SELECT source AS stage, doc_id AS idx FROM documents WHERE doc_id % 50 <> 7 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3")
def quarantine_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quarantine_samples(reports.parse_quarantine(_quarantine(spark, sf_dir))).select("stage", F.col("index").cast("bigint").alias("idx"))


@query("SELECT count(*) FILTER (doc_id % 50 <> 7) AS entries, count(*) FILTER (doc_id % 50 = 7) AS parse_errors FROM documents")
def quarantine_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = reports.parse_quarantine(_quarantine(spark, sf_dir))
    return e.agg(F.count(F.when(F.col("ok"), 1)).alias("entries"), F.count(F.when(~F.col("ok"), 1)).alias("parse_errors"))


@query(
    """WITH a AS (SELECT event_type AS key, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS key, count(*) AS n FROM events WHERE user_id % 3 = 0 AND event_type <> 'view' GROUP BY 1)
    SELECT coalesce(a.key, b.key) AS key, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.key = b.key"""
)
def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    count = lambda df: df.groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("value"))
    return reports.diff_counts(count(e.where("user_id % 2 = 0")), count(e.where("user_id % 3 = 0 AND event_type <> 'view'")))


@query("SELECT source AS \"table\", count(*) FILTER (lang = 'en') AS error, count(*) FILTER (lang = 'fr') AS warning, count(*) AS total FROM documents GROUP BY source")
def issues_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = table(spark, sf_dir, "documents").select(F.col("source").alias("table"), F.when(F.col("lang") == "en", "error").when(F.col("lang") == "fr", "warning").otherwise("info").alias("level"))
    return reports.issue_counts(issues).select("table", "error", "warning", "total")


@query("SELECT * FROM (VALUES ('load', 'db-load-bound-drift-ddl'), ('flatten', 'flatten-bound'), ('parse', 'parse-bound'), ('finalize', 'finalize-bound'), ('even', 'mixed')) AS t(case_name, bottleneck)")
def bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = {"pipeline.json.total": 10000}
    cases = {"load": {"json.db.load": 7000, "db.alter": 900}, "flatten": {"json.flatten": 5000}, "parse": {"io.json_parse": 3500}, "finalize": {"json.db.index": 2000, "json.db.optimize": 1500}, "even": {"json.flatten": 4000}}
    return spark.createDataFrame([(k, reports.bottleneck({**total, **v})[0]) for k, v in cases.items()], "case_name string, bottleneck string")


@query(
    """SELECT * FROM (VALUES ('nation', 'n_comment', 'removed'), ('nation', 'n_regionkey', 'type_changed'), ('nation', 'n_extra', 'added'), ('region', NULL, 'table_removed'), ('part', NULL, 'table_added')) AS t("table", "column", change)"""
)
def review_diff_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = [("nation", "n_nationkey", "INT"), ("nation", "n_regionkey", "INT"), ("nation", "n_comment", "TEXT"), ("region", "r_regionkey", "INT")]
    after = [("nation", "n_nationkey", "INT"), ("nation", "n_regionkey", "BIGINT"), ("nation", "n_extra", "TEXT"), ("part", "p_partkey", "INT")]
    kind = "table string, column string, type string"
    return review.diff_columns(spark.createDataFrame(before, kind), spark.createDataFrame(after, kind))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.row_counts({t: table(spark, sf_dir, t) for t in _TABLES})


@query(
    "SELECT 0 AS depth, 1 AS tables, (SELECT count(*) FROM orders) AS n UNION ALL SELECT 1, 2, 2 * (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)
def depth_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.depth_groups(review.row_counts(shredded_orders(spark, sf_dir).tables("orders")), "orders")


@query("SELECT * FROM (VALUES ('orders', 'orders__items', 'items'), ('orders', 'orders__parts', 'parts')) AS t(parent, child, label)")
def table_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(review.table_edges("orders", shredded_orders(spark, sf_dir).tables("orders")), "parent string, child string, label string")


# --- scans


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey > 99")
def resume_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After line 100 + 1; the line of an order is its key + 1."""
    left = resume_after(nested_orders(spark, sf_dir), {"source_path": "orders.jsonl", "line_no": 101}, backtrack=1)
    return left.select(F.col("record_index").alias("id"))


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS record_index FROM orders QUALIFY record_index < 500")
def record_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit is a filter on the dense number, so that it keeps the first records."""
    return _numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").where("record_index < 500").select(F.col("o_orderkey").alias("id"), "record_index")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal entries the first stays."""
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
