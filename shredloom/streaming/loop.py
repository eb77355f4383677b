"""Micro-batches of JSON Lines: shred each batch, follow drift across batches, write every batch exactly once.

The state (columns, frozen columns, name maps) is a JSON file keyed by the batch after which it holds. A batch that is repeated
after a failure starts from the state before it and overwrites its own folder, so nothing is written twice.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shredloom.config import Options
from shredloom.naming import NameMap
from shredloom.operators.drift import DriftState
from shredloom.operators.shred import shred
from shredloom.operators.sinks import write_parquet


class StateStore:
    """JSON files ``state-<batch>.json``; the newest before a batch is what it starts from."""

    def __init__(self, folder: str) -> None:
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def before(self, batch: int) -> dict | None:
        found = sorted((int(p.stem.split("-")[1]), p) for p in self.folder.glob("state-*.json"))
        older = [p for n, p in found if n < batch]
        return json.loads(older[-1].read_text()) if older else None

    def save(self, batch: int, state: dict) -> None:
        part = self.folder / f"state-{batch}.part"
        part.write_text(json.dumps(state))
        part.replace(self.folder / f"state-{batch}.json")


def load_batch(lines: DataFrame, batch: int, options: Options, out: str, store: StateStore) -> dict[str, list[str]]:
    """Shred one batch of text lines and write its tables; returns the columns of each table."""
    base = options.table_name or "base"
    known = store.before(batch) or {"drift": None, "records": 0, "names": {}}
    state = DriftState.from_dict(known["drift"]) if known["drift"] else DriftState(options.schema_mode, options.schema_hybrid_warmup_batches, options.extra_column_name, options.index_key)
    state.start_batch()
    parsed = lines.select("value", F.try_parse_json("value").alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    order = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))  # a micro-batch is small by its trigger
    records = parsed.select((order - 1 + known["records"]).cast("bigint").alias("record_index"), "v").persist()
    try:
        n = records.count()
        tables = shred(records, options.index_key, options.except_keys, options.KEY_SEP, typed=False, expand=options.excepted_expand_dict, compat=options.compat).tables(base)
        shaped = {t: state.admit(t, df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])) for t, df in tables.items()}
        write_parquet(shaped, out, batch)
        names = {t: (NameMap.from_dict(known["names"][t]) if t in known["names"] else NameMap.build(t, (), options.KEY_SEP)).extended(df.columns).to_dict() for t, df in shaped.items()}
        store.save(batch, {"drift": state.to_dict(), "records": known["records"] + n, "names": {**known["names"], **names}})
    finally:
        records.unpersist()
    return {t: df.columns for t, df in shaped.items()}


def stream(spark: SparkSession, folder: str, out: str, checkpoint: str, options: Options | None = None, files_per_batch: int = 1):  # noqa: ANN201
    """Start a query over the JSON Lines files of a folder that takes what is there, then ends; run again for what is new."""
    options = options or Options()
    store = StateStore(f"{checkpoint}/schema")
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    writer = lines.writeStream.foreachBatch(lambda df, n: load_batch(df, n, options, out, store) and None)
    return writer.option("checkpointLocation", f"{checkpoint}/spark").trigger(availableNow=True).start()
