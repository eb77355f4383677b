"""Options, their defaults and aliases, mode presets, and the combinations that are refused."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from pathlib import PurePath
from typing import Any

ALIASES = {"FILE_SEP": "SEP", "save_local_files": "persist_parquet_files", "save_local_dir": "persist_parquet_dir"}
MODES_OF_SCHEMA = {"evolve": "evolve", "freeze": "freeze", "frozen": "freeze", "hybrid": "hybrid", "evolve_then_freeze": "hybrid", "evolve-then-freeze": "hybrid", "warmup_freeze": "hybrid"}


@dataclass
class Options:
    """What a run reads and how it shapes it; ``extra`` keeps keys that are not known."""

    file_name: str | None = None
    file_names: list[str] = field(default_factory=list)
    file_glob: str | list[str] | None = None
    file_type: str | None = None
    table_name: str | None = None
    out_path: str | None = None
    records_key: str | None = None
    zip_members: list[str] = field(default_factory=list)
    SEP: str = "\t"
    KEY_SEP: str = "__"
    index_key: str = "id"
    KEYs: list[str] = field(default_factory=list)
    except_keys: list[str] = field(default_factory=list)
    excepted_expand_dict: bool = False
    chunk_size: int = 1000
    max_records: int | None = None
    sample_max_sources: int | None = None
    sample_seed: int = 42
    schema_mode: str = "evolve"
    schema_hybrid_warmup_batches: int = 1
    extra_column_name: str = "__extra__"
    fallback_column_type: str = "LONGTEXT"
    index_prefix_len: int = 191
    insert_retry_max: int = 5
    auto_except: bool = False
    auto_except_sample_records: int = 5000
    auto_except_sample_sources: int = 64
    auto_except_seed: int = 42
    auto_except_unique_keys: int = 512
    auto_except_min_observations: int = 20
    auto_except_novelty: float = 2.0
    persist_parquet_files: bool = True
    persist_parquet_dir: str | None = None
    persist_tsv_files: bool = False
    json_streaming_load: bool = False
    parallel_workers: int = 0
    db_load_parallel_tables: int = 0
    tsv_merge_union_schema: bool = False
    overlap_batches: bool = False
    load_method: str = "auto"
    fast_load_session: bool = False
    schema_alter: bool = True
    compat: bool = False
    extra: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, given: Mapping[str, Any] | Options | None = None, **more: Any) -> Options:
        """From a mapping, with aliases resolved; the real name wins over its alias."""
        if isinstance(given, Options):
            given = given.to_dict()
        known = {f.name for f in fields(cls)} - {"extra"}
        values: dict[str, Any] = {}
        extra: dict[str, Any] = dict((given or {}).get("extra", {}))
        for key, value in {**(given or {}), **more}.items():
            if key in ALIASES:
                values.setdefault(ALIASES[key], value)
            elif key in known:
                values[key] = value
            elif key != "extra":
                extra[key] = value
        options = cls(**values, extra=extra)
        options.schema_mode = MODES_OF_SCHEMA.get(str(options.schema_mode).strip().lower(), "evolve")
        return options

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


STAGES = ("create", "load", "index", "optimize")

_FAST = {"load_method": "auto", "json_streaming_load": True, "persist_parquet_files": False, "persist_tsv_files": False, "parallel_workers": 0, "db_load_parallel_tables": 0, "chunk_size": 20000, "fast_load_session": True}
_PARSE = {"json_streaming_load": False, "persist_parquet_files": True, "persist_tsv_files": False}

#: mode -> (stages that run, options that it sets)
PRESETS: dict[str, tuple[tuple[str, ...], dict[str, Any]]] = {
    "default": (STAGES, {}),
    "parse-parquet": (STAGES, _PARSE),
    "parse-parquet-safe": (STAGES, {**_PARSE, "parallel_workers": 0, "chunk_size": 5000}),
    "ingest-fast": (STAGES[:2], _FAST),
    "ingest-fast-parallel": (STAGES[:2], {**_FAST, "parallel_workers": 8, "db_load_parallel_tables": 8, "tsv_merge_union_schema": True, "overlap_batches": True, "chunk_size": 5000}),
    "ingest-fast-freeze": (STAGES[:2], {**_FAST, "schema_mode": "freeze", "extra_column_name": "__extra__", "schema_alter": False}),
    "ingest-fast-hybrid": (STAGES[:2], {**_FAST, "schema_mode": "hybrid", "schema_hybrid_warmup_batches": 1, "schema_alter": True}),
    "ingest-safe": (STAGES[:2], {"load_method": "to_sql", "json_streaming_load": False, "chunk_size": 1000}),
    "finalize": (STAGES[2:], {}),
}


def with_mode(config: Mapping[str, Any], mode: str | None, **cli: Any) -> tuple[Options, dict[str, bool]]:
    """(options, stages): the mode overrides the config, explicit options override the mode."""
    name = mode or "default"
    if name not in PRESETS:
        raise ValueError(f"unknown mode {name!r}; there are {', '.join(PRESETS)}")
    stages, preset = PRESETS[name]
    given = {k: v for k, v in cli.items() if v is not None}
    options = Options.of({**config, **preset, **given})
    # what was asked for in so many words, not set by a mode: only that can contradict something
    asked = Options.of({**config, **given}).to_dict()
    options.extra["explicit_alter"] = bool(asked["schema_alter"]) and "schema_alter" in {**config, **given}
    options.extra["explicit_streaming"] = bool(asked["json_streaming_load"])
    options.extra["explicit_parquet"] = bool({*config, *given} & {"persist_parquet_files", "save_local_files"}) and bool(asked["persist_parquet_files"])
    return options, {s: s in stages for s in STAGES}


def conflicts(options: Options) -> list[str]:
    """Combinations that contradict each other."""
    found = []
    if options.json_streaming_load and options.persist_parquet_files and options.extra.get("explicit_streaming") and options.extra.get("explicit_parquet"):
        found.append("row-wise streaming and Parquet artifacts exclude each other")
    if options.persist_tsv_files and not options.json_streaming_load:
        found.append("TSV artifacts need row-wise streaming")
    if options.schema_mode == "freeze" and options.schema_alter and options.extra.get("explicit_alter"):
        found.append("a frozen schema can't be altered")
    return found


def as_bool(value: Any, default: bool = False) -> bool:
    if isinstance(value, str):
        text = value.strip().lower()
        return True if text in ("1", "true", "yes", "y", "on") else False if text in ("0", "false", "no", "n", "off", "") else default
    return default if value is None else bool(value)


def as_int(value: Any, default: int | None = None) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def as_list(value: Any) -> list[str]:
    """A list from a list, or from text separated by commas."""
    if value is None:
        return []
    items = value.split(",") if isinstance(value, str) else value
    return [s for s in (str(x).strip() for x in items) if s]


def for_file(path: str, options: Options) -> Options:
    """Options with the file, its type, and a table named after it."""
    p = PurePath(path)
    return Options.of(options, file_name=path, file_type=p.suffix.lstrip(".").lower(), table_name=options.table_name or p.stem, KEYs=list(dict.fromkeys([*options.KEYs, *as_list(options.extra.get("KEY"))])))


def masked(config: Mapping[str, Any]) -> dict[str, Any]:
    """The mapping without secrets."""
    return {k: "***" if re.search(r"passw|secret|token", str(k), re.I) and v else masked(v) if isinstance(v, Mapping) else v for k, v in config.items()}
