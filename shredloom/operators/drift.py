"""Schema drift: evolving, frozen and hybrid tables, overflow columns, and merging of drifted fragments."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTRA = "__extra__"


def pack_extra(df: DataFrame, allowed: Iterable[str], key: str = "id", extra: str = EXTRA) -> DataFrame:
    """Keep the allowed columns; what others hold goes as a JSON object into ``extra``, NULL where they hold nothing."""
    allowed = [*allowed]
    kept = [c for c in df.columns if c in {*allowed, key} and c != extra]
    others = [c for c in df.columns if c not in kept and c != extra]
    before = F.col(f"`{extra}`") if extra in df.columns else F.lit(None).cast("string")
    if not others:
        return df.select(*[f"`{c}`" for c in kept], before.alias(extra))
    # a struct keeps each value's own type in the JSON; null fields are left out of it
    packed = F.to_json(F.struct(*[F.col(f"`{c}`") for c in others]), {"ignoreNullFields": "true"})
    return df.select(*[f"`{c}`" for c in kept], F.coalesce(F.nullif(packed, F.lit("{}")), before).alias(extra))


def with_columns_of(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Those columns in that order, missing ones as NULL text."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def intersection(df: DataFrame, target: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """The columns that the target has, and the names of those it hasn't."""
    target = set(target)
    return df.select(*[f"`{c}`" for c in df.columns if c in target]), [c for c in df.columns if c not in target]


def merge_eligible(schemas: Sequence[Iterable[str]], least_share: float = 0.8, most_missing: int = 32, most_columns: int = 256) -> bool:
    """Whether fragments may be written as one table: no more than 256 columns in all, and each lacks at most 32 or has 0.8 of them."""
    sets = [set(s) for s in schemas]
    union = set().union(*sets) if sets else set()
    if not union or len(union) > most_columns:
        return False
    return all(len(union - s) <= most_missing or len(s) / len(union) >= least_share for s in sets)


def union_merge(fragments: Sequence[DataFrame]) -> DataFrame:
    """All rows under the union of the columns; columns whose types disagree become text."""
    types: dict[str, set[str]] = {}
    for df in fragments:
        for name, kind in df.dtypes:
            types.setdefault(name, set()).add(kind)
    mixed = {n for n, kinds in types.items() if len(kinds) > 1}
    same = [df.select(*[(F.col(f"`{c}`").cast("string") if c in mixed else F.col(f"`{c}`")).alias(c) for c in df.columns]) for df in fragments]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)


@dataclass
class DriftState:
    """What is remembered from batch to batch: the columns of every table, and which of these are frozen."""

    mode: str = "evolve"
    warmup: int = 1
    extra: str = EXTRA
    key: str = "id"
    columns: dict[str, list[str]] = field(default_factory=dict)
    frozen: dict[str, list[str]] = field(default_factory=dict)
    batches: int = 0

    def start_batch(self) -> None:
        """Freeze what is known when the mode asks for it; tables that are new later freeze with their first batch."""
        if (self.mode == "hybrid" and self.batches >= self.warmup) or (self.mode == "freeze" and self.batches >= 1):
            for table, columns in self.columns.items():
                self.frozen.setdefault(table, list(columns))
        self.batches += 1

    def admit(self, table: str, df: DataFrame) -> DataFrame:
        """The batch in the shape in which the table takes it."""
        known = self.columns.setdefault(table, [])
        freezing = self.mode == "freeze" or (self.mode == "hybrid" and self.batches > self.warmup)
        if table in self.frozen or (freezing and known):
            allowed = self.frozen.setdefault(table, list(known))
            return with_columns_of(pack_extra(df, allowed, self.key, self.extra), [*allowed, self.extra])
        known += [c for c in df.columns if c not in known]
        if freezing:
            self.frozen[table] = list(known)
        if self.mode == "evolve":
            return with_columns_of(df, known)
        return with_columns_of(df, [c for c in known if c != self.extra]).withColumn(self.extra, F.lit(None).cast("string"))

    def to_dict(self) -> dict:
        return dict(self.__dict__)

    @classmethod
    def from_dict(cls, data: dict) -> DriftState:
        return cls(**data)
