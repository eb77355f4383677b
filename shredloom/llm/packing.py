"""Sequence packing by best-fit decreasing.

A document longer than a window is first cut into full windows; what is left of it, and every shorter
document, is placed by best-fit decreasing: pieces in order of falling length, each into the open window with
the least room that still holds it. A segment tree over the possible capacities (leaf c holds the windows with
c tokens of room) finds that window in log(capacity) steps.

Best fit is sequential, so the corpus is divided by a hash of the id into shards of about ``shard_tokens``
tokens which are packed independently; each shard leaves a handful of part-filled windows, so the waste stays
negligible at any size. Length is the number of words (runs without whitespace), or whatever column the caller
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredloom.llm.text import groups, words
from shredloom.session import trimmed

CAPACITY = 2048
SHARD_TOKENS = 20_000_000


class RoomTree:
    """Segment tree over room 0..capacity: tells the smallest room of at least n that some open window has."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        if len(self.windows[room]) == 1:
            self._set(room, 1)

    def _set(self, room: int, value: int) -> None:
        count, i = self.count, room + self.size
        count[i] = value
        i >>= 1
        while i:
            full = 1 if count[2 * i] or count[2 * i + 1] else 0
            if count[i] == full:
                break
            count[i] = full
            i >>= 1

    def tightest(self, least: int) -> int:
        """Smallest room >= ``least`` with an open window, or -1."""
        count, i = self.count, least + self.size
        if count[i]:
            return least
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1

    def pop(self, room: int) -> int:
        """Take the window of that room that was added last."""
        window = self.windows[room].pop()
        if not self.windows[room]:
            self._set(room, 0)
        return window


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset in it) of each piece; ``sizes`` must fall and lie in 1..capacity."""
    tree, opened = RoomTree(capacity), 0
    window, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        room = tree.tightest(size)
        if room < 0:
            at, room, opened = opened, capacity, opened + 1
        else:
            at = tree.pop(room)
        window[i], offset[i] = at, capacity - room
        if room > size:
            tree.add(room - size, at)
    return window, offset


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) with the number of whitespace-separated words of each text; 0 for null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [np.diff(words(g, solid=True, hashed=False).first) for g in groups(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(n) if n else np.empty(0, np.int64), pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(count), f"doc_id {kind}, n_tokens bigint")


def pack(lengths: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each window: (shard, window, n_tokens, doc_ids, token_starts, token_counts).

    ``lengths`` has (doc_id, n_tokens). Element i of the lists says which document the window's i-th piece is
    of, at which of its tokens it begins, and how many it has. Documents of 0 tokens take no room and are in no
    window. Ties are broken by id, so the result doesn't depend on the order of rows; rows that repeat an id are
    packed as often as they occur.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    lengths = lengths.select("doc_id", "n_tokens").where("n_tokens > 0")
    total = lengths.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    sharded = lengths.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    def one(key: tuple, found: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        found = found.sort_by([("n_tokens", "descending"), ("doc_id", "ascending")])
        ids, n = found.column("doc_id").combine_chunks(), found.column("n_tokens").to_numpy()
        full = n // capacity
        doc = np.repeat(np.arange(len(n)), full)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
        rest = np.flatnonzero(n % capacity)
        rest = rest[np.argsort(-(n[rest] % capacity), kind="stable")]
        window, offset = best_fit_decreasing(n[rest] % capacity, capacity)
        doc = np.concatenate([doc, rest])
        start = np.concatenate([nth * capacity, full[rest] * capacity])
        size = np.concatenate([np.full(len(nth), capacity), n[rest] % capacity])
        at = np.concatenate([np.arange(len(nth)), window + len(nth)])
        order = np.lexsort([np.concatenate([np.zeros(len(nth), np.int64), offset]), at])
        at, doc, start, size = at[order], doc[order], start[order], size[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        ends = np.append(first, len(at)).astype(np.int32)
        lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), values)
        return pa.table(
            {
                "shard": pa.array(np.full(len(first), shard, np.int32)),
                "window": pa.array(at[first]),
                "n_tokens": pa.array(np.add.reduceat(size, first) if len(first) else np.empty(0, np.int64)),
                "doc_ids": lists(ids.take(pa.array(doc))),
                "token_starts": lists(pa.array(start)),
                "token_counts": lists(pa.array(size)),
            }
        )

    kind = lengths.schema["doc_id"].dataType.simpleString()
    schema = f"shard int, window bigint, n_tokens bigint, doc_ids array<{kind}>, token_starts array<bigint>, token_counts array<bigint>"
    return sharded.groupBy("shard").applyInArrow(one, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Windows of the documents' texts, by :func:`pack` over :func:`word_counts`.

    Null, empty and blank texts are in no window; a text longer than a window is cut into full ones and a rest. Documents
    with null ids are packed under a null id, those that repeat an id as often as they occur; the order of rows doesn't
    matter. An empty table gives no windows; other columns are ignored, whatever their names.
    """
    from shredloom.session import materialize

    return pack(materialize(word_counts(docs), "lengths"), capacity, shard_tokens)
