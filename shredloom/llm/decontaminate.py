"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

A text's windows have as many words as the benchmark item that they are compared with, and start at every word.
A window is a multiset of 3-word shingles, each weighted by its length in bytes; its SimHash has 64 bits. The items of one
length are in a multi-index: the fingerprints are cut into 8 blocks of 8 bits, and an item is listed in each block under
every value that differs from its own in at most ``RADIUS // 8`` bits. By the pigeonhole principle two fingerprints within
``RADIUS`` bits agree that well in some block, so the lookup finds all of them. What it finds is verified by the exact
weighted Jaccard similarity of the two multisets.

Windows that share no shingle with any item have similarity 0, and an item of which a whole text holds too little weight
can't reach the threshold in any of its windows; so fingerprints are computed only where neither holds. That loses nothing.

The items are sent to every task in passes of at most ``PASS_SHINGLES`` shingles, one pass over the documents each. A pass
is written before the next one begins, so that a task holds one pass's items however large the benchmark is. Owners of shared
shingles and neighbouring windows are taken in stretches, about ``LOOKUPS`` comparisons at once, however long a text is.

The radius follows from the threshold: multisets of equal weight with Jaccard similarity 1/2 share 2/3 of it, the angle
between them is about acos(2/3), and so 17 of 64 bits differ on average with a standard deviation of 3.5; 23 bits lie 1.7
above. At such a radius the blocks' lookup is not selective by itself, which no blocks of a 64-bit fingerprint can be;
what keeps candidates few is that fingerprints are only computed where shingles are shared.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shredloom.llm.text import Group, Words, groups, lowered, shingles, words
from shredloom.session import materialize, trimmed

SHINGLE = 3
THRESHOLD = 0.5
RADIUS = 23
BLOCKS = 8
PASS_SHINGLES = 1_000_000
STRETCH = 4096
LOOKUPS = 1_000_000
_BITMAP = 22

_BALL = [np.array([v for v in range(256) if (v ^ x).bit_count() <= RADIUS // BLOCKS], np.int64) for x in range(256)]
_BITS = np.arange(64, dtype=np.uint64)


def _weighted(g: Group) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, shingle hashes, index of each one's first word, weights)."""
    w = words(g)
    h, at = shingles(w, SHINGLE)
    size = (w.end - w.start).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    return w, h, at, total[at + SHINGLE] - total[at]


def fingerprints(h: np.ndarray, weight: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """SimHash of ``h[s:s + length]`` for each s in ``start``, by running sums of the weighted signs."""
    signs = ((h[:, None] >> _BITS[None, :]) & np.uint64(1)).astype(np.int64) * 2 - 1
    sums = np.zeros((len(h) + 1, 64), np.int64)
    np.cumsum(signs * weight[:, None], axis=0, out=sums[1:])
    votes = sums[np.minimum(start + length, len(h))] - sums[start]
    return ((votes > 0).astype(np.uint64) << _BITS[None, :]).sum(1, dtype=np.uint64)


def _bounded(doc: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of whole documents that have at most ``LOOKUPS`` counted things each, or are a single document."""
    begins = np.flatnonzero(np.diff(doc, prepend=-1))
    lo, held = 0, 0
    for at, n in zip(begins.tolist(), np.add.reduceat(count, begins).tolist()):
        if held and held + n > LOOKUPS:
            yield lo, at
            lo, held = at, 0
        held += n
    yield lo, len(doc)


class Hamming(NamedTuple):
    """Multi-index over the fingerprints of the items of one length."""

    item: np.ndarray
    print: np.ndarray
    first: np.ndarray
    listed: np.ndarray

    @classmethod
    def build(cls, item: np.ndarray, fingerprint: np.ndarray) -> Hamming:
        cells, who = [], []
        for j in range(BLOCKS):
            for i, value in enumerate(((fingerprint >> np.uint64(8 * j)) & np.uint64(255)).tolist()):
                near = _BALL[value]
                cells.append(near + 256 * j)
                who.append(np.full(len(near), i))
        cell, listed = np.concatenate(cells), np.concatenate(who)
        order = np.argsort(cell, kind="stable")
        return cls(item, fingerprint, np.searchsorted(cell[order], np.arange(256 * BLOCKS + 1)), listed[order])

    def within(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query index, index of item) within the radius."""
        seen = []
        for j in range(BLOCKS):
            cell = ((query >> np.uint64(8 * j)) & np.uint64(255)).astype(np.int64) + 256 * j
            count = self.first[cell + 1] - self.first[cell]
            q = np.repeat(np.arange(len(query)), count)
            offset = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
            seen.append(q * len(self.item) + self.listed[self.first[cell][q] + offset])
        both = np.unique(np.concatenate(seen))
        q, i = both // len(self.item), both % len(self.item)
        near = np.bitwise_count(query[q] ^ self.print[i]) <= RADIUS
        return q[near], i[near]


class Items:
    """Benchmark items of one pass, indexed by shingle and, for each length, by fingerprint."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        g = next(groups(lowered(pa.array(texts, pa.string())), 1 << 62))
        w, h, at, weight = _weighted(g)
        self.ids = ids
        self.words = np.diff(w.first)
        first = np.searchsorted(at, w.first)
        self.shingles = [self._counted(h[a:b], weight[a:b]) for a, b in zip(first[:-1], first[1:])]
        self.total = np.array([float(weight[a:b].sum()) for a, b in zip(first[:-1], first[1:])])
        owner = np.repeat(np.arange(len(ids)), np.diff(first))
        key = np.unique(np.stack([h.view(np.int64), owner], 1), axis=0) if len(h) else np.empty((0, 2), np.int64)
        order = np.argsort(key[:, 0].view(np.uint64), kind="stable")
        known = key[order, 0].view(np.uint64)
        self.hash, self.first = np.unique(known, return_index=True)
        self.first = np.append(self.first, len(known))
        self.owner = key[order, 1]
        self.bitmap = np.zeros(1 << _BITMAP, bool)
        self.bitmap[self.hash >> np.uint64(64 - _BITMAP)] = True
        self.by_length: dict[int, Hamming] = {}
        for n in np.unique(self.words[self.words >= SHINGLE]).tolist():
            item = np.flatnonzero(self.words == n)
            prints = np.array([fingerprints(h[first[i] : first[i + 1]], weight[first[i] : first[i + 1]], np.zeros(1, np.int64), n)[0] for i in item], np.uint64)
            self.by_length[n] = Hamming.build(item, prints)

    @staticmethod
    def _counted(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles and their weights times occurrences."""
        u, at, count = np.unique(h, return_index=True, return_counts=True)
        return u, weight[at] * count

    def similarity(self, i: int, h: np.ndarray, weight: np.ndarray) -> float:
        """Exact weighted Jaccard similarity of item i and a window's shingles."""
        u, x = self._counted(h, weight)
        v, y = self.shingles[i]
        _, a, b = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        both = float(np.minimum(x[a], y[b]).sum())
        union = float(x.sum() + y.sum()) - both
        return both / union if union else 0.0

    def search(self, g: Group) -> Iterator[tuple[int, int, float, int]]:
        """(row of the group, item, similarity, first word) of the best window of each leaked item of each text."""
        w, h, at, weight = _weighted(g)
        hit = np.flatnonzero(self.bitmap[h >> np.uint64(64 - _BITMAP)])
        slot = np.searchsorted(self.hash, h[hit])
        real = np.flatnonzero(self.hash[np.minimum(slot, len(self.hash) - 1)] == h[hit]) if len(self.hash) else []
        hit, slot = hit[real], slot[real]
        if not len(hit):
            return
        doc = np.searchsorted(w.first, at[hit], "right") - 1
        for a, b in _bounded(doc, self.first[slot + 1] - self.first[slot]):
            task, place = self._tasks(doc[a:b], hit[a:b], slot[a:b], weight)
            begins = np.flatnonzero(np.diff(task, prepend=-1))
            for x, y in zip(begins.tolist(), [*begins[1:].tolist(), len(task)]):
                yield from self._windows(int(task[x] >> 32), int(task[x] & 0xFFFFFFFF), np.unique(place[x:y]), w, h, at, weight)

    def _tasks(self, doc: np.ndarray, hit: np.ndarray, slot: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document and length of items, place of a shingle) in order, of the items of which a document holds enough.

        A single document's shingles may have more owners than ``LOOKUPS``; these are gone through in parts, twice.
        """
        count = self.first[slot + 1] - self.first[slot]
        most = len(self.ids)

        def owners(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            n = count[a:b]
            place = np.repeat(np.arange(a, b), n)
            return place, self.owner[np.repeat(self.first[slot[a:b]], n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)]

        if count.sum() <= LOOKUPS:
            place, item = owners(0, len(hit))
            pair, back = np.unique(doc[place] * most + item, return_inverse=True)
            keep = np.flatnonzero((np.bincount(back, weight[hit[place]]) >= THRESHOLD * self.total[pair % most])[back])
            task, place = doc[place[keep]] * (1 << 32) + self.words[item[keep]], hit[place[keep]]
        else:
            each = max(1, LOOKUPS // int(count.max()))
            parts = [(a, min(a + each, len(hit))) for a in range(0, len(hit), each)]
            held = np.zeros(most)
            for a, b in parts:
                place, item = owners(a, b)
                held += np.bincount(item, weight[hit[place]], most)
            enough = held >= THRESHOLD * self.total
            found = []
            for a, b in parts:
                place, item = owners(a, b)
                place, item = place[enough[item]], item[enough[item]]
                found.append(np.unique(np.stack([doc[place] * (1 << 32) + self.words[item], hit[place]]), axis=1))
            task, place = np.concatenate(found, axis=1)
        order = np.argsort(task, kind="stable")
        return task[order], place[order]

    def _windows(self, doc: int, n: int, place: np.ndarray, w: Words, h: np.ndarray, at: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        lo, hi = np.searchsorted(at, w.first[doc]), np.searchsorted(at, w.first[doc + 1])
        length = n - SHINGLE + 1
        last = max(0, hi - lo - length)
        p = place - lo
        cover = np.zeros(last + 2, np.int64)
        np.add.at(cover, np.clip(p - length + 1, 0, last), 1)
        np.add.at(cover, np.minimum(p, last) + 1, -1)
        start = np.flatnonzero(np.cumsum(cover)[: last + 1] > 0)
        index, best = self.by_length[n], {}
        few = max(1, LOOKUPS // len(index.item))
        # runs of neighbouring windows: sums are taken over what these cover, not over the whole text
        for run in np.split(start, np.flatnonzero(np.diff(start) > length) + 1):
            most = max(STRETCH, length)
            for stretch in np.split(run, range(most, len(run), most)):
                a, b = lo + stretch[0], min(hi, lo + stretch[-1] + length)
                prints = fingerprints(h[a:b], weight[a:b], stretch - stretch[0], length)
                for at_once in range(0, len(stretch), few):
                    found, i = index.within(prints[at_once : at_once + few])
                    for s, k in zip(stretch[at_once + found].tolist(), index.item[i].tolist()):
                        x = slice(lo + s, min(hi, lo + s + length))
                        similar = self.similarity(k, h[x], weight[x])
                        if similar >= THRESHOLD and similar > best.get(k, (0.0, 0))[0]:
                            best[k] = (similar, s)
        for k, (similar, s) in sorted(best.items()):
            yield doc, k, similar, s


def passes(benchmark: DataFrame, limit: int = PASS_SHINGLES) -> Iterator[Items]:
    """The items that have an id and enough words, in passes of bounded size."""
    ids, texts, held = [], [], 0
    for row in benchmark.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        held += row.text.count(" ") + 1
        if held >= limit:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
    if ids:
        yield Items(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): every item that a document holds, at its best window.

    Items of fewer than 3 words, and null or empty texts, are in no pair. A text shorter than an item is one window.
    The first of equally similar windows is reported. Repeated rows give repeated pairs; a null ``doc_id`` passes through;
    texts of any length are searched whole; without documents or items there are no pairs. Other columns are ignored.
    """
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"doc_id {kinds[0]}, item_id {kinds[1].simpleString()}, similarity double, first_word bigint"
    found = docs.sparkSession.createDataFrame([], schema)
    for nth, items in enumerate(passes(benchmark)):
        if nth:
            found = materialize(found, "leaks")

        def one(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(g.lo + d, items.ids[k], s, at) for g in groups(lowered(b.column("text"))) for d, k, s, at in items.search(g)]
                r, i, s, at = zip(*rows) if rows else ((), (), (), ())
                ids = b.column("doc_id").take(pa.array(r, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(i).cast(_arrow(kinds[1])), pa.array(np.array(s, float).round(6)), pa.array(at, pa.int64())], ["doc_id", "item_id", "similarity", "first_word"])

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(trimmed(one), schema))
    return found


def _arrow(kind) -> pa.DataType:  # noqa: ANN001
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds an item, in one pass for each pass of items and without a shuffle.

    All columns are passed through, whatever their names. Cases are as in :func:`leaks`; a null text stays.
    """
    for nth, items in enumerate(passes(benchmark)):
        if nth:
            docs = materialize(docs, "clean")

        def one(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for g in groups(lowered(b.column("text"))):
                    for d, *_ in items.search(g):
                        clean[g.lo + d] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(trimmed(one), docs.schema)
    return docs
