"""Unbounded n-gram scoring over sharded suffix arrays of a corpus.

The corpus is divided by a hash into shards of about ``SHARD_CHARS`` characters. Each shard's texts, word by word and
reversed, get a suffix array; a shard's file in the shared folder holds its vocabulary, its words and that array.
Reversed, the context of a word is a prefix, so that one search finds the longest context that the shard has: binary
search over the packed first words of the suffixes, then, within the range found, steps from branch to branch: running
hashes tell how far all suffixes of the range agree and how far the text agrees with them, and only where the suffixes
part is the range narrowed by binary search. A match of any length takes as many steps as it has branches. For every
word to score, the longest context over all shards wins, and the counts of the shards that reach it are summed:

    p(w | context) = (count(context w) + ALPHA * p(w)) / (count(context) + ALPHA),
    p(w) = (count(w) + 1) / (words + VOCABULARY).

count(context w) needs no search of its own: it is positive only if the longest match that ends in w is one word longer
than the context's, and then it is that match's count.

A text that is itself in the corpus would be its own longest context. With ``own``, what its own rows hold is taken off
every count, as if they weren't in the corpus: their suffixes' places are known, and how many lie in a range takes two
binary searches.

Texts to score are taken in blocks. Every block meets every shard, in ``SPLIT`` tasks that each take a share of the
shards one after another; so memory stays bounded by one shard and one block, and only texts to score are shuffled.

Where the texts to score are known beforehand, :func:`scores` gives the same without an index of the whole corpus, as blocks
times shards would grow with the square of the input. One pass over the corpus counts its n-grams of under ``DEEP`` words
that the texts have, and takes out its passages: longest stretches of which every ``DEEP`` words in a row occur in the texts.
An occurrence of ``DEEP`` words or more of a text lies in just one passage, whole. So shorter matches are looked up in the
counts, and only longer ones in suffix arrays, of the passages alone. A bit for each hash of the texts' n-grams, sent to
all tasks, says what may occur; hashes that fall together there cost rows and words, but count for nothing.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shredloom.llm.text import _power, groups, lowered, mix, words
from shredloom.session import batches_of, discard, materialize, shared_dir, shuffles_removed

SHARD_CHARS = 30_000_000
BLOCK_CHARS = 4_000_000
SPLIT = 8
DEEP = 6
SHARD_WORDS = 2_000_000
ROWS = 1000
HELD_BITS = 30
HELD_SLICE = 20
COUNTS = 2_000_000
BROADCAST_IDS = 4_000_000
ALPHA = 2.0
VOCABULARY = 1 << 20


class Shard(NamedTuple):
    """``vocabulary`` holds sorted word hashes; word i has the id i + 1, and 0 stands after each text. ``doc`` hashes their ids."""

    vocabulary: np.ndarray
    doc: np.ndarray
    token: np.ndarray
    suffix: np.ndarray


def reversed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's words, last first, and where each text's begin)."""
    hashes, first = [], [np.zeros(1, np.int64)]
    for g in groups(lowered(column)):
        w = words(g)
        n = len(w.hash)
        end = np.repeat(w.first[1:], np.diff(w.first))
        begin = np.repeat(w.first[:-1], np.diff(w.first))
        hashes.append(w.hash[end - 1 - (np.arange(n) - begin)])
        first.append(w.first[1:] + first[-1][-1])
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.concatenate(first)


def pack_width(vocabulary: int) -> tuple[int, int]:
    """(words packed into one 63-bit key, bits for each)."""
    bits = max(1, int(vocabulary + 1).bit_length())
    depth = max(1, min(3, 63 // bits))
    return depth, bits


def packed(token: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """First ``depth`` words from every position on, as one number; 0 beyond the end."""
    padded = np.concatenate([token, np.zeros(depth, token.dtype)]).astype(np.uint64)
    key = np.zeros(len(token), np.uint64)
    for j in range(depth):
        key = (key << np.uint64(bits)) | padded[j : j + len(token)]
    return key


def build(hashes: np.ndarray, first: np.ndarray, doc: np.ndarray) -> Shard:
    """Suffix array by prefix doubling; each round sorts only what is not yet in order."""
    vocabulary = np.unique(hashes)
    n = len(hashes) + len(first) - 1
    token = np.zeros(n, np.int32)
    token[np.arange(len(hashes)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = np.searchsorted(vocabulary, hashes) + 1
    depth, bits = pack_width(len(vocabulary))
    key = packed(token, depth, bits)
    suffix = np.argsort(key, kind="stable").astype(np.int32)
    key = key[suffix]
    head = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.empty(0, bool)
    head |= token[suffix] == 0  # nothing is ever looked up across the end of a text
    del key
    rank = np.empty(n + 1, np.int32)
    rank[n] = 0
    rank[suffix] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
    slots = _unsorted(head, np.arange(n, dtype=np.int32))
    step = depth
    while len(slots):
        at = suffix[slots]
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at.astype(np.int64) + step, n)].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        suffix[slots] = at
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
        slots = _unsorted(head, slots)
        step *= 2
    return Shard(vocabulary, doc, token, suffix)


def _unsorted(head: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Slots in runs of more than one."""
    last = np.append(head[1:], True)
    return slots[~(head & last)] if len(head) else slots


def save(shard: Shard, uri: str) -> None:
    """Write a shard so that it appears whole or not at all, also if a task is repeated."""
    system, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(np.array([len(shard.vocabulary), len(shard.doc), len(shard.token)], np.int64).tobytes())
        for values in shard:
            out.write(memoryview(np.ascontiguousarray(values)).cast("B"))
    system.move(part, path)


def load(uri: str) -> Shard:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as file:
        data = file.read_buffer()
    v, t, n = np.frombuffer(data, np.int64, 3)
    at = 24 + 8 * (v + t)
    return Shard(np.frombuffer(data, np.uint64, v, 24), np.frombuffer(data, np.uint64, t, 24 + 8 * v), np.frombuffer(data, np.int32, n, at), np.frombuffer(data, np.int32, n, at + 4 * n))


class Running:
    """Hashes of any stretch of a sequence of word ids, from running sums."""

    def __init__(self, ids: np.ndarray) -> None:
        up, self.down = _power(len(ids))
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix(ids.astype(np.uint64)) * up[: len(ids)], out=self.sums[1:])

    def hash(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]


def _agree(a: Running, x: np.ndarray, b: Running, y: np.ndarray, known: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from ``x`` and ``y`` on are equal, of which ``known`` are, and at most ``most``."""
    low, high = known.copy(), most.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) >> 1
        same = a.hash(x[open_], mid) == b.hash(y[open_], mid)
        low[open_[same]] = mid[same]
        high[open_[~same]] = mid[~same] - 1


class Own:
    """Places of the suffixes of texts that are to be left out, and how many of them lie in a range."""

    def __init__(self, shard: Shard, first: np.ndarray, doc: np.ndarray | None) -> None:
        n = len(shard.token)
        self.slot, self.room = np.zeros(int(first[-1]), np.int64), n + 1
        self.words = np.zeros(len(first) - 1, np.int64)
        self.keys = np.empty(0, np.int64)
        if doc is None:
            return
        names, slot = np.unique(doc, return_inverse=True)
        at = np.minimum(np.searchsorted(names, shard.doc), max(len(names) - 1, 0))
        mine = (names[at] == shard.doc) & (shard.doc != 0) if len(names) else np.zeros(len(shard.doc), bool)  # 0: no id
        if not mine.any():
            return
        text = np.cumsum(shard.token == 0) - (shard.token == 0)
        place = np.flatnonzero(mine[text] & (shard.token > 0))
        rank = np.empty(n, np.int32)
        rank[shard.suffix] = np.arange(n, dtype=np.int32)
        self.keys = np.sort(at[text[place]] * self.room + rank[place])
        self.slot = np.repeat(slot, np.diff(first))
        self.words = np.bincount(at[text[place]], minlength=len(names))[slot]

    def within(self, live: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray | int:
        if not len(self.keys):
            return 0
        base = self.slot[live] * self.room
        return np.searchsorted(self.keys, base + hi) - np.searchsorted(self.keys, base + lo)


def longest(shard: Shard, hashes: np.ndarray, first: np.ndarray, doc: np.ndarray | None = None, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every position of the reversed texts: longest match from there on, its count, and its first word's count.

    With ``doc``, the hash of each text's id, texts of that id in the shard don't count; last is how many words they have.
    With ``some``, matches are sought from its positions only; at others they end after a word.
    """
    n, v = len(hashes), len(shard.vocabulary)
    own = Own(shard, first, doc)
    slot = np.searchsorted(shard.vocabulary, hashes)
    known = shard.vocabulary[np.minimum(slot, v - 1)] == hashes if v else np.zeros(n, bool)
    ids = np.where(known, slot + 1, 0)
    each = np.bincount(shard.token, minlength=v + 2)
    begins = np.cumsum(each) - each
    ones = np.where(known, each[ids] - own.within(np.arange(n), begins[ids], begins[ids] + each[ids]), 0)
    end = np.repeat(first[1:], np.diff(first))
    depth, bits = pack_width(v)
    keys = packed(shard.token, depth, bits)[shard.suffix]
    width = np.uint64(bits)
    length, count = (ones > 0).astype(np.int64), ones.copy()
    low, high = begins[ids], begins[ids] + each[ids]
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    live = np.flatnonzero(ones > 0 if some is None else (ones > 0) & some)
    prefix = ids[live].astype(np.uint64)
    for d in range(1, depth):
        follow = padded[live + d] * (live + d < end[live])
        live, prefix = live[follow > 0], (prefix[follow > 0] << width) | follow[follow > 0].astype(np.uint64)
        room = np.uint64(bits * (depth - 1 - d))
        order = np.argsort(prefix)  # neighbouring searches then touch the same part of the keys
        lo, hi = np.empty(len(live), np.int64), np.empty(len(live), np.int64)
        lo[order] = np.searchsorted(keys, prefix[order] << room)
        hi[order] = np.searchsorted(keys, (prefix[order] + np.uint64(1)) << room)
        some = hi - lo - own.within(live, lo, hi)
        hit = some > 0
        live, prefix, lo, hi = live[hit], prefix[hit], lo[hit], hi[hit]
        length[live], count[live], low[live], high[live] = d + 1, some[hit], lo, hi
    del keys
    lo, hi, d = low[live], high[live], np.full(len(live), depth)
    total = len(shard.token)
    if len(live):
        corpus, text = Running(shard.token), Running(np.where(known, ids, 1 << 40))
    while len(live):
        a, b = shard.suffix[lo].astype(np.int64), shard.suffix[hi - 1].astype(np.int64)
        # how far the text goes along with the first suffix of the range, and whether it leaves all others there too
        far = _agree(text, live, corpus, a, d, np.minimum(end[live] - live, total - a))
        more = np.minimum(far + 1, total - np.maximum(a, b))
        split = (a != b) & ((more <= far) | (corpus.hash(a, more) != corpus.hash(b, more)))
        length[live[~split]] = far[~split]
        live, lo, hi, d, a, b, far = live[split], lo[split], hi[split], d[split], a[split], b[split], far[split]
        d = _agree(corpus, a, corpus, b, d, np.minimum(far, total - b))
        length[live] = d
        inside = live + d < end[live]
        live, lo, hi, d = live[inside], lo[inside], hi[inside], d[inside]
        want = ids[live + d]
        lo, hi = _narrow(shard, lo, hi, d, want, total), _narrow(shard, lo, hi, d, want + 1, total)
        some = hi - lo - own.within(live, lo, hi)
        hit = (some > 0) & (want > 0)
        live, lo, hi, d = live[hit], lo[hit], hi[hit], d[hit] + 1
        length[live], count[live] = d, some[hit]
    return length, count, ones, own.words


def _narrow(shard: Shard, lo: np.ndarray, hi: np.ndarray, d: np.ndarray, want: np.ndarray, total: int) -> np.ndarray:
    """Lower bound of word ``want`` at depth ``d`` within each range of suffixes, by binary search over all at once."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        at = shard.suffix[mid].astype(np.int64) + d[open_]
        less = np.where(at < total, shard.token[np.minimum(at, total - 1)], 0) < want[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def index(docs: DataFrame, shard_chars: int = SHARD_CHARS) -> tuple[list[str], int]:
    """Write the shards of ``docs.text``; returns their files and the number of words in all.

    Null and empty texts have no words; repeated rows count as often as they occur. A null id is an id of no text to
    score. A table without words has no shards. Other columns than ``doc_id`` and ``text`` are ignored.
    """
    folder = f"{shared_dir(docs.sparkSession)}/ngrams-{uuid.uuid4().hex}"
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, first, doc = [], [np.zeros(1, np.int64)], []
        for b in batches:
            h, f = reversed_words(b.column("text"))
            hashes.append(h)
            first.append(f[1:] + first[-1][-1])
            doc.append(b.column("doc").to_numpy().view(np.uint64))
        total = int(first[-1][-1]) if hashes else 0
        if total:
            uri = f"{folder}/shard-{TaskContext.get().partitionId():06d}"
            system, path = fs.FileSystem.from_uri(folder)
            system.create_dir(path, recursive=True)
            save(build(np.concatenate(hashes), np.concatenate(first), np.concatenate(doc)), uri)
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([total], pa.int64())], ["uri", "words"])

    placed = docs.where("text is not null").select(_hash("doc_id").alias("doc"), "text").repartition(shards, "doc", "text")
    found = placed.mapInArrow(one, "uri string, words bigint").collect()
    return sorted(r.uri for r in found), sum(r.words for r in found)


def _hash(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.xxhash64(name)).otherwise(F.lit(0))


def score(texts: DataFrame, keys: list[str], shards: list[str], total: int, own: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``keys``, n_words, log_prob (natural, of all words), perplexity and mean context length of every text.

    ``own`` names the column, of the type of the corpus's ``doc_id``, whose document in the corpus is left out of all
    counts; a null there leaves out none. A null or empty text has no words, log_prob 0 and null for the means. Repeated
    rows are scored each. With no shards, the probabilities are those of an empty corpus. Columns other than ``keys``,
    ``own`` and ``text`` are ignored.
    """
    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    split = max(1, min(SPLIT, len(shards)))
    named = [f"k{i}" for i in range(len(keys))]
    asked = texts.select(*[F.col(k).alias(a) for k, a in zip(keys, named)], "text", (_hash(own) if own else F.lit(0)).alias("doc"), F.monotonically_increasing_id().alias("row"))
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))), "texts")
    kinds = ", ".join(f"{a} {texts.schema[k].dataType.simpleString()}" for k, a in zip(keys, named))

    def part(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        hashes, first = reversed_words(table.column("text").combine_chunks())
        doc = table.column("doc").to_numpy().view(np.uint64) if own else None
        n = len(hashes)
        length, count, ones = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        mine = np.zeros(len(table), np.int64)
        for uri in shards[key[1].as_py() :: split] if n else []:
            far, times, single, held = longest(load(uri), hashes, first, doc)
            ones += single
            mine += held
            count = np.where(far > length, times, np.where(far == length, count + times, count))
            length = np.maximum(length, far)
        cut = lambda x: pa.LargeListArray.from_arrays(pa.array(first), pa.array(x)).cast(pa.list_(pa.int64()))
        return pa.table({"block": table.column("block"), **{a: table.column(a) for a in named}, "row": table.column("row"), "own": mine, "length": cut(length), "count": cut(count), "ones": cut(ones)})

    shape = f"block bigint, {kinds}, row bigint, own bigint, length array<bigint>, count array<bigint>, ones array<bigint>"
    parts = asked.withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(split)]))).groupBy("block", "part").applyInArrow(part, shape)

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("row").combine_chunks()
        lead = np.arange(0, len(table), split)
        length = count = None
        for i in range(split):
            t = table.take(pa.array(lead + i))
            far, times, single = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("length", "count", "ones"))
            held = t.column("own").to_numpy()
            if length is None:
                length, count, ones, mine = far, times, single, held
                continue
            count = np.where(far > length, times, np.where(far == length, count + times, count))
            length, ones, mine = np.maximum(length, far), ones + single, mine + held
        t = table.take(pa.array(lead))
        size = pa.compute.list_value_length(t.column("length")).to_numpy().astype(np.int64)
        return _scores(t, named, size, length, count, ones, total - mine)

    scored = parts.groupBy("block").applyInArrow(whole, f"{kinds}, n_words bigint, log_prob double, perplexity double, mean_context double")
    return scored.select(*[F.col(a).alias(k) for k, a in zip(keys, named)], "n_words", "log_prob", "perplexity", "mean_context")


def _grams(hashes: np.ndarray, first: np.ndarray, held: np.ndarray | None = None, most: int = DEEP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, position, hash) of all runs of n words, n up to ``most``; with ``held``, only of those whose bits are set there."""
    end = np.repeat(first[1:], np.diff(first))
    at, key = np.arange(len(hashes)), hashes
    for n in range(1, most + 1):
        if n > 1:
            inside = at + n <= end[at]
            at, key = at[inside], key[inside]
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + hashes[at + n - 1])
        if held is not None:
            slot = key >> np.uint64(64 - int(len(held) * 8).bit_length() + 1)
            keep = (held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
            at, key = at[keep], key[keep]
        yield n, at, key


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch in stretches of rows of bounded size, with the reversed words of each."""
    for g in groups(batch.column("text")):
        piece = batch.slice(g.lo, g.hi - g.lo)
        yield piece, *reversed_words(piece.column("text"))


def _held_bits(asked: DataFrame, chars: int) -> np.ndarray:
    """A bit for each hash of n-grams of ``asked.text``, eight to a byte; tasks make slices."""
    bits = min(HELD_BITS, max(HELD_SLICE, math.ceil(math.log2(32 * chars + 1))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, hashes, first in _pieces(b):
                slot = np.unique(np.concatenate([key >> np.uint64(64 - bits) for _, _, key in _grams(hashes, first)])).astype(np.int64)
                part, lead = np.unique(slot >> HELD_SLICE, return_index=True)
                at = pa.ListArray.from_arrays(pa.array(np.append(lead, len(slot)).astype(np.int32)), pa.array((slot & ((1 << HELD_SLICE) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(part), at], ["slice", "at"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for part, at in zip(b.column("slice").to_pylist(), b.column("at")):
                found.setdefault(part, np.zeros(1 << HELD_SLICE, bool))[at.values.to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in found.values()], pa.binary())], ["slice", "bytes"])

    slices = asked.select("text").mapInArrow(place, "slice bigint, at array<int>").repartition("slice").mapInArrow(fill, "slice bigint, bytes binary")
    out, width = np.zeros(1 << (bits - 3), np.uint8), 1 << (HELD_SLICE - 3)
    for r in slices.toLocalIterator():
        out[r.slice * width : (r.slice + 1) * width] = np.frombuffer(r.bytes, np.uint8)
    return out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    lead = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[lead], np.add.reduceat(count, lead) if len(lead) else count


def shared(docs: DataFrame, held: np.ndarray) -> DataFrame:
    """What ``docs`` have of the texts whose n-grams set the bits ``held``, in one pass, written to the shared folder.

    Rows are passages (doc, words), n-grams of fewer than ``DEEP`` words with how often a task found them (key, n), or
    the number of all words of a task (n alone).
    """
    sent = docs.sparkSession.sparkContext.broadcast(held)
    schema = pa.schema([("doc", pa.int64()), ("words", pa.list_(pa.int64())), ("key", pa.int64()), ("n", pa.int64())])

    def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema)

    def counted(key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(key), 100_000):
            part = key[i : i + 100_000]
            yield rows(len(part), key=pa.array(part.view(np.int64)), n=pa.array(count[i : i + 100_000]))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, total, waiting = sent.value, 0, 0
        keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for b in batches:
            for piece, hashes, first in _pieces(b):
                total += len(hashes)
                for n, at, key in _grams(hashes, first, bits):
                    if n < DEEP:
                        key, count = np.unique(key, return_counts=True)
                        keys.append(key)
                        counts.append(count)
                        waiting += len(key)
                if len(at):
                    lead = np.flatnonzero(np.append(True, np.diff(at) != 1))
                    begin, size = at[lead], at[np.append(lead[1:], len(at)) - 1] + DEEP - at[lead]
                    ends = np.concatenate([[0], np.cumsum(size)])
                    words_ = hashes[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)]
                    doc = piece.column("doc").take(pa.array(np.searchsorted(first, begin, "right") - 1))
                    yield rows(len(lead), doc=doc, words=pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words_.view(np.int64))))
                if waiting > COUNTS:
                    key, count = _summed(keys, counts)
                    if len(key) > COUNTS // 2:
                        yield from counted(key, count)
                        key, count = key[:0], count[:0]
                    keys, counts, waiting = [key], [count], len(key)
        yield from counted(*_summed(keys, counts))
        yield rows(1, n=pa.array([total], pa.int64()))

    placed = docs.where("text is not null").select(_hash("doc_id").alias("doc"), "text")
    with batches_of(docs.sparkSession, ROWS):
        found = materialize(placed.mapInArrow(one, "doc bigint, words array<bigint>, key bigint, n bigint"), "shared")
    sent.destroy()
    return found


def _index_passages(found: DataFrame, shard_words: int) -> list[str]:
    """Write suffix arrays of the passages of :func:`shared`; returns their files."""
    passages = found.where("words is not null").select("doc", "words")
    folder = f"{shared_dir(found.sparkSession)}/ngrams-{uuid.uuid4().hex}"
    shards = max(1, -(-(passages.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0) // shard_words))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, size, doc = [], [], []
        for b in batches:
            hashes.append(b.column("words").flatten().to_numpy().view(np.uint64))
            size.append(pa.compute.list_value_length(b.column("words")).to_numpy())
            doc.append(b.column("doc").to_numpy().view(np.uint64))
        if sum(map(len, hashes)):
            uri = f"{folder}/shard-{TaskContext.get().partitionId():06d}"
            system, path = fs.FileSystem.from_uri(folder)
            system.create_dir(path, recursive=True)
            save(build(np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(size), dtype=np.int64)]), np.concatenate(doc)), uri)
            yield pa.RecordBatch.from_arrays([pa.array([uri])], ["uri"])

    with shuffles_removed(found.sparkSession):
        return sorted(r.uri for r in passages.repartition(shards, "doc", "words").mapInArrow(one, "uri string").collect())


def scores(docs: DataFrame, texts: DataFrame, keys: list[str], own: str | None = None, block_chars: int = BLOCK_CHARS // 2, shard_words: int = SHARD_WORDS) -> DataFrame:
    """What :func:`score` gives for ``texts`` under all of ``docs``, with work in proportion to ``docs`` as long as few passages of it recur."""
    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars), min(SPLIT, SPLIT * chars // block_chars))
    named = [f"k{i}" for i in range(len(keys))]
    asked = texts.select(*[F.col(k).alias(a) for k, a in zip(keys, named)], "text", (_hash(own) if own else F.lit(0).cast("long")).alias("doc"), F.monotonically_increasing_id().alias("row"))
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))), "texts")
    kinds = ", ".join(f"{a} {texts.schema[k].dataType.simpleString()}" for k, a in zip(keys, named))
    found = shared(docs, _held_bits(asked, chars))
    total = found.where("key is null and words is null").agg(F.sum("n")).first()[0] or 0
    # what the pass found is summed and indexed in turn and then deleted, so that none of it is left when the texts are scored
    counts = materialize(found.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")), "counts")
    shards = _index_passages(found, shard_words)
    discard(found)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in pa.compute.unique(b.column("block")):
                for _, hashes, first in _pieces(b.filter(pa.compute.equal(b.column("block"), block))):
                    key = np.unique(np.concatenate([k for _, _, k in _grams(hashes, first, most=DEEP - 1)]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block.as_py())), pa.array(key.view(np.int64))], ["block", "key"])

    counts = asked.select("block", "text").mapInArrow(wanted, "block bigint, key bigint").join(counts, "key").select("block", "key", "n")
    ids = asked.where("doc <> 0").select("block", "doc").distinct()
    if ids.count() <= BROADCAST_IDS:  # else the join is left to shuffle
        ids = F.broadcast(ids)
    mine = docs.where("text is not null").select(_hash("doc_id").alias("doc"), "text").join(ids, "doc").select("block", "doc", "text")
    both = asked.unionByName(mine, allowMissingColumns=True)  # without a row number: what the corpus has under the texts' own ids

    def whole(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, others = left.filter(left.column("row").is_valid()).sort_by("row"), left.filter(left.column("row").is_null())
        hashes, first = reversed_words(rows.column("text").combine_chunks())
        doc = rows.column("doc").to_numpy().view(np.uint64)
        key_, lead = np.unique(right.column("key").to_numpy().view(np.uint64), return_index=True)  # asked for by more than one stretch of texts
        there = key_, right.column("n").to_numpy()[lead]
        theirs, begins = reversed_words(others.column("text").combine_chunks())
        whose = others.column("doc").to_numpy().view(np.uint64)
        words_ = _summed([whose], [np.diff(begins)])
        whose = mix(np.repeat(whose, np.diff(begins)))
        taken = [k ^ whose[at] for _, at, k in _grams(theirs, begins, most=DEEP - 1)]
        taken = _summed(taken, [np.ones(len(k), np.int64) for k in taken])
        of = mix(np.repeat(doc, np.diff(first)))
        length, count, ones = (np.zeros(len(hashes), np.int64) for _ in range(3))
        for n, at, k in _grams(hashes, first, most=DEEP - 1):
            times = _look(there, k) - _look(taken, k ^ of[at])
            some = times > 0
            length[at[some]], count[at[some]] = n, times[some]
            if n == 1:
                ones[at] = times
        deep = length == DEEP - 1
        for uri in shards if deep.any() else []:
            far, times, _, _ = longest(load(uri), hashes, first, doc if own else None, deep)
            count = np.where((far >= DEEP) & (far >= length), np.where(far > length, times, count + times), count)
            length = np.where(far >= DEEP, np.maximum(length, far), length)
        return _scores(rows, named, np.diff(first), length, count, ones, total - _look(words_, doc))

    many = 2 * blocks
    scored = both.repartition(many, "block").groupBy("block").cogroup(counts.repartition(many, "block").groupBy("block"))
    scored = scored.applyInArrow(whole, f"{kinds}, n_words bigint, log_prob double, perplexity double, mean_context double")
    return scored.select(*[F.col(a).alias(k) for k, a in zip(keys, named)], "n_words", "log_prob", "perplexity", "mean_context")


def _look(counts: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
    """The count of each key, 0 where it has none."""
    if not len(counts[0]):
        return np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(counts[0], key), len(counts[0]) - 1)
    return np.where(counts[0][at] == key, counts[1][at], 0)


def _scores(table: pa.Table, keys: list[str], size: np.ndarray, length: np.ndarray, count: np.ndarray, ones: np.ndarray, total: np.ndarray) -> pa.Table:
    n, first = len(length), np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(len(size)), size)
    # the context of the word at position j begins at j + 1, unless that is the next text
    last = np.zeros(n, bool)
    last[first[1:][size > 0] - 1] = True
    context = np.where(last, 0, np.append(length[1:], 0))
    seen = np.where(last | (context == 0), total[row], np.append(count[1:], 0))
    both = np.where(length == context + 1, count, 0)
    alone = (ones + 1) / (total[row] + VOCABULARY)
    logs = np.log((both + ALPHA * alone) / (seen + ALPHA))
    sums = np.bincount(row, logs, len(size)).astype(np.float64)  # of no words at all it counts in integers
    mean = np.bincount(row, context, len(size)).astype(np.float64) / np.maximum(size, 1)
    empty = size == 0
    return pa.table(
        {
            **{k: table.column(k) for k in keys},
            "n_words": pa.array(size),
            "log_prob": pa.array(sums.round(6)),
            "perplexity": pa.array(np.exp(-sums / np.maximum(size, 1)).round(6), mask=empty),
            "mean_context": pa.array(mean.round(6), mask=empty),
        }
    )
