"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Words enter with weight 1 / sqrt(number of distinct words). Each statistic of a text's structure (share of
capitals, digits, symbols, spaces and line breaks, word and line length, repeated words) is cut into bins,
and each bin is a feature; so are language and source. The factors learn pairs, such as many capitals in a
long text. Scoring takes linear time by the sum-of-squares identity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredloom.llm import fm
from shredloom.llm.text import groups, lowered, segment_sums, words
from shredloom.session import trimmed

PARAMS = fm.Params(screen=4.0, l1=1e-3)
KEEP_SHARE = 0.999
BINS = 16

_KINDS = np.full(256, 4, np.uint8)
_KINDS[[*range(97, 123), *range(128, 256)]] = 0
_KINDS[65:91] = 1
_KINDS[48:58] = 2
_KINDS[[9, 13, 32]] = 3
_KINDS[10] = 5
_KINDS[[33]] = 6
_KINDS[[44, 46]] = 7


def _statistics(g, w, distinct: np.ndarray) -> np.ndarray:
    """One row for each text of a group: statistics scaled to 0..1."""
    kind = _KINDS[g.data]
    size = np.maximum(np.diff(g.offsets), 1)
    shares = np.stack([segment_sums((kind == k).astype(np.int64), g.offsets) / size for k in range(1, 8)], 1)
    n = np.diff(w.first)
    chars = segment_sums(w.end - w.start, w.first)
    lines = shares[:, 4] * size + 1
    more = [chars / np.maximum(n, 1) / 20, distinct / np.maximum(n, 1), np.log1p(n) / 12, np.log1p(size / lines) / 10]
    return np.concatenate([shares**0.5, np.stack(more, 1)], 1)


def features(batch: pa.RecordBatch, known: fm.Model | None = None) -> fm.Features:
    """Features of columns ``text``, ``lang`` and ``source``; nulls in the latter two are a value of their own."""
    bits = PARAMS.bits
    mask = (1 << bits) - 1
    meta = []
    for name in ("lang", "source"):
        coded = pc.dictionary_encode(pc.fill_null(batch.column(name).cast(pa.string()), "\0"))
        hashed = np.array([xxhash.xxh3_64_intdigest(f"{name}={v}") & mask for v in coded.dictionary.to_pylist()], np.int64)
        meta.append(hashed[np.asarray(coded.indices)] if len(hashed) else np.empty(0, np.int64))
    first, bucket, x = [np.zeros(1, np.int64)], [], []
    for g in groups(batch.column("text")):
        w = words(next(groups(lowered(batch.column("text").slice(g.lo, g.hi - g.lo)), 1 << 62)))
        n = g.hi - g.lo
        b = (w.hash >> np.uint64(64 - bits)).astype(np.int64)
        at, b = fm.distinct(w.doc, b, n, bits)
        count = np.diff(at)
        stats = np.clip((_statistics(g, w, count) * BINS).astype(np.int64), 0, BINS - 1)
        stat = np.stack([_STATS[j][stats[:, j]] for j in range(stats.shape[1])], 1)
        extra = np.concatenate([stat, meta[0][g.lo : g.hi, None], meta[1][g.lo : g.hi, None]], 1)
        value = np.repeat(1 / np.sqrt(np.maximum(count, 1)), count)
        row = np.concatenate([np.repeat(np.arange(n), count), np.repeat(np.arange(n), extra.shape[1])])
        key, val = np.concatenate([b, extra.ravel()]), np.concatenate([value, np.ones(extra.size)])
        if known is not None:
            keep = np.flatnonzero(known.known(key))
            row, key, val = row[keep], key[keep], val[keep]
        order = np.argsort(row, kind="stable")
        first.append(np.searchsorted(row[order], np.arange(1, n + 1)) + first[-1][-1])
        bucket.append(key[order])
        x.append(val[order])
    return fm.Features(np.concatenate(first), np.concatenate(bucket) if bucket else np.empty(0, np.int64), np.concatenate(x) if x else np.empty(0))


_STATS = [np.array([xxhash.xxh3_64_intdigest(f"stat{j}={i}") & ((1 << PARAMS.bits) - 1) for i in range(BINS)], np.int64) for j in range(11)]


def train(docs: DataFrame, labels: DataFrame, params: fm.Params = PARAMS) -> fm.Model:
    """Model of low quality, fitted on at most ``params.sample`` labelled documents.

    The cut keeps ``KEEP_SHARE`` of the held-out good documents, and is 0.5 at least.
    """

    def cut(p: np.ndarray, y: np.ndarray) -> float:
        good = p[y == 0]
        return max(0.5, float(np.quantile(good, KEEP_SHARE))) if len(good) else 0.5

    return fm.train(docs, labels, 1 - F.col("quality"), features, ["text", "lang", "source"], params, cut)


def _low(batch: pa.RecordBatch, model: fm.Model) -> np.ndarray:
    return model.score(features(batch, model))


def quality_filter(docs: DataFrame, model: fm.Model) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns, in one pass without a shuffle.

    A null or empty text is judged by its statistics and metadata, one of any length as a whole. Repeated rows are judged
    each, and alike; an empty table stays empty. Without labelled rows of both classes nothing is rejected. Extra columns,
    whatever their names, are passed through.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                low = _low(b, model) if len(model.bucket) else np.zeros(b.num_rows)
                yield b.filter(pa.array(low <= model.cut))

    return docs.mapInArrow(trimmed(keep), docs.schema)


def kept_documents(docs: DataFrame, model: fm.Model) -> DataFrame:
    """(doc_id, quality) of the documents that :func:`quality_filter` keeps."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                low = _low(b, model) if len(model.bucket) else np.zeros(b.num_rows)
                at = np.flatnonzero(low <= model.cut)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array((1 - low[at]).round(6))], ["doc_id", "quality"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "lang", "source").mapInArrow(trimmed(keep), f"doc_id {kind}, quality double")
