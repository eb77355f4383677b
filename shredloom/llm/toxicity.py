"""Toxicity by a factorisation machine over hashed terms.

A text's terms are its distinct words and the stems (first 5, 6 and 7 bytes) of its words, the latter once
for each of ``LEVELS`` that their number reaches; one more feature has the text's length. The linear part
learns single insults, the factors learn pairs that are toxic only together, such as an insult with the
mention of a group, or a stem that is an insult in a short text but chance in a long one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredloom.llm import fm
from shredloom.llm.text import groups, lowered, words

PARAMS = fm.Params(screen=5.0, min_rows=8, l1=3e-4, epochs=20)
STEMS = (5, 6, 7)
LEVELS = (1, 2, 4)


def features(batch: pa.RecordBatch, known: fm.Model | None = None) -> fm.Features:
    """Hashed terms of column ``text``; with a model, only those that it has weights for."""
    bits, mask = PARAMS.bits, (1 << PARAMS.bits) - 1
    shift = np.uint64(64 - bits)
    first, bucket = [np.zeros(1, np.int64)], []
    for g in groups(lowered(batch.column("text"))):
        w = words(g)
        row, n = w.doc, g.hi - g.lo

        def kept(b: np.ndarray, levels: int, row: np.ndarray = row) -> tuple[np.ndarray, np.ndarray]:
            if known is None:
                return row, b
            at = np.flatnonzero(sum(known.known((b + j) & mask) for j in range(levels)))
            return row[at], b[at]

        r, b = kept((w.hash >> shift).astype(np.int64), 1)
        rows, terms = [r], [b]
        for size in STEMS:
            r, b = kept((w.prefix(size) >> shift).astype(np.int64) ^ size, len(LEVELS))
            key, count = np.unique((r << bits) | b, return_counts=True)
            for j, level in enumerate(LEVELS):
                at = key[count >= level]
                rows.append(at >> bits)
                terms.append(((at & mask) + j) & mask)
        some = np.flatnonzero(np.diff(w.first))
        rows.append(some)
        terms.append(_LENGTHS[np.log2(np.diff(w.first)[some]).astype(np.int64)])
        f, b = fm.distinct(np.concatenate(rows), np.concatenate(terms), n, bits)
        first.append(f[1:] + first[-1][-1])
        bucket.append(b)
    b = np.concatenate(bucket) if bucket else np.empty(0, np.int64)
    return fm.Features(np.concatenate(first), b, np.ones(len(b)))


_LENGTHS = np.array([xxhash.xxh3_64_intdigest(f"length={i}") & ((1 << PARAMS.bits) - 1) for i in range(64)], np.int64)


def train(docs: DataFrame, labels: DataFrame, params: fm.Params = PARAMS) -> fm.Model:
    """Model of ``labels.toxic``, fitted on at most ``params.sample`` labelled documents."""
    return fm.train(docs, labels, F.col("toxic"), features, ["text"], params)


def toxic_documents(docs: DataFrame, model: fm.Model) -> DataFrame:
    """(doc_id, toxicity, toxic) of every document whose toxicity reaches the model's cut.

    A null or empty text is not toxic; a text of any length is scored whole. Repeated rows give repeated results, a null
    id passes through. Other columns of ``docs`` are ignored, whatever their names. An empty table gives none, and
    without labelled rows of both classes nothing is found.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            f = features(b, model)
            p = np.where(np.diff(f.first) > 0, model.score(f), 0.0)
            hit = np.flatnonzero(p >= model.cut)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(hit)), pa.array(p[hit].round(6)), pa.array(np.ones(len(hit), bool))], ["doc_id", "toxicity", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, toxicity double, toxic boolean")
