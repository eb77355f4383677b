"""Words and hashes of whole Arrow string columns, computed on their byte buffers with numpy.

A word is a maximal run of ASCII letters, digits and non-ASCII bytes; everything else separates.
Nulls count as empty texts. Texts are taken in groups of about ``GROUP_BYTES`` so that memory stays
bounded; only a single longer text makes a longer group.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SOLID = np.arange(256) > 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """Words of a group of texts: ``doc`` is the row in the group, ``first[i]:first[i + 1]`` are row i's words."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    sums: np.ndarray = np.empty(0, np.uint64)

    def prefix(self, size: int) -> np.ndarray:
        """Hashes of the words' first ``size`` bytes, or of all where they are shorter."""
        return mix((self.sums[np.minimum(self.end, self.start + size)] - self.sums[self.start]) * _powers[1][self.start])

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class Group(NamedTuple):
    """Rows ``lo:hi`` of a column: their bytes, and offsets into these."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def groups(column: pa.Array | pa.ChunkedArray, limit: int = GROUP_BYTES) -> Iterator[Group]:
    """The column's texts in groups of consecutive rows of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield Group(lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def lowered(column: pa.Array) -> pa.Array:
    """Lower case; only columns with non-ASCII text pay for Unicode."""
    return pc.utf8_lower(column)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, GROUP_BYTES + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _UNBASE, np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that any of their bits can be used."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(group: Group, solid: bool = False, hashed: bool = True) -> Words:
    """Words of a group; with ``solid``, runs between whitespace and control characters instead."""
    data, offsets = group.data, group.offsets
    inside = (_SOLID if solid else _WORD)[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        before[edge[:-1]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
        after[edge[1:]] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    if not hashed:
        return Words(start, end, first, np.empty(0, np.uint64))
    up, down = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return Words(start, end, first, mix((sums[end] - sums[start]) * down[start]), sums)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words, and the index of each one's first word; none spans two rows."""
    n = len(w.hash)
    if n < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = w.hash[: n - size + 1].copy()
    for j in range(1, size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w.hash[j : n - size + 1 + j])
    left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(n)
    at = np.flatnonzero(left[: n - size + 1] >= size)
    return h[at], at


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]`` along the first axis; empty segments give 0."""
    total = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        total[full] = np.add.reduceat(values, first[:-1][full], axis=0)
    return total


def unused(columns: list[str], name: str) -> str:
    """A column name like ``name`` that none of ``columns`` has, whatever their case."""
    taken = {c.lower() for c in columns}
    while f"__{name}" in taken:
        name += "_"
    return f"__{name}"
