"""Second-order factorisation machine over hashed features, trained on a bounded labelled sample.

score = b + sum_f w_f x_f + 1/2 sum_k [(sum_f v_fk x_f)^2 - sum_f v_fk^2 x_f^2], linear in the number of
features of a row. Training is proximal AdaGrad: an L1 penalty leaves most linear weights at exactly zero.
Every feature with enough rows takes part in the factors, as a feature without any effect of its own may change
that of another: factors of features with a linear weight start at random. All others start at zero, where their gradient
is zero too, so that two features that both lack an effect of their own would never be found as a pair. Therefore every
pair of features that are frequent enough to tell is tested on what the linear part leaves: a pair whose rows differ
from those with one of the two alone starts with factors of its own, and both get linear weights. An L1 penalty takes
factors away again that don't help. Features with fewer rows have neither, so that the model can be sent
to every task. Its size is bounded by the number of hash buckets.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shredloom.llm.text import segment_sums
from shredloom.session import batches_of, trimmed

BATCH_ROWS = 1000


@dataclass(frozen=True)
class Params:
    """``sample`` bounds the labelled rows that training sees; everything else covers all data.

    Features in fewer than ``min_rows`` of these are left out before training; those whose share differs between
    the two classes by fewer than ``screen`` standard errors have factors, but no linear weight. Pairs are tested
    among features of at least ``pair_share`` of the rows, and start with factors from ``pair_screen`` standard errors on.
    """

    bits: int = 20
    factors: int = 4
    sample: int = 8192
    min_rows: int = 4
    screen: float = 0.0
    pair_share: float = 0.02
    pair_screen: float = 7.0
    epochs: int = 12
    factor_epochs: int = 6
    rate: float = 0.3
    l1: float = 1e-3
    l2: float = 1e-4
    factor_l1: float = 1e-3
    seed: int = 17


@dataclass
class Features:
    """Rows of hashed features: row i has ``bucket[first[i]:first[i + 1]]``, each once, with values ``x``."""

    first: np.ndarray
    bucket: np.ndarray
    x: np.ndarray


@dataclass
class Model:
    bits: int
    bias: float
    bucket: np.ndarray
    w: np.ndarray
    v: np.ndarray
    cut: float = 0.5

    def __post_init__(self) -> None:
        self._at: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_at": None}

    def known(self, bucket: np.ndarray) -> np.ndarray:
        """Index + 1 of each bucket's weights; 0 where it has none."""
        if self._at is None:
            self._at = np.zeros(1 << self.bits, np.int32)
            self._at[self.bucket] = np.arange(1, len(self.bucket) + 1)
        return self._at[bucket]

    def score(self, f: Features) -> np.ndarray:
        """Probability of the positive class for each row."""
        at = self.known(f.bucket)
        keep = np.flatnonzero(at)
        first = np.searchsorted(keep, f.first)
        at, x = at[keep] - 1, f.x[keep]
        return 1 / (1 + np.exp(-_raw(self.bias, self.w[at], self.v[at], x, first)))


def _raw(bias: float, w: np.ndarray, v: np.ndarray, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    vx = v * x[:, None]
    pairs = (segment_sums(vx, first) ** 2 - segment_sums(vx**2, first)).sum(1) / 2
    return _linear(bias, w, x, first, pairs)


def _linear(bias: float, w: np.ndarray, x: np.ndarray, first: np.ndarray, pairs: np.ndarray | float = 0.0) -> np.ndarray:
    return np.clip(bias + segment_sums(w * x, first) + pairs, -30, 30)


def fit(f: Features, y: np.ndarray, p: Params) -> Model:
    """Train on rows ``f`` with 0/1 labels ``y``. With one class only, every row gets that class's share."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1) if n else 0.0
    none = np.empty(0, np.int64)
    if n == 0 or share * (n + 1) < 1 or share * (n + 1) > n:
        return Model(p.bits, float(np.log((share + 1e-6) / (1 - share + 1e-6))), none, np.empty(0), np.empty((0, p.factors)))
    rows = np.bincount(f.bucket, minlength=1 << p.bits)
    ones = np.bincount(f.bucket, np.repeat(y, np.diff(f.first)), 1 << p.bits)
    mean = rows / n
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.abs(ones / y.sum() - (rows - ones) / (n - y.sum())) / np.sqrt(mean * (1 - mean) * (1 / y.sum() + 1 / (n - y.sum())))
    used = np.flatnonzero(rows >= p.min_rows)
    linear = ((z >= p.screen) | (mean == 1))[used]
    to = np.full(1 << p.bits, -1)
    to[used] = np.arange(len(used))
    at = to[f.bucket]
    keep = np.flatnonzero(at >= 0)
    first, at, x = np.searchsorted(keep, f.first), at[keep].astype(np.int32), f.x[keep]
    del keep
    rng = np.random.default_rng(p.seed)
    m, k = len(used), p.factors
    w, v = np.zeros(m), np.zeros((m, k))
    gw, gb = np.full(m, 1e-6), 1e-6
    gv = np.full((m, k), 1e-6)
    bias = float(np.log(share / (1 - share)))
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for epoch in range(p.epochs + p.factor_epochs):
        second = epoch >= p.epochs
        if epoch == p.epochs:
            anchor = w != 0
            v[anchor] = rng.normal(0, 0.05, (int(anchor.sum()), k))
            left = y - 1 / (1 + np.exp(-_linear(bias, w[at], x, first)))  # factors of all entries at once would take most of the memory
            for i, j, sign in zip(*_pairs(first, at, left, np.flatnonzero(rows[used] >= max(p.min_rows, p.pair_share * n)), p.pair_screen)):
                way = rng.normal(size=k)
                way *= 0.7 / np.sqrt((way**2).sum())
                v[i] += way
                v[j] += sign * way
                linear[[i, j]] = True
        for batch in np.array_split(rng.permutation(n), max(1, n // 256)):
            size = first[batch + 1] - first[batch]
            ends = np.concatenate([[0], np.cumsum(size)])
            pick = np.arange(ends[-1]) + np.repeat(first[batch] - ends[:-1], size)
            a, z = at[pick], x[pick]
            p1 = 1 / (1 + np.exp(-_raw(bias, w[a], v[a], z, ends)))
            g = (p1 - y[batch]) * weight[batch] / len(batch)
            each = np.repeat(g, size)
            seen, local = np.unique(a, return_inverse=True)
            d = np.bincount(local, each * z, len(seen))
            gw[seen] += d**2
            step = p.rate / np.sqrt(gw[seen])
            moved = w[seen] - step * d
            w[seen] = np.sign(moved) * np.maximum(np.abs(moved) - step * p.l1, 0) * linear[seen]
            gb += g.sum() ** 2
            bias -= p.rate * g.sum() / np.sqrt(gb)
            if second:
                va = v[a]
                inner = segment_sums(va * z[:, None], ends)
                each_v = (each * z)[:, None] * (np.repeat(inner, size, axis=0) - va * z[:, None])
                dv = np.stack([np.bincount(local, each_v[:, j], len(seen)) for j in range(k)], 1) + p.l2 * v[seen]
                gv[seen] += dv**2
                step = 0.3 * p.rate / np.sqrt(gv[seen] + 1e-3)
                moved = v[seen] - step * dv
                v[seen] = np.sign(moved) * np.maximum(np.abs(moved) - step * p.factor_l1, 0)
    left = np.flatnonzero((w != 0) | (v != 0).any(1))
    return Model(p.bits, bias, used[left], w[left], v[left])


def _pairs(first: np.ndarray, at: np.ndarray, left: np.ndarray, some: np.ndarray, screen: float) -> tuple[list[int], list[int], list[int]]:
    """Pairs of the features ``some`` on whose common rows the mean of ``left`` differs from that of either one alone.

    (feature, feature, sign of the difference). Of features that occur in the same rows one stands for all.
    """
    n, m = len(left), max(int(at.max(initial=-1)), int(some.max(initial=-1))) + 1
    to = np.full(m, -1)
    to[some] = np.arange(len(some))
    col = to[at]
    keep = np.flatnonzero(col >= 0)
    row = np.repeat(np.arange(n), np.diff(first))[keep]
    own = np.bincount(col[keep], _marks(n)[row], len(some))
    _, one = np.unique(own, return_index=True)
    one.sort()
    back = np.full(len(some), -1)
    back[one] = np.arange(len(one))
    keep, row = keep[back[col[keep]] >= 0], row[back[col[keep]] >= 0]
    has = np.zeros((n, len(one)), np.float32)
    has[row, back[col[keep]]] = 1
    each, sums = has.sum(0), left.astype(np.float32) @ has
    found: tuple[list[int], list[int], list[int]] = [], [], []
    for lo in range(0, len(one), 512):
        block = has[:, lo : lo + 512]
        both, total = block.T @ has, (block * left[:, None].astype(np.float32)).T @ has
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = total / both
            z = []
            for n1, s1 in ((each[lo : lo + 512, None], sums[lo : lo + 512, None]), (each[None], sums[None])):
                alone = n1 - both
                z.append((mean - (s1 - total) / alone) / np.sqrt(0.25 / both + 0.25 / alone))
        sure = (np.minimum(np.abs(z[0]), np.abs(z[1])) >= screen) & (z[0] * z[1] > 0)  # not a number where rows lack
        i, j = np.nonzero(sure)
        ahead = i + lo < j
        found[0].extend(some[one[i[ahead] + lo]].tolist())
        found[1].extend(some[one[j[ahead]]].tolist())
        found[2].extend(np.sign(z[0][i, j][ahead]).astype(int).tolist())
    return found


def _marks(n: int) -> np.ndarray:
    return np.random.default_rng(1).random(n)


def train(docs: DataFrame, labels: DataFrame, label: Column, featurise: Callable[[pa.RecordBatch], Features], columns: list[str], p: Params, pick_cut: Callable[[np.ndarray, np.ndarray], float] | None = None) -> Model:
    """Fit on at most ``p.sample`` labelled documents: those whose ids have the smallest hashes.

    ``labels`` may repeat a document; it is positive if any of its rows is. Rows with a null id or label are
    not used. ``pick_cut`` chooses the cut from the scores of a fifth that is held out.
    """
    known = labels.select(F.col("doc_id").alias("doc_id"), label.cast("int").alias("__y")).where("doc_id is not null and __y is not null")
    known = known.groupBy("doc_id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    # training is one task, but finding its rows isn't: they are shuffled to it, p.sample at most
    # at most p.sample rows of two numbers: safe to send to every task whatever the size of the tables
    chosen = docs.select("doc_id", *columns).join(F.broadcast(known), "doc_id").select("__y", *columns)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, bucket, x, y = [np.zeros(1, np.int64)], [], [], []
        for b in batches:
            f = featurise(b)
            first.append(f.first[1:] + first[-1][-1])
            bucket.append(f.bucket)
            x.append(f.x)
            y.append(np.asarray(b.column("__y")))
        if not y:
            return
        f, t = Features(np.concatenate(first), np.concatenate(bucket), np.concatenate(x)), np.concatenate(y).astype(float)
        del b, first, bucket, x
        # the order in which rows arrive differs between runs: put them in an order of their own
        order = _order(f, t)
        f, t = _rows(f, order), t[order]
        if pick_cut is None:
            model = fit(f, t, p)
        else:
            held = np.arange(len(t)) % 5 == 0
            trial = fit(_rows(f, np.flatnonzero(~held)), t[~held], p)
            model = fit(f, t, p)
            model.cut = pick_cut(trial.score(_rows(f, np.flatnonzero(held))), t[held])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    with batches_of(docs.sparkSession, BATCH_ROWS):
        found = chosen.repartition(1).mapInArrow(trimmed(learn), T.StructType([T.StructField("model", T.BinaryType())])).collect()
    return pickle.loads(found[0].model) if found else fit(Features(np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0)), np.empty(0), p)


def _order(f: Features, y: np.ndarray) -> np.ndarray:
    import xxhash

    return np.argsort(np.array([xxhash.xxh3_64_intdigest(f.bucket[a:b].tobytes(), int(c)) for a, b, c in zip(f.first[:-1], f.first[1:], y)], np.uint64), kind="stable")


def _rows(f: Features, rows: np.ndarray) -> Features:
    size = f.first[rows + 1] - f.first[rows]
    ends = np.concatenate([[0], np.cumsum(size)])
    pick = np.arange(ends[-1]) + np.repeat(f.first[rows] - ends[:-1], size)
    return Features(ends, f.bucket[pick], f.x[pick])


def distinct(row: np.ndarray, bucket: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct buckets in order, and where each row's begin."""
    key = np.unique((row.astype(np.int64) << bits) | bucket.astype(np.int64))
    return np.searchsorted(key >> bits, np.arange(n + 1)), key & ((1 << bits) - 1)
