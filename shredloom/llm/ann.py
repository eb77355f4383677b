"""Approximate nearest neighbours by low-dimensional stable projections.

Every vector is projected to ``DIMS`` dimensions with Gaussian (2-stable) weights: the squared projected distance of two
vectors divided by their squared distance follows the chi-square distribution with ``DIMS`` degrees of freedom. The
projected points are indexed by a kd-tree. Its top levels divide them into cells of about ``CELL`` rows; every cell's
lower levels are built by one task, which writes the cell, leaf by leaf, as one file in the shared folder. Rows that the
tree can't separate, such as copies of one vector, are divided by a hash of their ids.

A query takes projected neighbours in order of rising distance, leaf by leaf, and verifies them by their true distances, until
a vector nearer than the k-th best found so far would project beyond the next leaf only with probability 1 - ``CERTAINTY``:
that is the chi-square stopping test. It visits cells in the same order, in rounds: its own cell, then the ``NEAR`` nearest
that the test doesn't rule out, then all others that it still doesn't. Only queries are shuffled in a round, and only cells
that some query visits are read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredloom.session import materialize, shared_dir

K = 10
DIMS = 8
CERTAINTY = 0.95
CELL = 16_384
NEAR = 4
LEAF = 64
PLAN_ROWS = 100_000
SEED = 11
_SLACK = 1e-9


def chi_square_quantile(p: float, dims: int) -> float:
    """x with P(chi-square(dims) <= x) = p, for an even number of degrees of freedom."""

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def _weights(dim: int, dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim, dims))


def kd_leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of each leaf of a kd-tree: medians of the widest dimension until ``size`` rows are left."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        p = points[rows]
        axis = int(np.argmax(p.max(0) - p.min(0)))
        half = len(rows) // 2
        order = np.argpartition(p[:, axis], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return done


class TopTree:
    """The upper levels: ``axis``, ``cut`` and children of each inner node; a negative child -i - 1 is place i."""

    def __init__(self, points: np.ndarray, cells: int) -> None:
        self.nodes: list[tuple[int, float, int, int]] = []
        self.places = 0
        self.root = self._grow(points, cells)
        self.boxes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.cells: dict[int, list[int]] = {}

    def _grow(self, points: np.ndarray, cells: int) -> int:
        if cells > 1 and len(points) > 1:
            axis = int(np.argmax(points.max(0) - points.min(0)))
            share = (cells // 2) / cells
            cut = float(np.quantile(points[:, axis], share))
            left = points[:, axis] < cut
            if left.any() and not left.all():
                at = len(self.nodes)
                self.nodes.append((axis, cut, 0, 0))
                self.nodes[at] = (axis, cut, self._grow(points[left], cells // 2), self._grow(points[~left], cells - cells // 2))
                return at
        self.places += 1
        return -self.places

    def place(self, points: np.ndarray) -> np.ndarray:
        """Place of each point."""
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            axis, cut, left, right = self.nodes[node]
            low = points[rows, axis] < cut
            todo += [(left, rows[low]), (right, rows[~low])]
        return out

    def fit_boxes(self, places: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Give every node the box of the cells below it; cell i lies in ``places[i]``."""
        for i, p in enumerate(places.tolist()):
            self.cells.setdefault(p, []).append(i)

        def box(node: int) -> tuple[np.ndarray, np.ndarray]:
            if node < 0:
                mine = self.cells.get(-node - 1, [])
                found = [(low[i], high[i]) for i in mine]
            else:
                found = [box(child) for child in self.nodes[node][2:]]
            bottom = np.min([x for x, _ in found], 0) if found else np.full(DIMS, np.inf)
            top = np.max([y for _, y in found], 0) if found else np.full(DIMS, -np.inf)
            self.boxes[node] = bottom, top
            return self.boxes[node]

        box(self.root)

    def reach(self, points: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, cell, squared distance) of all cells whose squared distance is within each point's bound, by descent."""
        rows_, cells_, gaps_ = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            low, high = self.boxes[node]
            gap = (np.maximum(np.maximum(low - points[rows], points[rows] - high), 0) ** 2).sum(1)
            near = gap <= bound[rows] * (1 + _SLACK) + _SLACK
            rows, gap = rows[near], gap[near]
            if not len(rows):
                continue
            if node >= 0:
                todo += [(child, rows) for child in self.nodes[node][2:]]
                continue
            for cell in self.cells.get(-node - 1, []):
                rows_.append(rows)
                cells_.append(np.full(len(rows), cell))
                gaps_.append(gap)
        return np.concatenate(rows_), np.concatenate(cells_), np.concatenate(gaps_)


class Cell(NamedTuple):
    """One cell's rows in the order of its leaves; ``rank`` is the order of the ids, ``first`` where leaves begin."""

    ids: pa.Array
    base: np.ndarray
    proj: np.ndarray
    rank: np.ndarray
    first: np.ndarray

    @classmethod
    def build(cls, table: pa.Table, dim: int) -> Cell:
        base, proj = _matrix(table.column("embedding"), dim), _matrix(table.column("proj"), DIMS)
        leaves = kd_leaves(proj, LEAF)
        order = np.concatenate(leaves)
        ids = table.column("vec_id").combine_chunks().take(pa.array(order))
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        return cls(ids, base[order], proj[order], rank, np.concatenate([[0], np.cumsum([len(x) for x in leaves])]))

    def save(self, uri: str) -> None:
        """The file appears whole or not at all, also if the task is repeated."""
        system, path = fs.FileSystem.from_uri(uri)
        part = f"{path}.{uuid.uuid4().hex}"
        leaf = np.zeros(len(self.ids), bool)
        leaf[self.first[:-1]] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]) for x in (self.base, self.proj)]
        table = pa.table({"vec_id": self.ids, "embedding": lists[0], "proj": lists[1], "rank": self.rank, "leaf": leaf})
        with system.open_output_stream(part) as out, pa.ipc.new_file(out, table.schema) as writer:
            writer.write_table(table)
        system.move(part, path)

    @classmethod
    def load(cls, uri: str) -> Cell:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            table = pa.ipc.open_file(file).read_all().combine_chunks()
        flat = [table.column(c).chunk(0).flatten().to_numpy().reshape(len(table), -1) for c in ("embedding", "proj")]
        first = np.append(np.flatnonzero(table.column("leaf").to_numpy()), len(table))
        return cls(table.column("vec_id").chunk(0), flat[0].astype(np.float64), flat[1], table.column("rank").to_numpy(), first)

    def search(self, query: np.ndarray, own: np.ndarray, proj: np.ndarray, far: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of each query's k nearest rows other than ``own``, of those not farther than ``far``.

        By distance, then by id: distances are taken from the vectors themselves wherever the order may hang on them.
        """
        first, norm = self.first, (self.base**2).sum(1)
        low, high = np.minimum.reduceat(self.proj, first[:-1]), np.maximum.reduceat(self.proj, first[:-1])
        done = []
        for block in kd_leaves(proj, LEAF):  # queries that are near each other search together
            q, qp, mine, best = query[block], proj[block], own[block], far[block] ** 2
            qn = (q**2).sum(1)
            box = (np.maximum(np.maximum(low[None] - qp[:, None], qp[:, None] - high[None]), 0) ** 2).sum(2)
            order = np.argsort(box.min(0), kind="stable")
            row, at, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for start in range(0, len(order), 8):
                reach = limit * best * (1 + _SLACK) + _SLACK
                if (box[:, order[start:]].min(1) > reach).all():
                    break
                some = order[start : start + 8]
                live = box[:, some] <= reach[:, None]
                rows = np.flatnonzero(live.any(1))
                if not len(rows):
                    continue
                take = np.concatenate([np.arange(first[x], first[x + 1]) for x in some[live.any(0)]])
                projected = (qp[rows] ** 2).sum(1)[:, None] + (self.proj[take] ** 2).sum(1)[None] - 2 * qp[rows] @ self.proj[take].T
                rough = qn[rows][:, None] + norm[take][None] - 2 * q[rows] @ self.base[take].T
                slack = _SLACK * (qn[rows][:, None] + norm[take][None])
                r, c = np.nonzero((projected <= reach[rows, None] + _SLACK) & (rough <= best[rows, None] + slack) & (mine[rows, None] != take[None]))
                r, c = rows[r], take[c]
                row, at, dist = np.concatenate([row, r]), np.concatenate([at, c]), np.concatenate([dist, ((q[r] - self.base[c]) ** 2).sum(1)])
                keep = np.lexsort([self.rank[at], dist, row])
                row, at, dist = row[keep], at[keep], dist[keep]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                full = nth == k - 1
                best[row[full]] = np.minimum(best[row[full]], dist[full])
                row, at, dist = row[nth < k], at[nth < k], dist[nth < k]
            done.append((block[row], at, np.sqrt(dist)))
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _clean(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)) & (F.size(x) > 0)
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & whole).dropDuplicates(["vec_id"])


def neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, certainty: float = CERTAINTY, cell_rows: int = CELL) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): about the k nearest vectors of every query, nearest first.

    ``queries`` has the columns of ``vectors``; without it every vector is one. A vector with the query's id is no
    neighbour. Rows with a null id, a null embedding, nulls or NaNs in it, or a length other than the most frequent one of
    ``vectors`` (of equally frequent ones the longest) have no neighbours and are none. Equal vectors are each other's
    neighbours at distance 0; ties go to the smaller id. Of rows that repeat an id one counts, no matter which. With fewer
    than k others, all are given. Ids are of any type that can be ordered. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    clean = _clean(vectors)
    sizes = clean.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], f"vec_id {kind}, neighbour_id {kind}, rank int, distance double")
    dim, n = sizes["dim"], sizes["count"]
    weights, limit = _weights(dim, DIMS), chi_square_quantile(certainty, DIMS)
    folder = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    number = vectors.schema["embedding"].dataType.elementType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), _lists(_matrix(b.column("embedding"), dim) @ weights)], ["vec_id", "embedding", "proj"])

    shape = f"vec_id {kind}, embedding array<{number}>, proj array<double>"
    points = clean.where(F.size("embedding") == dim).mapInArrow(project, shape)
    # where cells are cut needs no exactness: every row is placed, and boxes are taken from all rows
    plan = points.select("vec_id", "proj").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PLAN_ROWS).select("proj").toArrow()
    tree = TopTree(_matrix(plan.column("proj"), DIMS), -(-n // cell_rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.place(_matrix(b.column("proj"), DIMS)))], [*b.schema.names, "place"])

    placed = materialize(points.mapInArrow(place, shape + ", place bigint"), "placed")
    room = placed.groupBy("place").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / (2.0 * cell_rows))).alias("parts"))
    parted = placed.join(F.broadcast(room), "place").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        cell = Cell.build(table, dim)
        uri = f"{folder}/{key[0].as_py():08d}-{key[1].as_py():06d}"
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        cell.save(uri)
        return pa.table({"place": [key[0]], "uri": [uri], "low": [cell.proj.min(0)], "high": [cell.proj.max(0)]})

    cells = sorted(parted.groupBy("place", "part").applyInArrow(build, "place bigint, uri string, low array<double>, high array<double>").collect(), key=lambda c: c.uri)
    uris = [c.uri for c in cells]
    tree.fit_boxes(np.array([c.place for c in cells]), np.array([c.low for c in cells]), np.array([c.high for c in cells]))
    asked = placed.select("vec_id", "embedding", "proj") if queries is None else materialize(_clean(queries).where(F.size("embedding") == dim).mapInArrow(project, shape), "queries")
    routed_shape = f"cell bigint, {shape}, far double"
    found_shape = f"vec_id {kind}, distance double, neighbour_id {kind}"

    def visit(state: DataFrame, turn: int) -> DataFrame:
        """What the queries of ``state`` (vec_id, embedding, proj, far) find in the cells of one round."""

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 1000):
                    t = b.slice(lo, 1000)
                    p, far = _matrix(t.column("proj"), DIMS), t.column("far").to_numpy()
                    home = tree.place(p)
                    at = [np.array(tree.cells.get(i, []), np.int64) for i in home.tolist()]
                    row, to = np.repeat(np.arange(len(p)), [len(x) for x in at]), np.concatenate(at)
                    if turn:
                        seen = row * len(uris) + to
                        row, to, gap = tree.reach(p, limit * far**2)
                        other = ~np.isin(row * len(uris) + to, seen)
                        row, to, gap = row[other], to[other], gap[other]
                        order = np.lexsort([to, gap, row])
                        row, to = row[order], to[order]
                        nth = np.arange(len(row)) - np.searchsorted(row, row)
                        # what is nearer than the cells of the round before has been visited: bounds only get tighter
                        now = nth < NEAR if turn == 1 else nth >= NEAR
                        row, to = row[now], to[now]
                    if len(row):
                        s = t.take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([pa.array(to), *(s.column(c) for c in ("vec_id", "embedding", "proj", "far"))], ["cell", "vec_id", "embedding", "proj", "far"])

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: tuple[int, Cell] | None = None
            for b in batches:
                which = b.column("cell").to_numpy()
                for lo in np.flatnonzero(np.diff(which, prepend=-1)).tolist():
                    t = b.slice(lo, int(np.searchsorted(which[lo:], which[lo], "right")))
                    if held is None or held[0] != which[lo]:
                        held = int(which[lo]), Cell.load(uris[which[lo]])
                    cell = held[1]
                    own = pc.fill_null(pc.index_in(t.column("vec_id"), value_set=cell.ids), -1).to_numpy(zero_copy_only=False)
                    row, at, dist = cell.search(_matrix(t.column("embedding"), dim), own, _matrix(t.column("proj"), DIMS), t.column("far").to_numpy(), k, limit)
                    yield pa.RecordBatch.from_arrays([t.column("vec_id").take(pa.array(row)), pa.array(dist), cell.ids.take(pa.array(at))], ["vec_id", "distance", "neighbour_id"])

        routed = state.mapInArrow(route, routed_shape)
        # a cell that many queries visit is read by several tasks
        spread = routed.repartition(F.col("cell"), F.pmod(F.xxhash64("vec_id"), F.lit(16))).sortWithinPartitions("cell")
        return spread.mapInArrow(look, found_shape)

    nearest = F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), 1, k)
    best = None
    for turn in range(3):
        if best is None:
            state = asked.withColumn("far", F.lit(float("inf")))
            every = visit(state, turn)
        else:
            kth = best.select(F.col("vec_id").alias("id"), F.when(F.size("best") >= k, F.element_at("best", -1)["distance"]).alias("kth"))
            state = asked.join(kth, F.col("id") == F.col("vec_id"), "left").select("vec_id", "embedding", "proj", F.coalesce("kth", F.lit(float("inf"))).alias("far"))
            before = best.select("vec_id", F.explode("best").alias("f")).select("vec_id", "f.distance", "f.neighbour_id")
            every = before.unionByName(visit(state, turn))
        best = materialize(every.groupBy("vec_id").agg(nearest.alias("best")), "best")
    return best.select("vec_id", F.posexplode("best").alias("at", "f")).select("vec_id", F.col("f.neighbour_id").alias("neighbour_id"), (F.col("at") + 1).alias("rank"), F.round("f.distance", 6).alias("distance"))
