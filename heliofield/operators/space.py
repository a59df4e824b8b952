"""Space cut into parts of like count: a k-d tree fitted on a bounded sample, whose leaves are what a task searches.

``Tree`` serves twice. On the driver its leaves are cells of some ``CELL`` points; in a task its leaves are what one step compares. A point goes to its cell and to
the cells whose margin it is in; a margin is about as wide as k neighbours need, and never holds much more than its cell. So most queries are answered in their cell,
where their neighbours' values are at hand, and leave it as one row: no list of pairs is made. Only queries whose ball leaves the margin go on, to the cells that the
ball meets, and are then done. So there are two rounds at any density. Places that the sample shows to hold much of a cell are searched once: of their points only the
k of least id can be among the nearest, and all queries there have the same answer.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ByteType, DoubleType, IntegerType, LongType, StructField, StructType

from heliofield.functions.packaging import ship
from heliofield.functions.storage import save

#: The tree is fitted on this many points at most, and has this many cells at most.
SAMPLE, MOST_CELLS = 1 << 19, 1 << 15
#: Points meant for a cell, and queries that one task takes of a cell.
CELL, QUERIES = 8192, 65_536
#: Cells of large clouds hold up to so many times ``CELL`` points, which saves copies in margins; a cell with its margin holds so many times its points at most.
WIDER, CROWDED = 4, 4
#: Points of a leaf within a task, at least; queries of a step; entries of a table of distances.
LEAF, STEP, TABLE = 32, 64, 1 << 21


class Tree:
    """Splits at medians of the widest side, down to ``leaf`` points; equal points stay together."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.axis, self.value, self.left, self.right, self.leaf_of = [], [], [], [], []
        self.leaves: list[np.ndarray] = []
        self._grow(points, np.arange(len(points)), max(leaf, 1))
        self.axis, self.left, self.right, self.leaf_of = (np.array(x, np.int32) for x in (self.axis, self.left, self.right, self.leaf_of))
        self.value = np.array(self.value)

    def _node(self, axis: int = -1, value: float = 0.0, leaf: int = -1) -> int:
        for column, x in ((self.axis, axis), (self.value, value), (self.left, -1), (self.right, -1), (self.leaf_of, leaf)):
            column.append(x)
        return len(self.axis) - 1

    def _grow(self, points: np.ndarray, first: np.ndarray, leaf: int) -> None:
        todo = [(first, -1, False)]
        while todo:
            own, parent, side = todo.pop()
            node = -1
            if len(own) > leaf:
                at = points[own]
                low, high = at.min(0), at.max(0)
                axis = int(np.argmax(high - low))
                if high[axis] > low[axis]:
                    v = at[:, axis]
                    cut = np.partition(v, len(v) // 2)[len(v) // 2]
                    if cut == low[axis]:
                        cut = v[v > cut].min()
                    node = self._node(axis, float(cut))
                    under = v < cut
                    todo += [(own[~under], node, True), (own[under], node, False)]
            if node < 0:
                node = self._node(leaf=len(self.leaves))
                self.leaves.append(own)
            if parent >= 0:
                (self.right if side else self.left)[parent] = node

    def locate(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each place is in."""
        node, todo = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(todo := todo[self.axis[node[todo]] >= 0]):
            n = node[todo]
            node[todo] = np.where(x[todo, self.axis[n]] < self.value[n], self.left[n], self.right[n])
        return self.leaf_of[node].astype(np.int64)

    def regions(self, sides: int) -> tuple[np.ndarray, np.ndarray]:
        """The part of space of each leaf: least and greatest coordinates, infinite outside."""
        low, high = np.full((len(self.axis), sides), -np.inf), np.full((len(self.axis), sides), np.inf)
        for node in np.flatnonzero(self.axis >= 0):  # parents come first
            a, own = self.axis[node], (self.left[node], self.right[node])
            low[own, :], high[own, :] = low[node], high[node]
            high[own[0], a] = low[own[1], a] = self.value[node]
        at = np.flatnonzero(self.axis < 0)
        order = at[np.argsort(self.leaf_of[at])]
        return low[order], high[order]

    def boxes(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each node, the box about its leaves' boxes."""
        a, b = np.empty((len(self.axis), low.shape[1])), np.empty((len(self.axis), low.shape[1]))
        for node in range(len(self.axis) - 1, -1, -1):
            if self.axis[node] < 0:
                a[node], b[node] = low[self.leaf_of[node]], high[self.leaf_of[node]]
            else:
                own = self.left[node], self.right[node]
                a[node], b[node] = np.minimum(a[own[0]], a[own[1]]), np.maximum(b[own[0]], b[own[1]])
        return a, b

    def spread(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, leaf) of all leaves whose box holds the place; boxes are of nodes."""
        places, leaves, place, node = [], [], np.arange(len(x)), np.zeros(len(x), np.int64)
        while len(place):
            done = self.axis[node] < 0
            places.append(place[done])
            leaves.append(self.leaf_of[node[done]].astype(np.int64))
            place, node = place[~done], node[~done]
            place, node = np.concatenate([place, place]), np.concatenate([self.left[node], self.right[node]])
            held = np.ones(len(place), bool)
            for a in range(x.shape[1]):
                v = x[place, a]
                held &= (v >= low[node, a]) & (v <= high[node, a])
            place, node = place[held], node[held]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *places]), np.concatenate([none, *leaves])

    def reach(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, leaf) of all leaves that a box of ``radius`` about each place meets."""
        places, leaves, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if self.axis[node] < 0:
                places.append(own)
                leaves.append(np.full(len(own), self.leaf_of[node], np.int64))
                continue
            v = x[own, self.axis[node]]
            todo += [(self.left[node], own[v - radius[own] < self.value[node]]), (self.right[node], own[v + radius[own] >= self.value[node]])]
        none = np.zeros(0, np.int64)
        return np.concatenate(places) if places else none, np.concatenate(leaves) if leaves else none


class Searcher:
    """The points of one cell, for many searches."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        self.order, self.points, self.ids, self.k = order, points[order], ids[order], k
        self.columns = [np.ascontiguousarray(self.points[:, a]) for a in range(points.shape[1])]
        self.tree = Tree(self.points, max(LEAF, 2 * k))
        self.leaves = self.tree.leaves if len(points) else []
        self.sizes = np.array([len(own) for own in self.leaves], np.int64)
        self.low, self.high = (np.array([f(self.points[own], axis=0) for own in self.leaves]).reshape(-1, points.shape[1]) for f in (np.min, np.max))
        #: Some points of each leaf, k if it has as many: they bound the k-th distance of a place there.
        width = max(k, int(min(self.sizes.max(initial=0), max(LEAF, 2 * k))))
        self.some = np.full((len(self.leaves), width), -1, np.int64)
        for i, own in enumerate(self.leaves):
            self.some[i, : min(len(own), width)] = own[:width]

    def _bounds(self, x: np.ndarray) -> np.ndarray:
        """Squared radii that hold k points, as far as each place's leaf has as many."""
        out = np.full(len(x), np.inf)
        leaf = self.tree.locate(x)
        step = max(TABLE // self.some.shape[1], 1)
        for i in range(0, len(x), step):
            own = self.some[leaf[i : i + step]]
            d = sum((x[i : i + step, a, None] - c[own]) ** 2 for a, c in enumerate(self.columns))
            d[own < 0] = np.inf
            out[i : i + step] = np.partition(d, self.k - 1, axis=1)[:, self.k - 1]
        return out

    def lists(self, x: np.ndarray, within: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(points, distances, number found): each place's k nearest within a distance, by distance and id; what is beyond the number has no meaning."""
        which, dist, count = np.zeros((len(x), self.k), np.int32), np.full((len(x), self.k), np.inf), np.zeros(len(x), np.int32)
        if not len(self.points) or not len(x):
            return which, dist, count
        within = np.broadcast_to(np.asarray(within, float), len(x))
        bound = np.minimum(self._bounds(x), within * within)
        for group in Tree(x, STEP).leaves:
            for at in range(0, len(group), 2 * STEP):
                own = group[at : at + 2 * STEP]
                low, high, most = x[own].min(0), x[own].max(0), bound[own].max()
                if not most < np.inf:  # a leaf of few points: as many leaves as hold k bound it
                    far = (np.maximum(self.high - low, high - self.low) ** 2).sum(1)
                    order = np.argsort(far, kind="stable")
                    enough = np.searchsorted(np.cumsum(self.sizes[order]), self.k)
                    most = far[order[enough]] if enough < len(order) else np.inf
                gap = (np.maximum(np.maximum(self.low - high, low - self.high), 0) ** 2).sum(1)
                met = np.flatnonzero(gap <= most * (1 + 1e-9) + 1e-24)
                if not len(met):
                    continue
                near = np.sort(np.concatenate([self.leaves[m] for m in met]))  # by id
                columns = [c[near] for c in self.columns]
                step = max(TABLE // len(near), 1)
                for i in range(0, len(own), step):
                    self._least(x, own[i : i + step], near, columns, within, which, dist, count)
        return which, dist, count

    def _least(self, x: np.ndarray, own: np.ndarray, near: np.ndarray, columns: list[np.ndarray], within: np.ndarray, which: np.ndarray, dist: np.ndarray, count: np.ndarray) -> None:
        d = None
        for a, c in enumerate(columns):
            v = x[own, a, None] - c
            v *= v
            d = v if d is None else np.add(d, v, out=d)
        reach = np.square(within[own]) * (1 + 1e-12)
        if d.shape[1] > self.k:
            reach = np.minimum(reach, np.partition(d, self.k - 1, axis=1)[:, self.k - 1] * (1 + 1e-12))  # squares a little apart may have one root
        row, column = np.nonzero(d <= reach[:, None])
        value = np.sqrt(d[row, column])
        order = np.lexsort((value, row))
        row, column, value = row[order], column[order], value[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = (rank < self.k) & (value <= within[own[row]])
        row, column, value, rank = row[keep], column[keep], value[keep], rank[keep]
        which[own[row], rank], dist[own[row], rank] = near[column], value
        count[own] = np.bincount(row, minlength=len(own))

    def nearest(self, x: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, point, distance) of each place's k nearest, within ``bound`` if that is given; by place, distance and id."""
        which, dist, count = self.lists(x, np.inf if bound is None else bound)
        place, rank = np.nonzero(np.arange(self.k) < count[:, None])
        return place, which[place, rank], dist[place, rank]


class Found(NamedTuple):
    """Neighbours of some places, as many each, by distance and id: ids, distances (n, c), coordinates (n, c, axes) and values (n, c, values)."""

    ids: np.ndarray
    dist: np.ndarray
    at: np.ndarray
    values: np.ndarray


#: What a query's neighbours become: a column each of the fold's schema.
Fold = Callable[[Found], list]


def _matrix(batch: pa.RecordBatch | pa.Table, first: int, n: int) -> np.ndarray:
    return np.stack([np.asarray(batch.column(first + i), dtype=float) for i in range(n)], 1) if n else np.zeros((batch.num_rows, 0))


def _real(batch: pa.RecordBatch, sides: int) -> pa.RecordBatch:
    """Rows (id, axes, ...) that have a place. Not a filter in Spark, which would compute the columns' expressions once more for each test of them."""
    odd = np.isnan(_matrix(batch, 1, sides)).any(1)
    return batch.filter(pa.array(~odd)) if odd.any() else batch


def _sampled(points: DataFrame, axes: str) -> tuple[np.ndarray, int]:
    n = points.count()
    some = points.select(*axes)
    table = (some.sample(False, SAMPLE / n, 7) if n > SAMPLE else some).toArrow()
    places = _matrix(table, 0, len(axes))
    return places[~np.isnan(places).any(1)], n


def _hot(sample: np.ndarray, cells: int, n: int) -> np.ndarray:
    """Places that hold a quarter of a cell's share of the sample; there are at most four a cell."""
    place, times = np.unique(sample, axis=0, return_counts=True) if len(sample) else (sample, np.zeros(0, int))
    return place[(times >= max(len(sample) / cells / 4, 8)) & (times * (n / max(len(sample), 1)) > CELL / 4)]


def _share(ids: np.ndarray, shares: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % shares


def _margins(tree: Tree, sample: np.ndarray, n: int, k: int, within: float) -> np.ndarray:
    """Widths about cells that hold the k nearest of most of their points, as far as a cell doesn't get much larger by it. A guess by the sample: answers don't depend on it."""
    leaves, sides = len(tree.leaves), sample.shape[1]
    width = np.zeros(leaves)
    if leaves == 1:
        return width
    home = tree.locate(sample)
    own = np.bincount(home, minlength=leaves)
    wanted = 1.6 * k + 6 * math.sqrt(k) + 6
    low, high = np.full((leaves, sides), np.inf), np.full((leaves, sides), -np.inf)
    np.minimum.at(low, home, sample)
    np.maximum.at(high, home, sample)
    side = np.sort(np.maximum(high - low, 0), axis=1)[:, ::-1]
    ball = {1: 2.0, 2: math.pi, 3: 4 * math.pi / 3}
    for cell in np.flatnonzero(own > 1):
        for used in range(sides, 0, -1):  # thin sides don't count
            width[cell] = (wanted / (own[cell] * n / len(sample)) * side[cell, :used].prod() / ball[used]) ** (1 / used)
            if 2 * width[cell] <= side[cell, used - 1]:
                break
    width = np.minimum(width, within * (1 + 1e-6) + 1e-9)
    least, most = tree.regions(sides)
    for step in range(24):
        box = tree.boxes(least - width[:, None], most + width[:, None])
        held = np.bincount(tree.spread(sample, *box)[1], minlength=leaves)
        crowded = (held > CROWDED * own + 8) & (width > 0)
        if not crowded.any():
            return width
        width[crowded] = width[crowded] / 2 if step < 20 else 0
    return width


def nearest_in_groups(rows: DataFrame, axes: str, k: int, values: tuple[str, ...] | None = None) -> DataFrame:
    """(pid, nid, dist): the k nearest in the same cell, within ``bound`` where that is set. ``rows``: cell, kind (0 points, 1 queries), id, axes, bound and values.

    With ``values`` also the query's axes, and the axes (n...) and values of the neighbour."""
    more = [] if values is None else [*axes, *(f"n{c}" for c in axes), *values]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, searcher, held = None, [], None, None

        def built() -> tuple[Searcher, np.ndarray]:
            own = [np.concatenate(p) for p in zip(*waiting, strict=True)] if waiting else [np.zeros((0, len(axes))), np.zeros(0, np.int64), np.zeros((0, len(values or ())))]
            out = Searcher(own[0], own[1], k)
            return out, own[2][out.order]

        for batch in batches:
            own, kind = (np.asarray(batch.column(i)) for i in (0, 1))
            cuts = [0, *(np.flatnonzero((np.diff(own) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if own[a] != cell:
                    cell, waiting, searcher = own[a], [], None
                if not kind[a]:
                    waiting.append((_matrix(part, 3, len(axes)), np.asarray(part.column(2)), _matrix(part, 4 + len(axes), len(values or ()))))
                    continue
                if searcher is None:
                    (searcher, held), waiting = built(), []
                x = _matrix(part, 3, len(axes))
                place, near, dist = searcher.nearest(x, np.asarray(part.column(3 + len(axes)), dtype=float))
                out = [np.asarray(part.column(2))[place], searcher.ids[near], dist]
                if values is not None:
                    out += [*x[place].T, *searcher.points[near].T, *held[near].T]
                for i in range(0, len(place), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 17)]) for c in out], names=["pid", "nid", "dist", *more])

    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(search, ", ".join(["pid long, nid long, dist double", *(f"{c} double" for c in more)]))


def _folded(fold: Fold, kind: StructType) -> Callable[[Found], list[pa.Array]]:
    types = [to_arrow_type(f.dataType) for f in kind]

    def columns(found: Found) -> list[pa.Array]:
        if not found.ids.shape[1]:
            return [pa.nulls(len(found.ids), t) for t in types]
        return [c if isinstance(c, pa.Array) else pa.array(c, t, from_pandas=True) for c, t in zip(fold(found), types, strict=True)]

    return columns


class _Search:
    """One search: what its two rounds share. A placed row is a point (kind 0), a point and a query (1) or a query (2), in the cell numbered leaf * 2^20 and a share;
    a cell with many queries is searched by several tasks, each with all of its points."""

    def __init__(self, points: DataFrame, tree: Tree, margins: np.ndarray, k: int, fold: Fold, kind: StructType, axes: str, values: tuple[str, ...], within: float):
        self.spark, self.points, self.tree, self.k, self.fold, self.kind, self.axes, self.values, self.within = points.sparkSession, points, tree, k, fold, kind, axes, values, within
        least, most = tree.regions(len(axes))
        self.low, self.high = least - margins[:, None], most + margins[:, None]
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _placed(self, df: DataFrame, kind: int, shares: np.ndarray, carry: StructType) -> DataFrame:
        axes, values, n = self.axes, self.values, 1 + len(self.axes)
        sent = self.spark.sparkContext.broadcast((self.tree, self.tree.boxes(self.low, self.high), shares))
        names = ["cell", "kind", "id", *axes, *values, *carry.names]
        kept = [to_arrow_type(f.dataType) for f in carry]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, box, shares = sent.value
            for batch in batches:
                batch = _real(batch, len(axes))
                x, ids = _matrix(batch, 1, len(axes)), np.asarray(batch.column(0))
                home = tree.locate(x)
                if kind == 2:
                    at, leaf, share, role = np.arange(len(x)), home, _share(ids, shares[home]), np.full(len(x), 2, np.int8)
                else:
                    at, leaf = tree.spread(x, *box)
                    times = shares[leaf]
                    at, leaf = np.repeat(at, times), np.repeat(leaf, times)
                    share = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                    asked = (leaf == home[at]) & (share == _share(ids[at], shares[leaf])) if kind else np.zeros(len(at), bool)
                    role = asked.astype(np.int8)
                row = pa.array(at, mask=role == 0)  # what is carried goes with the query only
                own = [batch.column(n + i).take(pa.array(at)) if kind < 2 else pa.nulls(len(at), pa.float64()) for i in range(len(values))]
                first = n + (len(values) if kind < 2 else 0)
                with_it = [batch.column(first + i).take(row) if kind else pa.nulls(len(at), t) for i, t in enumerate(kept)]
                yield pa.RecordBatch.from_arrays([pa.array((leaf << 20) + share), pa.array(role), pa.array(ids[at]), *(pa.array(x[at, a]) for a in range(len(axes))), *own, *with_it], names=names)

        schema = StructType([StructField("cell", LongType()), StructField("kind", ByteType()), StructField("id", LongType()), *(StructField(c, DoubleType()) for c in (*axes, *values)), *(StructField(f.name, f.dataType) for f in carry)])
        return df.mapInArrow(place, schema)

    def run(self, queries: DataFrame | None, carry: StructType, shares: np.ndarray) -> DataFrame:
        """pid, axes, carry, found, and the fold's columns: both rounds. Without ``queries`` the points are."""
        axes, values, k, within = self.axes, self.values, self.k, self.within
        if queries is None:
            rows = self._placed(self.points, 1, shares, carry)
        else:
            rows = self._placed(self.points.select("pid", *axes, *values), 0, shares, carry).unionByName(self._placed(queries, 2, shares, carry))
        sent = self.spark.sparkContext.broadcast((self.low, self.high))
        columns, types, names = _folded(self.fold, self.kind), [to_arrow_type(f.dataType) for f in self.kind], ["pid", *axes, *carry.names, "found", *self.kind.names, "bound"]
        first = 3 + len(axes) + len(values)

        def answered(searcher: Searcher, held: np.ndarray, asked: pa.RecordBatch, leaf: int) -> Iterator[pa.RecordBatch]:
            low, high = sent.value
            x = _matrix(asked, 3, len(axes))
            which, dist, count = searcher.lists(x, within)
            margin = np.minimum(x - low[leaf], high[leaf] - x).min(1)
            reach = np.minimum(np.where(count == k, dist[:, k - 1], np.inf), within)
            closed = (margin == np.inf) | (reach * (1 + 1e-9) + 1e-12 < margin)
            for c in (*np.unique(count[closed]).tolist(), None):
                own = np.flatnonzero(~closed if c is None else closed & (count == c))
                if not len(own):
                    continue
                part = asked.take(pa.array(own))
                if c is None:
                    out = [*(pa.nulls(len(own), t) for t in (pa.int32(), *types)), pa.array(reach[own])]
                else:
                    near = which[own, :c]
                    out = [pa.array(np.full(len(own), c, np.int32)), *columns(Found(searcher.ids[near], dist[own, :c], searcher.points[near], held[near])), pa.nulls(len(own), pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(2), *(part.column(3 + a) for a in range(len(axes))), *(part.column(first + i) for i in range(len(carry))), *out], names=names)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, waiting, searcher, held = None, [], None, np.zeros(0)

            def built(schema: pa.Schema) -> Iterator[pa.RecordBatch]:
                """The cell's points are all there; those that are queries are answered."""
                nonlocal searcher, held
                own = pa.Table.from_batches(waiting, schema).combine_chunks()
                waiting.clear()
                searcher = Searcher(_matrix(own, 3, len(axes)), np.asarray(own.column(2)), k)
                held = _matrix(own, 3 + len(axes), len(values))[searcher.order]
                asked = own.filter(pc.equal(own.column(1), 1))
                for part in asked.to_batches(8192):
                    yield from answered(searcher, held, part, cell >> 20)

            schema = None
            for batch in batches:
                schema = batch.schema
                own, query = np.asarray(batch.column(0)), np.asarray(batch.column(1)) == 2
                cuts = [0, *(np.flatnonzero((np.diff(own) != 0) | (np.diff(query) != 0)) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if own[a] != cell:
                        if cell is not None and searcher is None:
                            yield from built(schema)
                        cell, searcher = int(own[a]), None
                    if not query[a]:
                        waiting.append(batch.slice(a, b - a))
                        continue
                    if searcher is None:
                        yield from built(schema)
                    yield from answered(searcher, held, batch.slice(a, b - a), cell >> 20)
            if cell is not None and searcher is None:
                yield from built(schema)

        kind = [StructField("pid", LongType()), *(StructField(c, DoubleType()) for c in axes), *(StructField(f.name, f.dataType) for f in carry), StructField("found", IntegerType()), *self.kind]
        dealt = rows.repartition(self.parts, "cell").sortWithinPartitions("cell", "kind")
        out = save(dealt.mapInArrow(search, StructType([*kind, StructField("bound", DoubleType())])), "answers")
        if len(self.tree.leaves) == 1:
            return out.drop("bound")
        open_ = out.where("bound is not null")
        if open_.isEmpty():
            return out.drop("bound")
        late = save(self._onward(open_.groupBy("pid", *axes).agg(F.max("bound").alias("bound"))), "late")
        rest = open_.select("pid", *axes, *carry.names).join(late, ["pid", *axes], "left").withColumn("found", F.coalesce("found", F.lit(0)))
        return out.where("bound is null").drop("bound").unionByName(rest)

    def _onward(self, asked: DataFrame) -> DataFrame:
        """pid, axes, found, and the fold's columns of queries (pid, axes, bound) by all cells that their balls meet."""
        axes, values, k = self.axes, self.values, self.k
        sent = self.spark.sparkContext.broadcast(self.tree)
        place = f"id long, {', '.join(f'{c} double' for c in axes)}"

        def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, ids, bound = _matrix(batch, 1, len(axes)), np.asarray(batch.column(0)), np.asarray(batch.column(1 + len(axes)), dtype=float)
                for i in range(0, len(x), 4096):
                    at, leaf = sent.value.reach(x[i : i + 4096], bound[i : i + 4096] * (1 + 1e-9) + 1e-12)
                    at = at + i
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(ids[at]), *(pa.array(x[at, a]) for a in range(len(axes))), pa.array(bound[at])], names=["leaf", "id", *axes, "bound"])

        def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = _real(batch, len(axes))
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.locate(_matrix(batch, 1, len(axes)))), *batch.columns], names=["leaf", "id", *axes, *values])

        further = save(asked.select("pid", *axes, "bound").mapInArrow(onward, f"leaf long, {place}, bound double"), "further")
        met = F.broadcast(save(further.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).alias("shares")), "met"))  # a row a cell
        number = F.col("leaf") * (1 << 20)
        points = self.points.select("pid", *axes, *values).mapInArrow(home, ", ".join([f"leaf long, {place}", *(f"{c} double" for c in values)])).join(met, "leaf")
        points = points.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
        points = points.select((number + F.col("share")).alias("cell"), F.lit(0).alias("kind"), "id", *axes, F.lit(None).cast("double").alias("bound"), *values)
        queries = further.join(met, "leaf").select((number + F.pmod(F.xxhash64("id"), F.col("shares"))).alias("cell"), F.lit(1).alias("kind"), "id", *axes, "bound", *(F.lit(None).cast("double").alias(c) for c in values))
        lists = nearest_in_groups(points.unionByName(queries), axes, k, values)
        columns, names, sides = _folded(self.fold, self.kind), ["pid", *axes, "found", *self.kind.names], len(axes)

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest = None

            def folded(rows: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
                ids, dist, at, held = np.asarray(rows.column(1 + sides)), np.asarray(rows.column(2 + sides)), _matrix(rows, 3 + sides, sides), _matrix(rows, 3 + 2 * sides, len(values))
                first, count = cuts[:-1], np.minimum(np.diff(cuts), k)
                for c in np.unique(count).tolist():
                    own = first[count == c]
                    near = own[:, None] + np.arange(c)
                    part = rows.select(range(1 + sides)).take(pa.array(own)).combine_chunks()
                    yield pa.RecordBatch.from_arrays([*(x.chunk(0) for x in part.columns), pa.array(np.full(len(own), c, np.int32)), *columns(Found(ids[near], dist[near], at[near], held[near]))], names=names)

            for batch in batches:
                rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
                key = [np.asarray(rows.column(i)) for i in range(1 + sides)]
                cuts = np.append(0, np.flatnonzero(reduce(lambda a, b: a | b, (x[1:] != x[:-1] for x in key))) + 1)
                rest = rows.slice(int(cuts[-1]))
                if len(cuts) > 1:
                    yield from folded(rows.slice(0, int(cuts[-1])), cuts)
            if rest is not None and rest.num_rows:
                yield from folded(rest, np.array([0, rest.num_rows]))

        order = ["pid", *axes]
        dealt = lists.select(*order, "nid", "dist", *(f"n{c}" for c in axes), *values).repartition(self.parts, *order).sortWithinPartitions(*order, "dist", "nid")
        return dealt.mapInArrow(merged, StructType([StructField("pid", LongType()), *(StructField(c, DoubleType()) for c in axes), StructField("found", IntegerType()), *self.kind]))


def answers(queries: DataFrame | None, points: DataFrame, k: int, fold: Fold, kind: str, axes: str = "xyz", values: tuple[str, ...] = (), carry: tuple[str, ...] = (), within: float = np.inf, cell: int = CELL) -> DataFrame:
    """pid, axes, ``carry``, found, and what ``fold`` makes of each query's k nearest points (ties to the smaller id): one row a query, columns by ``kind``.

    ``queries`` None: every point is one; a query that is in ``points`` may be its own neighbour. ``values`` are numbers of the points that the fold gets with them,
    ``carry`` columns of the queries. ``within`` bounds the distance. found is the number of neighbours, at most k; where it is 0 the fold's columns are null.
    Repeated places: see the module. Rows whose axes are null or not a number are no places and have no row."""
    spark = points.sparkSession
    ship(spark)
    cast = lambda df, numbers, others: df.select(F.col("pid").cast("long").alias("pid"), *(F.col(c).cast("double").alias(c) for c in (*axes, *numbers)), *(F.col(c).alias(f"__{c}") for c in others))
    named = lambda df: df.select("pid", *axes, *(F.col(f"__{c}").alias(c) for c in carry), "found", *schema.names)
    schema, values = StructType.fromDDL(kind), tuple(values)
    points = cast(points, values, carry if queries is None else ())
    queries = None if queries is None else cast(queries, (), carry)
    kept = StructType([f for f in (points if queries is None else queries).schema if f.name.startswith("__")])
    sample, n = _sampled(points, axes)
    size = min(max(cell, n // 1024), WIDER * cell)
    cells = int(min(max(-(-n // size), 1), MOST_CELLS, max(len(sample) // 16, 1)))
    hot = _hot(sample, cells, n)
    tree = Tree(np.unique(sample, axis=0) if len(hot) else sample, max(-(-len(sample) // cells), 1))
    leaves = len(tree.leaves)
    margins = _margins(tree, sample, n, k, within)
    shares = np.ones(leaves, np.int64)
    some, many = (sample, n) if queries is None else _sampled(queries, axes) if leaves > 1 else (sample, 0)
    if len(some) and many:
        shares = np.clip(np.ceil(np.bincount(tree.locate(some), minlength=leaves) * (many / len(some) / QUERIES)), 1, 1 << 19).astype(np.int64)
    search = lambda points: _Search(points, tree, margins, k, fold, schema, axes, values, within)
    if not len(hot):
        return named(search(points).run(queries, kept, shares))
    places = F.broadcast(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(hot)], f"place long, {', '.join(f'{c} double' for c in axes)}"))  # bounded by the sample
    queries = points.drop(*values) if queries is None else queries
    salted = points.join(places, list(axes)).withColumn("salt", F.pmod(F.xxhash64("pid"), F.lit(256)))
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy("place", "salt").orderBy("pid"))).where(F.col("r") <= k)
    least = few.withColumn("r", F.row_number().over(Window.partitionBy("place").orderBy("pid"))).where(F.col("r") <= k).select("pid", *axes, *values)
    own = search(save(points.join(places, list(axes), "left_anti").select("pid", *axes, *values).unionByName(least), "points"))
    plain = own.run(queries.join(places, list(axes), "left_anti").select(queries.columns), kept, shares)
    of_places = save(own.run(places.select(F.col("place").alias("pid"), *axes), StructType([]), np.ones(leaves, np.int64)), "places").drop(*axes)
    there = queries.join(places, list(axes)).join(F.broadcast(of_places.withColumnRenamed("pid", "place")), "place")
    return named(plain.unionByName(there.select(plain.columns)))


def _lists(found: Found) -> list:
    n, c = found.ids.shape
    cuts = pa.array(np.arange(n + 1, dtype=np.int32) * c)
    return [pa.ListArray.from_arrays(cuts, pa.array(found.ids.reshape(-1))), pa.ListArray.from_arrays(cuts, pa.array(found.dist.reshape(-1)))]


def knn(queries: DataFrame, points: DataFrame, k: int, axes: str = "xyz", cell: int = CELL) -> DataFrame:
    """pid, nid, dist, rank (1..k): exact nearest points, ties to the smaller id; see ``answers``. With fewer than k points all are returned; without points the result is empty."""
    near = answers(None if queries is points else queries, points, k, _lists, "nid array<long>, dist array<double>", axes, cell=cell)
    pairs = near.select("pid", F.posexplode(F.arrays_zip("nid", "dist")).alias("rank", "n"))
    return pairs.select("pid", "n.nid", "n.dist", (F.col("rank") + 1).alias("rank"))
