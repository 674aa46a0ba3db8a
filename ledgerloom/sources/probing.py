"""A vector index in Python workers: cells of vectors, and the nearest rows of probed cells.

Rows stream past a block of queries. A tile of queries and rows is one matrix product in 4-byte numbers, which says what may still be
among the nearest, rounding allowed for; of that alone cells are looked up, and distances computed in doubles in the order of
`functions.vector`, so they are the same to the last bit. Where cells are so small that few pairs meet, these are listed instead.
Vectors are lists of any length; `holes` are vectors with a null in them, whose distance to those of their length is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries sent out at once; each such block takes one pass over the rows.
BLOCK = 1 << 16
#: The most of a tile, and rows of the first one, which gives the bounds for those after it.
_QUERIES, _ROWS, _FIRST = 1024, 8192, 1024
#: Pairs whose distance is computed at once.
_PAIRS = 1 << 16
#: A share of pairs under which they are listed.
_FEW = 1 / 64


def _along(length: int, a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of products of a from each x on and b from each y on, added from the left."""
    total = np.zeros(len(x))
    for j in range(length):
        total += a[x + j] * b[y + j]
    return total


@dataclass
class Vectors:
    ids: np.ndarray
    cells: np.ndarray
    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    holes: np.ndarray
    norms: np.ndarray
    made: dict = field(default_factory=dict)

    @staticmethod
    def read(ids: pa.Array, embedding: pa.Array, cells: np.ndarray | None = None) -> Vectors:
        """Of arrays without nulls; `cells` is none where they are still to be found."""
        sizes = pc.list_value_length(embedding).to_numpy(zero_copy_only=False).astype(np.int64)
        values = embedding.flatten()
        flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(sizes) - sizes
        holes = np.zeros(len(sizes), bool)
        if values.null_count:
            empty = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
            holes = empty[starts + sizes] > empty[starts]
        squares = np.zeros(len(sizes))
        with np.errstate(all="ignore"):
            for length in np.unique(sizes):
                at = np.flatnonzero(sizes == length)
                squares[at] = _along(length, flat, starts[at], flat, starts[at])
            return Vectors(ids.to_numpy(zero_copy_only=False), np.zeros((len(sizes), 0), np.int64) if cells is None else cells, flat, starts, sizes, holes, np.sqrt(squares))

    @staticmethod
    def of(table: pa.Table | pa.RecordBatch) -> Vectors:
        """Of columns id, embedding and cells."""
        ids, embedding, cells = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table["id"], table["embedding"], table["cells"]))
        return Vectors.read(ids, embedding, cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(cells), -1 if len(cells) else 0))

    def take(self, at: np.ndarray) -> Vectors:
        return Vectors(self.ids[at], self.cells[at], self.flat, self.starts[at], self.sizes[at], self.holes[at], self.norms[at])

    def matrix(self, at: np.ndarray, length: int) -> np.ndarray:
        return self.flat[self.starts[at][:, None] + np.arange(length)]

    @property
    def doubtful(self) -> np.ndarray:
        """Too large or small for 4-byte numbers, or not finite."""
        return ~self.holes & (self.norms != 0) & ~((self.norms > 1e-50) & (self.norms < 1e50))

    def units(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where vectors have this length, and these of norm 1 in 4-byte numbers; 0 for zeros, holes and what is doubtful."""
        if length not in self.made:
            at = np.flatnonzero(self.sizes == length)
            plain = ((self.norms > 1e-50) & (self.norms < 1e50) & ~self.holes)[at]
            by = np.where(plain, self.norms[at], 1.0)
            self.made[length] = at, np.where(plain[:, None], self.matrix(at, length) / by[:, None], 0).astype(np.float32)
        return self.made[length]

    def without_copies(self, keep: int) -> Vectors:
        """Of equal vectors in equal cells only the `keep` of the smallest ids, as no others can be among the nearest."""
        kept = np.ones(len(self.ids), bool)
        for length in np.unique(self.sizes):
            at = np.flatnonzero(self.sizes == length)
            same = np.concatenate([self.matrix(at, length).view(np.uint64).reshape(len(at), length), self.cells[at].astype(np.uint64), self.holes[at][:, None].astype(np.uint64)], axis=1)
            factors = np.random.default_rng(1).integers(1, 1 << 63, same.shape[1], dtype=np.uint64) | np.uint64(1)
            hashes = (same * factors).sum(axis=1, dtype=np.uint64)
            order = np.lexsort((self.ids[at], hashes))
            fresh = np.ones(len(at), bool)
            alike = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
            fresh[alike + 1] = (same[order[alike + 1]] != same[order[alike]]).any(axis=1)
            place = np.arange(len(at))
            kept[at[order]] = place - np.maximum.accumulate(np.where(fresh, place, 0)) < keep
        return self if kept.all() else self.take(np.flatnonzero(kept))


def distances(queries: Vectors, q: np.ndarray, rows: Vectors, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine distances of pairs as `functions.vector.cosine_distance` gives them, and which of them aren't null."""
    out, known = np.ones(len(q)), np.ones(len(q), bool)
    sizes = np.where(queries.sizes[q] == rows.sizes[r], rows.sizes[r], -1)
    with np.errstate(all="ignore"):
        for length in np.unique(sizes[sizes >= 0]):
            at = np.flatnonzero(sizes == length)
            a, b = q[at], r[at]
            lengths = queries.norms[a] * rows.norms[b]
            dots = _along(length, queries.flat, queries.starts[a], rows.flat, rows.starts[b])
            out[at] = 1 - np.where(lengths == 0, 0.0, dots / lengths)
            known[at] = ~(queries.holes[a] | rows.holes[b])
    return out, known


class Tile:
    """Queries of one length and the nearest rows that they have met."""

    def __init__(self, queries: Vectors, planes: int, flips: int, limit: int):
        self.queries, self.flips, self.limit = queries, flips, limit
        self.n, self.length = len(queries.ids), int(queries.sizes[0])
        self.units = queries.units(self.length)[1]
        # twice what rounding can make of a product of units, and more
        self.slack = np.float32((self.length + 8) * 1.2e-7)
        few = queries.cells.shape[1] * sum(comb(planes, k) for k in range(flips + 1)) < _FEW * 2.0**planes
        self.masks = np.array([sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(range(planes), k)]) if few else None
        self.q, self.d, self.ids = np.zeros(0, np.int64), np.zeros(0), None
        self.last = np.full(self.n, np.inf)

    def meet(self, rows: Vectors) -> None:
        listed = None if self.masks is None else self._listed(rows)
        for q, r in self._near(rows) if listed is None else [listed]:
            for i in range(0, len(q), _PAIRS):
                self._compare(rows, q[i : i + _PAIRS], r[i : i + _PAIRS], listed is None)

    def _listed(self, rows: Vectors) -> tuple[np.ndarray, np.ndarray] | None:
        """The pairs that meet in a cell; none where they are many."""
        n, left, found = len(rows.ids), int(self.n * len(rows.ids) * 4 * _FEW), []
        for own, cells in zip(self.queries.cells.T, rows.cells.T, strict=True):
            order = np.argsort(cells)
            want = (own[:, None] ^ self.masks).ravel()
            low = np.searchsorted(cells[order], want)
            counts = np.searchsorted(cells[order], want, "right") - low
            left -= counts.sum()
            if left < 0:
                return None
            at = np.arange(counts.sum()) + np.repeat(low - np.cumsum(counts) + counts, counts)
            found.append(np.repeat(np.arange(self.n).repeat(len(self.masks)), counts) * n + order[at])
        return np.divmod(np.unique(np.concatenate(found)), n)

    def _meeting(self, rows: Vectors, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.zeros(np.broadcast_shapes(q.shape, r.shape), bool)
        for own, cells in zip(self.queries.cells.T, rows.cells.T, strict=True):
            out |= np.bitwise_count(own[q] ^ cells[r]) <= self.flips
        return out

    def _near(self, rows: Vectors) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that may be among the nearest; some don't meet in a cell."""
        n, alike = len(rows.ids), rows.sizes == self.length
        at, units = rows.units(self.length)
        near = self.units @ units.T
        if len(at) < n:
            near, some = np.zeros((self.n, n), np.float32), near
            near[:, at] = some
        if rows.holes.any() or self.queries.holes.any():
            near[alike & (rows.holes | self.queries.holes[:, None])] = -np.inf
        if rows.doubtful.any() or self.queries.doubtful.any():
            odd = alike & (rows.doubtful | self.queries.doubtful[:, None])
            near[odd] = -np.inf
            yield np.nonzero(odd)
        least = np.full(self.n, np.finfo(np.float32).min)
        full = np.isfinite(self.last)
        least[full] = (1 - self.last[full]).astype(np.float32) - self.slack
        if len(open_ := np.flatnonzero(~full)):
            own = np.where(self._meeting(rows, open_[:, None], np.arange(n)[None]), near[open_], np.float32(-np.inf))
            near[open_] = own
            if n > self.limit:
                bounds = np.partition(own, n - self.limit, axis=1)[:, n - self.limit] - 2 * self.slack
                least[open_] = np.maximum(least[open_], bounds)
        some = np.flatnonzero(near.max(axis=1) >= least)
        q, r = np.nonzero(near[some] >= least[some][:, None])
        yield some[q], r

    def _compare(self, rows: Vectors, q: np.ndarray, r: np.ndarray, check: bool) -> None:
        if check:
            meet = self._meeting(rows, q, r)
            q, r = q[meet], r[meet]
        d, known = distances(self.queries, q, rows, r)
        q, d, ids = (np.concatenate(x) for x in ((self.q, q[known]), (self.d, d[known]), (rows.ids[:0] if self.ids is None else self.ids, rows.ids[r[known]])))
        order = np.lexsort((ids, d, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order, q = order[place < self.limit], q[place < self.limit]
        self.q, self.d, self.ids = q, d[order], ids[order]
        last = place[place < self.limit] == self.limit - 1
        self.last[q[last]] = self.d[last]


def nearest(queries, planes: int, flips: int, limit: int, names: pa.DataType, ids: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows: each query's nearest of the rows of a task. `queries` is a broadcast of Vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: Vectors = queries.value
        tiles = []
        for length in np.unique(wanted.sizes):
            at = np.flatnonzero(wanted.sizes == length)
            tiles += [Tile(wanted.take(at[i : i + _QUERIES]), planes, flips, limit) for i in range(0, len(at), _QUERIES)]
        step = _FIRST
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                rows = Vectors.of(batch.slice(start, step)).without_copies(limit)
                start, step = start + step, _ROWS
                for tile in tiles:
                    tile.meet(rows)
        for tile in tiles:
            if len(tile.q):
                yield pa.RecordBatch.from_arrays([pa.array(tile.queries.ids[tile.q], names), pa.array(tile.ids, ids), pa.array(tile.d)], ["query", "id", "distance"])

    return run


def cell_numbers(normals: np.ndarray) -> Callable[[pa.Array], pa.Array]:
    """For arrow_udf over vectors of doubles: the number of the cell in each table, bit i set where the product with plane i is over 0.

    0 for nulls, vectors with nulls and those of other lengths; a product that isn't a number counts as over 0, as in Spark.
    """
    tables, planes, dim = normals.shape
    flat = normals.reshape(-1, dim)

    def run(embedding: pa.Array) -> pa.Array:
        whole = np.flatnonzero(embedding.is_valid().to_numpy(zero_copy_only=False))
        v = Vectors.read(pa.array(whole), embedding.drop_null())
        at = np.flatnonzero((v.sizes == dim) & ~v.holes)
        with np.errstate(all="ignore"):
            x = v.matrix(at, dim) @ flat.T
            # signs that rounding could turn are found as Spark adds
            a, p = np.nonzero(~(np.abs(x) > 1e-9 * v.norms[at][:, None] * np.linalg.norm(flat, axis=1)) | ~np.isfinite(x))
            x[a, p] = _along(dim, v.flat, v.starts[at][a], flat.ravel(), p * dim)
            numbers = (~(x <= 0)).reshape(len(at), tables, planes) @ (1 << np.arange(planes, dtype=np.int64))
        out = np.zeros((len(embedding), tables), np.int64)
        out[whole[at]] = numbers
        offsets = pa.array(np.arange(len(embedding) + 1, dtype=np.int32) * tables, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), pa.int32() if planes < 32 else pa.int64()))

    return run
