"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become terms (runs of letters and digits, in lower case). Runs of `min_match` terms that a
document and an item share are the seeds. Where the seeds of an item could cover `min_coverage` of it, running
Karp-Rabin marks the longest matches that overlap no earlier tile, again and again, down to `min_match`; a document is
contaminated if the tiles cover `min_coverage` of the item's terms. Tiles may lie in any order, so reordered passages
count. An item of fewer terms than `min_match` is one seed itself: it is found where a document holds it whole.

The benchmark is a stated query set: it is split by a hash of item_id into blocks of about `block_bytes`. One block at a
time reaches the driver, goes to the tasks and is held against all documents, so the benchmark's size sets the number of
passes and not the memory of one. Documents are never shuffled. A run of terms that many items share costs a document one
pair an item, however often the document holds it.

Defined results: null and empty texts match nothing, items without terms neither; equal items are reported each, and so
are rows of one item_id; repeated rows each get their rows; null ids are kept as such and ids may be of any type; an empty
table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.llm._shared import cut
from ledgerloom.llm._text import NO_TERM, U, blocks, join_hashes, lowered, raw, rows_of, run_hashes, spans


@dataclass(frozen=True)
class Tiling:
    min_match: int = 5
    min_coverage: float = 0.5
    block_bytes: int = 8 << 20


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each term and each row's first term (one more than rows)."""
    data, offsets = raw(lowered(column))
    starts, ends, first = spans(data, offsets, NO_TERM)
    return run_hashes(data, starts, ends), first


def _matches(text: list, text_free: list, item: list, item_free: list, length: int) -> list[tuple[int, int, int]]:
    """Running Karp-Rabin: maximal unmarked matches of at least `length` as (length, text start, item start)."""
    base, modulus = 1_000_003, (1 << 61) - 1
    top = pow(base, length - 1, modulus)

    def rolled(terms: list, free: list) -> Iterator[tuple[int, int]]:
        """(hash, start) of each unmarked run of `length`, rolled along."""
        h = run = 0
        for i, x in enumerate(terms):
            if not free[i]:
                h = run = 0
                continue
            if run == length:
                h = (h - terms[i - length] * top) % modulus
                run -= 1
            h = (h * base + x) % modulus
            run += 1
            if run == length:
                yield h, i - length + 1

    at = defaultdict(list)
    for h, j in rolled(item, item_free):
        at[h].append(j)
    out = []
    for h, i in rolled(text, text_free):
        for j in at.get(h, ()):
            if i and j and text_free[i - 1] and item_free[j - 1] and text[i - 1] == item[j - 1]:
                continue  # part of a match that began before
            k = 0
            while i + k < len(text) and j + k < len(item) and text_free[i + k] and item_free[j + k] and text[i + k] == item[j + k]:
                k += 1
            if k >= length:
                out.append((k, i, j))
    return out


def tiles(text: list[int], item: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, text start, item start) of each tile, the longest first."""
    text_free, item_free, out = [True] * len(text), [True] * len(item), []
    length = max(min_match, len(item))
    while length >= min_match:
        found = _matches(text, text_free, item, item_free, length)
        longest = max((k for k, _, _ in found), default=0)
        for k, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if k < longest:
                break
            if all(text_free[i : i + k]) and all(item_free[j : j + k]):
                text_free[i : i + k] = item_free[j : j + k] = [False] * k
                out.append((k, i, j))
        if not found:
            length = min_match if length == min_match + 1 else max(min_match, length // 2) if length > min_match else 0
        # after marking, the same length is tried again: shorter matches of this search may have lost terms to a tile
    return out


class Seeds:
    """The seeds of `length` terms of a block of items, for lookup by hash."""

    BITS = 1 << 20

    def __init__(self, hashes: np.ndarray, first: np.ndarray, own: np.ndarray, length: int):
        """hashes, first: terms of the items; own: which items have seeds of this length."""
        self.length = length
        row, h = rows_of(first), join_hashes(hashes, length)
        start = np.flatnonzero((row[: len(h)] == row[length - 1 :]) & own[row[: len(h)]]) if len(h) else np.zeros(0, np.int64)
        self.runs, run = np.unique(h[start], return_inverse=True)
        order = np.lexsort((start, row[start], run))
        self.place, self.item = start[order], row[start][order]
        self.begin = np.append(0, np.cumsum(np.bincount(run, minlength=len(self.runs))))
        self.maybe = np.zeros(self.BITS, bool)
        self.maybe[self._slot(self.runs)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h & U(self.BITS - 1)).astype(np.int64)

    def hits(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, index of the run) of the runs that lie in one row."""
        at = np.flatnonzero(self.maybe[self._slot(h)])
        at = at[row[at] == row[at + self.length - 1]]
        run = np.minimum(np.searchsorted(self.runs, h[at]), len(self.runs) - 1)
        same = self.runs[run] == h[at]
        return at[same], run[same]

    def pairs(self, row: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, terms that the seeds of both cover in the item) of all rows and items that share a seed."""
        once = np.unique(row * len(self.runs) + run)
        row, run = once // len(self.runs), once % len(self.runs)
        n = self.begin[run + 1] - self.begin[run]
        at = np.arange(int(n.sum())) + np.repeat(self.begin[run] - (np.cumsum(n) - n), n)
        row, item, place = np.repeat(row, n), self.item[at], self.place[at]
        order = np.lexsort((place, item, row))
        row, item, place = row[order], item[order], place[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        gain = np.full(len(row), self.length)
        gain[:-1] = np.where(new[1:], self.length, np.minimum(self.length, place[1:] - place[:-1]))
        first = np.flatnonzero(new)
        return row[first], item[first], np.add.reduceat(gain, first) if len(first) else gain


class Items:
    """A block of items with their seeds."""

    def __init__(self, items: list[tuple], tiling: Tiling):
        self.tiling, self.ids = tiling, [i for i, _ in items]
        self.terms, self.first = terms(pa.array([t for _, t in items], pa.string()))
        self.count = np.diff(self.first)
        length = np.minimum(self.count, tiling.min_match)
        self.seeds = [Seeds(self.terms, self.first, length == n, n) for n in np.unique(length).tolist() if n]

    def compare(self, column: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, coverage, tiles, longest tile) of each row and item that reach the threshold."""
        own_terms, first = terms(column)
        row = rows_of(first)
        for seeds in self.seeds:
            n, h = seeds.length, join_hashes(own_terms, seeds.length)
            if not len(h):
                continue
            at, run = seeds.hits(h, row)
            rows, items, covered = seeds.pairs(row[at], run)
            # every tile is made of seeds; a short item is found whole
            least = np.where(self.count[items] < self.tiling.min_match, 1.0, self.tiling.min_coverage)
            likely = np.flatnonzero(covered >= least * self.count[items])
            for r, item, share in zip(rows[likely].tolist(), items[likely].tolist(), least[likely].tolist(), strict=True):
                low, high = np.searchsorted(row[at], [r, r + 1])
                base, size = int(self.first[item]), int(self.count[item])
                item_terms = self.terms[base : base + size]
                # the text's terms that the item's seeds cover, with a break (-1) between runs of them
                text: list[int] = []
                upto = -1
                for s in at[low:high][np.isin(h[at[low:high]], join_hashes(item_terms, n))].tolist():
                    if s > upto and text:
                        text.append(-1)
                    text += own_terms[max(s, upto) : s + n].tolist()
                    upto = s + n
                found = tiles(text, item_terms.tolist(), n)
                coverage = sum(k for k, _, _ in found) / size
                if coverage >= share:
                    yield r, item, coverage, len(found), found[0][0]


def find_contamination(documents: DataFrame, benchmark: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest_tile of each document and item that reach the threshold."""
    bytes_all = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-bytes_all // tiling.block_bytes) or 1
    out = T.StructType([documents.schema["doc_id"], benchmark.schema["item_id"], T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.LongType()), T.StructField("longest_tile", T.LongType())])
    id_type = to_arrow_type(benchmark.schema["item_id"].dataType)

    def against(block: int) -> DataFrame:
        rows = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).select("item_id", "text").collect()  # about block_bytes
        shared = documents.sparkSession.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in rows], tiling))
        del rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                for block in blocks(batch):
                    if found := list(held.compare(block.column("text"))):
                        ids = block.column("doc_id").take(pa.array([x[0] for x in found]))
                        items = pa.array([held.ids[x[1]] for x in found], id_type)
                        yield pa.record_batch({"doc_id": ids, "item_id": items, "coverage": [x[2] for x in found], "n_tiles": [x[3] for x in found], "longest_tile": [x[4] for x in found]})

        found = documents.select("doc_id", "text").mapInArrow(run, out)
        if n_blocks > 1:  # this block's pass ends before the next block is read
            found = cut(found)
            shared.destroy()
        return found

    return reduce(DataFrame.unionByName, map(against, range(n_blocks)))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """The documents that hold no item, in their own columns; rows of one doc_id are told apart by text."""
    key = F.struct(documents["doc_id"], F.xxhash64(documents["text"]).alias("hash"))
    found = cut(find_contamination(documents.select(key.alias("doc_id"), "text"), benchmark, tiling).select(F.col("doc_id").alias("__key")).distinct())
    return documents.withColumn("__own", key).join(found, F.col("__own").eqNullSafe(F.col("__key")), "left_anti").select(*documents.columns)
