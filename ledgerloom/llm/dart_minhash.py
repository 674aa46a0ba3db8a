"""Near-duplicates by DartMinHash signatures, banded joining and exact verification.

A document is a weighted set: its shingles of five words, each with the number of times that it occurs. Each element throws
darts into the plane of weight and rank: unit cells of the plane hold a Poisson(1) number of darts, given by a hash of
element and cell, each with a hashed weight, rank and coordinate. A document keeps the darts below its elements' weights
and, at each of `size` coordinates, the one of least rank; at first it looks at ranks up to (size ln size + 2 size) / total
weight, and twice as far while a coordinate is empty. Two signatures agree at a coordinate with the probability of their
weighted Jaccard similarity, sum of least weights by sum of greatest.

1. Equal texts are one node, so copies are never compared. Bands of `rows` coordinates give buckets of nodes; signatures of
   one bucket that agree enough are likely links.
2. Components of likely links are the candidate groups, so both nodes of a likely pair are in one group. In a group whole
   texts are compared exactly, and pairs of `least` or more are links.
3. Components of links are the classes.

Steps 1 and 2 compare within buckets and groups in blocks (`_spanning`). One that fits a block is one comparison of all its
members, of which a spanning forest leaves. A larger one is dealt out in blocks: first each block is compared with the
first block and in itself; then only members outside the group's largest component so far, the rest, still have pairs
that could join two components, and each block of the rest is compared with all others. No pair whose link could matter is
left out, whatever the size. Rows between tasks are twice a group's members and, times its blocks, what its largest class
doesn't hold: a group of near copies costs in proportion, only a bucket of texts that are all alike at about 0.7 and not
at 0.8 needs its pairs of blocks.

With 25 bands of 5, a pair of similarity 0.8 meets in a bucket with probability 0.99995 and is found likely there with as
much. Links inside a class aren't counted: that takes all its pairs.

Defined results: texts of one to four words are one shingle; null texts are a class of their own, and so are empty
ones; white space that differs makes no difference to similarity, but a text without words equals only the same text;
rows are told apart by text, so rows of one doc_id with other texts are in the classes of their texts; repeated rows are
all returned, in one class; a null doc_id is the greatest, so class_id is null only where no row of the class has one;
doc_id is any integer type; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._groups import whole_groups
from ledgerloom.llm._shared import cut
from ledgerloom.llm._text import U, blocks, join_hashes, mix, raw, rows_of, run_hashes, spans
from ledgerloom.llm.components import components


@dataclass(frozen=True)
class Near:
    words: int = 5
    least: float = 0.8
    bands: int = 25
    rows: int = 5
    #: Signatures that agree less are no candidates: 0.8 less three standard deviations and more.
    likely: float = 0.66
    #: Members of a block: signatures of a bucket, texts of a group and their bytes.
    bucket_rows: int = 2048
    group_rows: int = 512
    group_bytes: int = 1 << 22

    @property
    def size(self) -> int:
        return self.bands * self.rows


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and multiplicity of each distinct shingle, by row and hash."""
    data, offsets = raw(column)
    starts, ends, first = spans(data, offsets)
    h, row = run_hashes(data, starts, ends), rows_of(first)
    full = join_hashes(h, words)
    own = row[: len(full)] == row[words - 1 :] if len(full) else np.zeros(0, bool)
    at, keys = row[: len(full)][own], full[own]
    n = np.diff(first)
    for size in range(1, words):  # texts shorter than a shingle
        short = np.flatnonzero(n == size)
        if len(short):
            at = np.concatenate([at, short])
            keys = np.concatenate([keys, join_hashes(h, size)[first[short]]])
    order = np.lexsort((keys, at))
    at, keys = at[order], keys[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (keys[1:] != keys[:-1])
    edges = np.flatnonzero(new)
    return at[edges], keys[edges], np.diff(np.append(edges, len(at)))


#: P(at most k darts in a cell), as 64-bit thresholds.
_POISSON = np.array([int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**64) for k in range(12)], U)


def _throw(row: np.ndarray, key: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, best: np.ndarray) -> None:
    """Throws the darts of ranks in [low, high) of each row and keeps the earliest in best (rows x coordinates)."""
    size = best.shape[1]
    cells_w = np.ceil(weight).astype(np.int64)
    first_r = np.floor(low[row]).astype(np.int64)
    cells_r = np.ceil(high[row]).astype(np.int64) - first_r
    n = cells_w * cells_r
    element = np.repeat(np.arange(len(row)), n)
    k = np.arange(len(element)) - np.repeat(np.cumsum(n) - n, n)
    w_cell, r_cell = k // cells_r[element], k % cells_r[element] + first_r[element]
    cell = mix(key[element] ^ mix(w_cell.astype(U) * U(0x9E3779B97F4A7C15) + r_cell.astype(U) * U(0xC2B2AE3D27D4EB4F) + U(1)))
    darts = np.searchsorted(_POISSON, cell, "right")
    which = np.repeat(np.arange(len(cell)), darts)
    j = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = mix(cell[which] + (j.astype(U) + U(1)) * U(0xD6E8FEB86659FD93))
    element = element[which]
    in_w = w_cell[which] + (dart & U(0xFFFFFF)).astype(np.float64) / float(1 << 24)
    rank = r_cell[which] + (dart >> U(24)).astype(np.float64) / float(1 << 40)
    at = row[element]
    hit = (in_w < weight[element]) & (rank < high[at]) & (rank >= low[at])
    at, dart, rank = at[hit], dart[hit], rank[hit]
    name = mix(dart ^ U(0x2545F4914F6CDD1D))
    coordinate = ((name >> U(32)) % U(size)).astype(np.int64)
    # rank above (20 bits of whole ranks, 20 of their parts), the dart's name below: the least is the earliest dart
    packed = (np.minimum(rank, (1 << 20) - 1) * (1 << 20)).astype(U) << U(24) | (name & U(0xFFFFFF))
    np.minimum.at(best.reshape(-1), at * size + coordinate, packed)


def signatures(row: np.ndarray, key: np.ndarray, weight: np.ndarray, rows: int, size: int) -> np.ndarray:
    """rows x size; all ones where a row has no element."""
    none = U(2**64 - 1)
    best = np.full((rows, size), none)
    total = np.bincount(row, weight, rows)
    reach = np.where(total > 0, (size * math.log(size) + 2 * size) / np.maximum(total, 1e-300), 0.0)
    low, high = np.zeros(rows), reach
    live = np.ones(len(row), bool)
    while live.any():
        _throw(row[live], key[live], weight[live], low, high, best)
        empty = (best == none).any(axis=1) & (total > 0)
        live = empty[row]
        low, high = high, high * 2
    return best


def _sign(near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, most=1 << 20):
                n = block.num_rows
                row, key, weight = shingles(block.column("text"), near.words)
                best = signatures(row, key, weight.astype(float), n, near.size)
                bands = np.stack([join_hashes(best[:, b * near.rows : (b + 1) * near.rows].reshape(-1), near.rows)[:: near.rows] ^ mix(np.array([b + 1], U)) for b in range(near.bands)], axis=1)
                some = np.bincount(row, minlength=n) > 0
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(some * near.bands)).astype(np.int32), pa.array(np.ascontiguousarray(bands[some]).reshape(-1).view(np.int64)))
                brief = mix(best).astype(np.uint8)
                n_bytes = pc.fill_null(pc.binary_length(block.column("text")), 0).cast(pa.int64())
                own = {k: block.column(k) for k in ("doc_id", *_TEXT)}
                yield pa.record_batch(own | {"bands": lists, "brief": pa.array([x.tobytes() for x in brief], pa.binary()), "n_bytes": n_bytes})

    return run


def _forest(n: int, like: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of n nodes; like(k, left) says which of left have an edge to k."""
    left, a, b = np.arange(n), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            k = queue.pop()
            near = like(k, left)
            found, left = left[near], left[~near]
            a.append(np.full(len(found), k)), b.append(found)
            queue.extend(found.tolist())
    return np.concatenate(a), np.concatenate(b)


def _edges(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _briefs(column: pa.ChunkedArray, size: int) -> np.ndarray:
    data, _ = raw(column)
    return data.reshape(-1, size)


def _likely(near: Near):
    """A spanning forest of the likely links among the members of each (g, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, _UNIT):
            edges, ids, many, briefs = _edges(table, _UNIT), table.column("node").to_numpy(), table.column("many").to_numpy(zero_copy_only=False), _briefs(table.column("brief"), near.size)
            sizes = np.diff(edges)
            two = edges[:-1][sizes == 2]
            two = two[(briefs[two] == briefs[two + 1]).mean(axis=1) >= near.likely]
            a, b, from_many = [ids[two]], [ids[two + 1]], [many[two]]
            for low, high in zip(edges[:-1][sizes > 2].tolist(), edges[1:][sizes > 2].tolist(), strict=True):
                own = briefs[low:high]
                x, y = _forest(len(own), lambda k, left, own=own: (own[left] == own[k]).mean(axis=1) >= near.likely)
                a.append(ids[low + x]), b.append(ids[low + y]), from_many.append(many[low + x])
            yield pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b), "many": np.concatenate(from_many)})

    return run


def _similar(row: np.ndarray, key: np.ndarray, n: int, least: float) -> np.ndarray:
    """n x n: which of n sets, given as (row, key) without repeats, are similar."""
    size = np.bincount(row, minlength=n)
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    column = np.cumsum(np.append(False, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    shared = np.bincount(column)[column] > 1 if len(key) else np.zeros(0, bool)
    row, column = row[shared], column[shared]
    column = np.cumsum(np.append(False, column[1:] != column[:-1])) if len(column) else column
    both, step = np.zeros((n, n)), max(1, (1 << 21) // n)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        at = slice(*np.searchsorted(column, [low, low + step]))
        has = np.zeros((n, min(step, int(column[-1]) + 1 - low)), np.float32)
        has[row[at], column[at] - low] = 1
        both += has @ has.T
    return both / np.maximum(1, size[:, None] + size[None, :] - both) >= least


def _verify(near: Near):
    """A spanning forest of the links among the texts of each (g, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, _UNIT):
            rows, keys, n = [], [], 0
            for batch in table.select(["text"]).to_batches():
                for block in blocks(batch):
                    row, key, weight = shingles(block.column("text"), near.words)
                    # an element of weight w is w elements of weight 1: the weighted similarity of the ones is that of the others
                    copy = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                    rows.append(np.repeat(row, weight) + n), keys.append(np.repeat(key, weight) ^ np.where(copy > 0, mix(copy.astype(U)), U(0)))
                    n += block.num_rows
            row, key = np.concatenate(rows), np.concatenate(keys)
            edges, ids, many = _edges(table, _UNIT), table.column("node").to_numpy(), table.column("many").to_numpy(zero_copy_only=False)
            bounds = np.searchsorted(row, edges)
            a, b, from_many = [], [], []
            for k, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                like = _similar(row[bounds[k] : bounds[k + 1]] - low, key[bounds[k] : bounds[k + 1]], high - low, near.least)
                x, y = _forest(high - low, lambda k, left, like=like: like[k, left])
                a.append(ids[low + x]), b.append(ids[low + y]), from_many.append(many[low + x])
            yield pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b), "many": np.concatenate(from_many)})

    return run


_UNIT = ("g", "low", "high")
#: What tells texts apart: 128 bits of hash and whether it is null; and with them the rows: doc_id, zero for null, and whether it is.
_TEXT = ("x", "y", "no_text")
_ROW = ("id", "no_id", *_TEXT)


def _key_of(row: DataFrame) -> list[Column]:
    """_ROW of each row."""
    doc_id, text = row["doc_id"], row["text"]
    return [F.coalesce(doc_id, F.lit(0)).cast("long"), doc_id.isNull(), F.xxhash64(text), F.xxhash64(F.lit(7), text, F.lit(7)), text.isNull()]


def _keyed(documents: DataFrame, prefix: str = "") -> DataFrame:
    return documents.select("*", *[c.alias(prefix + k) for k, c in zip(_ROW, _key_of(documents), strict=True)])


def _spanning(members: DataFrame, held: DataFrame, link: Callable, most: Column) -> DataFrame:
    """Links (a, b) whose components are those of all links among the members (g, node, n_bytes) of each g.

    held: what `link` needs of each node; most: blocks of a g, of its `rows` and `bytes`. Rows of one node in a g are one.
    """
    sizes = members.groupBy("g").agg(F.count("*").alias("rows"), F.sum("n_bytes").alias("bytes")).where("rows > 1").select("g", F.greatest(F.ceil(most), F.lit(1)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", "g"), F.col("blocks")).cast("int")
    dealt = cut(members.join(sizes, "g").select("g", "node", "blocks", block.alias("block")))
    own = [*_UNIT, "node", "many"]

    def linked(rows: DataFrame) -> DataFrame:
        found = rows.join(held, "node").select(*own, *[c for c in held.columns if c != "node"])
        return cut(found.repartition(*_UNIT).sortWithinPartitions(*_UNIT, "node").mapInArrow(link, "a long, b long, many boolean"))

    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # every block beside the first one, which is in the pairs of all the others
    to = F.when((F.col("block") > 0) | (F.col("blocks") == 1), F.array("block")).otherwise(F.sequence(F.lit(1), F.greatest(F.col("blocks") - 1, F.lit(1))))
    first = linked(dealt.select("g", F.lit(0).alias("low"), F.explode(to).alias("high"), "node", (F.col("blocks") > 1).alias("many")))
    if not dealt.where("blocks > 2").head(1):
        return first.select("a", "b")
    large = dealt.where("blocks > 2")  # one pair of blocks holds all pairs of two
    known = components(first.where("many")).withColumnRenamed("root", "known")
    placed = large.join(known, "node", "left").select("g", "node", "block", "blocks", F.coalesce("known", "node").alias("root"))
    counts = placed.groupBy("g", "root").count().groupBy("g").agg(F.max_by("root", F.struct("count", "root")).alias("largest"))
    placed = cut(placed.join(counts, "g").withColumn("rest", (F.col("root") != F.col("largest")) & (F.col("block") > 0)).drop("root", "largest"))
    per_block = placed.groupBy("g", "blocks").agg(F.count("*").alias("rows"), F.count_if("rest").alias("rest_rows")).where("rest_rows > 0")
    rests = per_block.select("g", F.ceil(F.col("rest_rows") * F.col("blocks") / F.col("rows")).cast("int").alias("rests"))
    # the first block has met all; every block of the rest now meets all the others, and its own members with them
    dealt = placed.where("block > 0").join(rests, "g").withColumn("part", F.pmod(F.xxhash64("g", "node"), F.col("rests")).cast("int"))
    plain = dealt.select("g", F.explode(upto(F.col("rests"))).alias("low"), F.col("block").alias("high"), "node", F.col("part").alias("of"), "rest").where("not (rest and of = low)").drop("of", "rest")
    beside = dealt.where("rest").select("g", F.col("part").alias("low"), F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("high"), "node")
    second = linked(plain.union(beside).withColumn("many", F.lit(True)))
    return first.select("a", "b").union(second.select("a", "b"))


def near_links(documents: DataFrame, near: Near = Near()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, links): doc_id and text key of each row; node, text key, the smallest doc_id (holder) of each text; verified links (a, b) of nodes that span the classes."""
    keyed = _keyed(documents.select("doc_id", "text"))
    kind = next(f.dataType.simpleString() for f in documents.schema if f.name == "doc_id")
    signed = cut(keyed.select("doc_id", "text", *_TEXT).mapInArrow(_sign(near), f"doc_id {kind}, x long, y long, no_text boolean, bands array<long>, brief binary, n_bytes long"))
    one = F.any_value(F.struct("bands", "brief", "n_bytes")).alias("one")
    nodes = signed.groupBy(*_TEXT).agg(F.min("doc_id").alias("holder"), one)
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), *_TEXT, "holder", "one.*"))
    buckets = nodes.select("node", F.explode("bands").alias("g"), F.lit(0).alias("n_bytes"))
    likely = _spanning(buckets, nodes.select("node", "brief"), _likely(near), F.col("rows") / near.bucket_rows)
    groups = components(likely).withColumnRenamed("root", "g")
    members = groups.join(nodes.select("node", "n_bytes"), "node")
    # the text of each grouped node, read from the row of its holder; repeated rows of one key hold one text
    at = groups.join(nodes, "node").select("node", F.coalesce("holder", F.lit(0)).cast("long").alias("id"), F.col("holder").isNull().alias("no_id"), *_TEXT)
    texts = keyed.groupBy(*_ROW).agg(F.any_value("text").alias("text")).join(at, list(_ROW)).select("node", "text")
    size = F.greatest(F.col("rows") / near.group_rows, F.col("bytes") / near.group_bytes)
    return signed.select("doc_id", *_TEXT), nodes.select("node", *_TEXT, "holder"), _spanning(members, texts, _verify(near), size)


def classes(documents: DataFrame, near: Near = Near()) -> tuple[DataFrame, DataFrame]:
    """(rows as in near_links; node, text key, holder, class_id and whether the node stands for its class)."""
    rows, nodes, links = near_links(documents, near)
    roots = components(links).withColumnRenamed("root", "known")
    placed = cut(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("known", "node")).drop("known"))
    heads = placed.groupBy("root").agg(F.min("holder").alias("class_id"), F.min_by("node", F.struct(F.col("holder").isNull(), "holder", "node")).alias("head"))
    return rows, placed.join(heads, "root").select("node", *_TEXT, "holder", "class_id", (F.col("node") == F.col("head")).alias("stands"))


def near_duplicates(documents: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class) and holder (smallest of its equal texts) of each row."""
    rows, nodes = classes(documents, near)
    return rows.join(nodes, list(_TEXT)).select("doc_id", "class_id", "holder")


def keep_one(documents: DataFrame, near: Near = Near()) -> DataFrame:
    """One row of each class, in its own columns: that of the smallest doc_id; of rows with one doc_id and text, any."""
    _, nodes = classes(documents, near)
    key = [f"__{k}" for k in _ROW]
    one = nodes.where("stands").select(F.coalesce("holder", F.lit(0)).cast("long").alias("__id"), F.col("holder").isNull().alias("__no_id"), *[F.col(k).alias(f"__{k}") for k in _TEXT])
    return _keyed(documents, "__").join(one, key, "left_semi").dropDuplicates(key).select(*documents.columns)
