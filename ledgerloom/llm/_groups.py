"""Rows of packed arrays, whole groups of sorted Arrow rows, and spans that find their documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._shared import cut
from ledgerloom.llm._text import pack, part_of, unpack

#: doc_id, number of the text where a doc_id has several, first byte or word, and how many.
SPAN = (("doc", np.int64), ("text", np.int64), ("low", np.int32), ("size", np.int32))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that follow one another with equal keys, one or more groups in each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows - 1, bool)
        for k in keys:
            x = np.asarray(batch.column(k))
            same &= x[1:] == x[:-1]
        edges = np.flatnonzero(~same) + 1
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if len(edges):
            cut_at = int(edges[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut_at)])
            held = [batch.slice(cut_at)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def by_key(table: pa.Table) -> Iterator[pa.Table]:
    key = table.column("key").to_numpy()
    edges = np.append(np.flatnonzero(np.diff(key, prepend=key[:1] - 1)), len(key))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield table.slice(a, b - a)


def packed_rows(key: np.ndarray, arrays: list[np.ndarray], kinds: tuple, **same) -> Iterator[pa.RecordBatch]:
    """A row for each key with its elements packed."""
    order = np.argsort(key, kind="stable")
    key, arrays = key[order], [x[order].astype(kind) for x, (_, kind) in zip(arrays, kinds, strict=True)]
    edges = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
    if len(edges):
        pieces = [[pack(p) for p in np.split(x, edges[1:])] for x in arrays]
        yield pa.record_batch({"key": pa.array(key[edges], pa.int32())} | {k: pa.array([v] * len(edges)) for k, v in same.items()} | {name: pa.array(p, pa.binary()) for p, (name, _) in zip(pieces, kinds, strict=True)})


def unpacked(table: pa.Table, kinds: tuple) -> list[np.ndarray]:
    return [np.concatenate([unpack(x, kind) for x in table.column(name).to_pylist() if x] or [np.zeros(0, kind)]) for name, kind in kinds]


def covered(n: int, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in a span."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.minimum(low, n), 1)
    np.add.at(change, np.minimum(low + size, n), -1)
    return np.cumsum(change[:n]) > 0


def pieces(total: int, each: int) -> int:
    """How many buckets or parts `total` bytes make: of `each` at most, and of less where that would keep few tasks busy."""
    return max(1, -(-total // each), min(64, total >> 20))


def packed_types(kinds: tuple) -> dict[str, pa.DataType]:
    return {name: pa.binary() for name, _ in kinds}


def packed_sql(kinds: tuple) -> str:
    return ", ".join(f"{name} binary" for name, _ in kinds)


def filled(batch: pa.RecordBatch, schema: dict[str, pa.DataType], **same) -> pa.RecordBatch:
    """The batch with all columns of the schema: its own, those in `same`, or null."""
    n = batch.num_rows
    return pa.record_batch([batch.column(k) if k in batch.schema.names else pa.array([same.get(k)] * n, t) for k, t in schema.items()], names=list(schema))


def deal(spans: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of spans by the part of their document."""
    yield from packed_rows(part_of(spans[0].astype(np.int64) ^ spans[1].astype(np.int64), parts), spans, SPAN)


def by_document(more: tuple[str, ...] = ()):
    """Of whole parts: a row for each document, its spans packed; merged, unless rows have more columns, numbers that hold for all their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("key",)):
            for table in by_key(table):
                doc, text, low, size = unpacked(table, SPAN)
                counts = [len(x) // 8 for x in table.column("doc").to_pylist()]
                others = [np.repeat(np.array(table.column(k).to_pylist(), np.int64), counts) for k in more]
                order = np.lexsort((low, text, doc))
                doc, text, low, size, *others = (x[order] for x in (doc, text, low, size, *others))
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
                if not more and len(doc):
                    # spans that touch or overlap are one
                    number = np.cumsum(new)
                    reach = np.maximum.accumulate((low + size).astype(np.int64) + number * (1 << 32)) - number * (1 << 32)
                    apart = new.copy()
                    apart[1:] |= low[1:] > reach[:-1]
                    first = np.flatnonzero(apart)
                    size = (reach[np.append(first[1:], len(doc)) - 1] - low[first]).astype(np.int32)
                    doc, text, low, new = doc[first], text[first], low[first], new[first]
                edges = np.append(np.flatnonzero(new), len(doc)).tolist()
                packed = [[x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] for x in (low, size, *others)]
                yield pa.record_batch({"doc": doc[edges[:-1]], "hash": text[edges[:-1]]} | {k: pa.array(v, pa.binary()) for k, v in zip(("low", "size", *more), packed, strict=True)})

    return run


def grouped(rows: DataFrame, pieces: int, most_tasks: int) -> DataFrame:
    """Rows of each key together, one key after the other; tasks sort them on disk, so their number needn't be that of the keys."""
    return rows.repartition(min(pieces, most_tasks), "key").sortWithinPartitions("key")


def spans_of(rows: DataFrame, pieces: int, most_tasks: int, more: tuple[str, ...] = ()) -> DataFrame:
    """doc, hash, low, size (and more), packed, of each document that rows of spans name."""
    return grouped(rows, pieces, most_tasks).mapInArrow(by_document(more), "doc long, hash long, " + packed_sql((("low", 0), ("size", 0), *((k, 0) for k in more))))


def identified(documents: DataFrame) -> DataFrame:
    """documents with __id and __hash, which tell their texts apart: by hash where a doc_id has several, else the number is 0 and weighs nothing."""
    own = documents.withColumn("__id", F.col("doc_id").cast("long"))
    texts = own.where("__id is not null").groupBy("__id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    several = cut(texts.where("a <> b").select(F.col("__id").alias("__several")))
    if not several.head(1):
        return own.withColumn("__hash", F.lit(0).cast("long"))
    joined = own.join(several, F.col("__id") == F.col("__several"), "left")
    return joined.withColumn("__hash", F.when(F.col("__several").isNull(), 0).otherwise(F.xxhash64("text"))).drop("__several")


def with_spans(own: DataFrame, found: DataFrame) -> DataFrame:
    """Identified documents with __low and __size, the packed spans of each row; rows without a doc_id have none."""
    spans = found.select(F.col("doc").alias("__id"), F.col("hash").alias("__hash"), F.col("low").alias("__low"), F.col("size").alias("__size"))
    joined = own.where("__id is not null").join(spans, ["__id", "__hash"], "left")
    return joined.unionByName(own.where("__id is null"), allowMissingColumns=True).drop("__id", "__hash")
