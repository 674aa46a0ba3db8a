"""Exact substring deduplication: suffix arrays of shards, common prefixes, and a merge across shards.

A byte goes if a `width`-byte string that covers it also starts in a document of a smaller doc_id.

1. Documents are read once, in shards of about `shard_bytes`. Every string picks an anchor, a `gram`-byte string in it, by
   its content alone, so equal strings have equal anchors at equal places. Each shard sorts the suffixes of its passages
   whose anchors it has twice (Larsson-Sadakane) and takes common prefixes (Kasai): suffixes in a row with a common prefix
   of `width` are one string, and all its places but those of the smallest doc_id are decided. The other strings of the
   shard occur there once. Equal texts of a shard enter it once.
2. Only the smallest document's places of a string go on, to be merged across shards. Not all of them must: a string whose
   anchor no other shard has is settled. Each anchor's hash goes, with a hash of
   its context (the bytes of all the strings that picked it, some of them undecided), as packed and sorted lists to buckets of anchors.
   There contexts equal to one of a smaller doc_id are decided; contexts that differ but share an anchor stay open.
3. Open contexts fetch their bytes and are suffix-sorted again, in shards of whole anchor groups. A group larger than a
   shard is split, and what its shards leave undecided, one entry a shard and string, is merged by binary search among
   the sorted strings.
4. The decided spans meet the documents again, in one join.

Contexts are told apart by 128 bits of hash (anchor and context); shards and merges compare bytes.

Scale: rows are packed by shard and bucket; up to `most_tasks` tasks sort buckets on disk and hold one at a time. An
anchor whose contexts differ in every document (the ends of a footer) weighs 37 bytes a document in its bucket.

Defined results: doc_id is any integer type; null text is empty; texts shorter than `width` lose nothing; rows with a null
doc_id take no part and lose nothing; rows of one doc_id never cover one another, each loses what its own text repeats of
smaller doc_ids, and repeated rows all get the same result; an empty table gives no rows; other columns are kept by
deduplicate and ignored else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._anchors import anchors
from ledgerloom.llm._groups import SPAN, by_key, covered, deal, filled, grouped, identified, packed_rows, packed_sql, packed_types, pieces, spans_of, unpacked, whole_groups, with_spans
from ledgerloom.llm._shared import cut
from ledgerloom.llm._text import U, blocks, mix, pack, raw, run_hashes, window_hashes
from ledgerloom.llm.suffix_arrays import common_prefixes, suffix_array


@dataclass(frozen=True)
class Repeats:
    width: int = 50
    gram: int = 20
    shard_bytes: int = 1_000_000
    #: Bytes of text for each bucket of anchors and for each part of the documents.
    bucket_bytes: int = 12 << 20
    part_bytes: int = 16 << 20
    most_tasks: int = 20_000


#: A context has less than 2 * width - gram bytes.
_OCCURRENCE = (*SPAN[:3], ("size", np.uint16), ("fp", U), ("context", U))


def _first_copies(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row the row of the smallest doc that holds the same bytes."""
    joined, at, seen = data.tobytes(), offsets.tolist(), {}
    out = np.arange(len(doc))
    for i in np.argsort(doc, kind="stable").tolist():
        out[i] = seen.setdefault(joined[at[i] : at[i + 1]], i)
    return out


def _scan(repeats: Repeats, buckets: int, parts: int):
    """Of each shard the decided spans (a negative key) and the anchors of the strings that are not (their bucket)."""
    width = repeats.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, most=repeats.shard_bytes):
                yield from shard(*raw(block.column("text")), *(np.asarray(block.column(k), np.int64) for k in ("doc_id", "hash")))

    def shard(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, text: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.diff(offsets)
        first = _first_copies(data, offsets, doc)
        copy = np.flatnonzero((doc > doc[first]) & (size >= width))
        own = np.flatnonzero((first == np.arange(len(doc))) & (size >= width))
        spans = [[doc[copy], text[copy], np.zeros(len(copy)), size[copy]]]
        data = np.concatenate([data[a:b] for a, b in zip(offsets[own].tolist(), offsets[own + 1].tolist(), strict=True)] or [data[:0]])
        doc, text, size = doc[own], text[own], size[own]
        starts = np.cumsum(size) - size
        row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        valid = row[: max(0, len(data) - width + 1)] == row[width - 1 :]
        h = window_hashes(data, repeats.gram)
        at, low, high = anchors(h, width - repeats.gram + 1, valid)
        # a string whose anchor occurs once in the shard is alone there: passages of the others are suffix-sorted
        order = np.argsort(h[at])
        again = h[at[order[1:]]] == h[at[order[:-1]]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][again]] = twice[order[:-1][again]] = True
        begin, end = low[twice], high[twice] + width
        new = np.ones(len(begin), bool)
        new[1:] = (begin[1:] > end[:-1]) | (row[begin[1:]] != row[begin[:-1]])
        first_of = np.flatnonzero(new)
        last_of = np.append(first_of, len(begin))[1:] - 1
        begin, length = begin[first_of], end[last_of] - begin[first_of]
        passages = np.concatenate([data[a : a + n] for a, n in zip(begin.tolist(), length.tolist(), strict=True)] or [data[:0]])
        place, gone = repeated_strings(passages, length, doc[row[begin]], width)
        inside = np.cumsum(length) - length
        of = np.searchsorted(inside, place, "right") - 1
        place = begin[of] + place - inside[of]
        spans.append(_runs(place[gone], starts, doc, text, np.zeros(len(doc), np.int64), width))
        yield from _scanned(deal([np.concatenate(x) for x in zip(*spans, strict=True)], parts), decided=True)
        undecided = valid.copy()
        undecided[place[gone]] = False
        # whole contexts, as they are alike in all shards, but for those whose strings are all decided
        upto = np.append(0, np.cumsum(undecided, dtype=np.int64))
        some = upto[high + 1] > upto[low]
        at, low, high = at[some], low[some], high[some]
        fp = h[at]
        context = run_hashes(data, low, high + width) ^ mix((at - low).astype(U))
        row = np.searchsorted(starts, low, "right") - 1
        # sorted lists, and of equal contexts of one document one record: the others are decided with it or not at all
        order = np.lexsort((doc[row], context, fp))
        yield from _scanned(packed_rows((fp[order] >> U(40)).astype(np.int64) % buckets, [x[order] for x in (doc[row], text[row], low - starts[row], high - low + width, fp, context)], _OCCURRENCE))

    return run


def _scanned(rows: Iterator[pa.RecordBatch], decided: bool = False) -> Iterator[pa.RecordBatch]:
    for b in rows:
        key = b.column("key")
        if decided:  # apart from the buckets, and spread like them
            key = pa.array(-1 - np.asarray(key), pa.int32())
        yield pa.record_batch([key, *[b.column(k) if k in b.schema.names else pa.nulls(b.num_rows, pa.binary()) for k, _ in _OCCURRENCE]], names=["key", *[k for k, _ in _OCCURRENCE]])


def _decide(repeats: Repeats, parts: int):
    """Of whole buckets: spans (kind 0) and, of open contexts, what to ask for (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("key",)):
            for table in by_key(table):
                if int(table.column("key")[0].as_py()) < 0:
                    for b in deal(unpacked(table, SPAN), parts):
                        yield filled(b, _DECIDED, kind=0)
                else:
                    yield from bucket(int(table.column("key")[0].as_py()), *unpacked(table, _OCCURRENCE))

    def bucket(key: int, doc, text, low, size, fp, context) -> Iterator[pa.RecordBatch]:
        order = np.argsort(fp)
        again = fp[order][1:] == fp[order][:-1]
        twice = np.zeros(len(fp), bool)
        twice[order[1:][again]] = twice[order[:-1][again]] = True
        k = np.flatnonzero(twice)
        k = k[np.lexsort((doc[k], context[k], fp[k]))]
        new_fp = np.ones(len(k), bool)
        new_fp[1:] = fp[k][1:] != fp[k][:-1]
        new = new_fp.copy()
        new[1:] |= context[k][1:] != context[k][:-1]
        first = doc[k][new][np.cumsum(new) - 1] if len(k) else doc[k]
        decided = doc[k] > first
        gone = k[decided]
        group = np.cumsum(new_fp) - 1
        n = int(group[-1]) + 1 if len(k) else 0
        contexts = np.bincount(group[new], minlength=n)
        least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(least, group[new], first[new])
        np.maximum.at(most, group[new], first[new])
        k = k[~decided & ((contexts > 1) & (least < most))[group]]
        for b in deal([x[gone] for x in (doc, text, low, size)], parts):
            yield filled(b, _DECIDED, kind=0)
        # open contexts go to shards in the order of their anchors
        upto = np.cumsum(size[k].astype(np.int64))
        new_fp = np.ones(len(k), bool)
        new_fp[1:] = fp[k][1:] != fp[k][:-1]
        starts = np.flatnonzero(new_fp)
        group = np.cumsum(new_fp) - 1
        group_from = (upto - size[k])[starts]
        group_bytes = np.diff(np.append(group_from, upto[-1] if len(k) else 0))
        large = group_bytes > repeats.shard_bytes
        where = np.where(large[group], upto - size[k], group_from[group]) // repeats.shard_bytes if len(k) else k
        for shard in np.unique(where).tolist():
            for split in (False, True):
                j = k[(where == shard) & (large[group] == split)]
                for b in deal([x[j] for x in (doc, text, low, size)], parts):
                    yield filled(b, _DECIDED, kind=1, shard=(key << 24) + shard, split=split)

    return run


_DECIDED = {"key": pa.int32(), "kind": pa.int32(), "shard": pa.int64(), "split": pa.bool_()} | packed_types(SPAN)
_DECIDED_SQL = "key int, kind int, shard long, split boolean, " + packed_sql(SPAN)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of open contexts, as rows for their shards."""
    for batch in batches:
        for block in blocks(batch):
            data, offsets = raw(block.column("text"))
            low, size, shard, split = (np.concatenate([np.frombuffer(x, kind) for x in block.column(k).to_pylist()]) for k, kind in _FETCH)
            row = np.repeat(np.arange(block.num_rows), [len(x) // 4 for x in block.column("low").to_pylist()])
            doc, text = (np.asarray(block.column(k), np.int64)[row] for k in ("doc", "hash"))
            order = np.lexsort((split, shard))
            start = offsets[row] + low
            new = np.ones(len(order), bool)
            new[1:] = (shard[order][1:] != shard[order][:-1]) | (split[order][1:] != split[order][:-1])
            for k in np.split(order, np.flatnonzero(new)[1:]) if len(order) else []:
                joined = b"".join(data[a : a + n].tobytes() for a, n in zip(start[k].tolist(), size[k].tolist(), strict=True))
                yield pa.record_batch([pa.array(x, t) for x, t in zip(([shard[k[0]]], [bool(split[k[0]])], *([pack(x[k])] for x in (doc, text, low, size)), [joined]), _FETCHED.values(), strict=True)], names=list(_FETCHED))


_FETCH = (("low", np.int32), ("size", np.int32), ("shard", np.int64), ("split", np.int64))
_FETCHED = {"key": pa.int64(), "split": pa.bool_()} | packed_types(SPAN) | {"bytes": pa.binary()}


def repeated_strings(data: np.ndarray, sizes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in data, whether a smaller doc has it) of every `width`-byte string of the texts in data, in the order of strings."""
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    whole = np.zeros(len(data), bool)
    whole[: max(0, len(data) - width + 1)] = text[: len(data) - width + 1] == text[width - 1 :] if len(data) >= width else False
    order, shared = suffix_array(data, width)
    prefix = common_prefixes(data, order, starts, sizes, width, shared)
    place = np.flatnonzero(whole[order])
    at = order[place]
    # a string begins where the least prefix since the place before is below width
    below = np.cumsum(prefix < width, dtype=np.int32)[place]
    new = np.ones(len(place) + 1, bool)
    new[1:-1] = below[1:] != below[:-1]
    gone = np.zeros(len(place), bool)
    several = np.flatnonzero(~(new[:-1] & new[1:]))
    string = np.cumsum(new[several]) - 1
    owner = doc[text[at[several]]]
    least = np.full(int(string[-1]) + 1 if len(string) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, string, owner)
    gone[several] = owner > least[string]
    return at, gone


def _runs(at: np.ndarray, starts: np.ndarray, doc: np.ndarray, text: np.ndarray, low: np.ndarray, width: int) -> list[np.ndarray]:
    """Spans of strings at consecutive places of the data; starts: where its texts begin."""
    at = np.sort(at)
    of = np.searchsorted(starts, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    of, at, size = of[first], at[first], at[last] - at[first] + width if len(at) else at
    return [doc[of], text[of], low[of] + at - starts[of], size]


_SHARDED = {"key": pa.int32(), "kind": pa.int32()} | packed_types(SPAN) | {"strings": pa.binary()}
_SHARDED_SQL = f"key int, kind int, {packed_sql(SPAN)}, strings binary"


def _sort_shards(repeats: Repeats, parts: int, merges: int):
    """Spans (kind 0) and, of split anchor groups, the strings to merge (kind 1)."""
    width = repeats.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("key",)):
            for table in by_key(table):
                doc, text, low, size = unpacked(table, SPAN)
                data = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
                counts = [len(x) // 8 for x in table.column("doc").to_pylist()]
                split = np.repeat(np.array(table.column("split").to_pylist(), bool), counts)
                starts = np.cumsum(size, dtype=np.int64) - size
                place, gone = repeated_strings(data, size.astype(np.int64), doc, width)
                for b in deal(_runs(place[gone], starts, doc, text, low, width), parts):
                    yield filled(b, _SHARDED, kind=0)
                # undecided: for each string one entry a place of the smallest doc, in the order of strings
                start = place[~gone] if split.any() else place[:0]
                of = np.searchsorted(starts, start, "right") - 1
                start, of = start[split[of]], of[split[of]]
                if len(start):
                    strings = data[start[:, None] + np.arange(width)[None, :]]
                    to = (window_hashes(strings.reshape(-1), width)[::width] % U(merges)).astype(np.int64)
                    order = np.argsort(to, kind="stable")
                    start, of, to, strings = start[order], of[order], to[order], strings[order]
                    edges = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        own = of[a:b]
                        packed = [pack(x) for x in (doc[own], text[own], (low[own] + start[a:b] - starts[own]).astype(np.int32))]
                        yield pa.record_batch([pa.array([x], t) for x, t in zip((int(to[a]), 1, *packed, None, strings[a:b].tobytes()), _SHARDED.values(), strict=True)], names=list(_SHARDED))

    return run


def _merge(repeats: Repeats, parts: int):
    """Finds each shard's strings among all by binary search; those of a larger doc than the smallest are decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("key",)):
            for table in by_key(table):
                strings = np.frombuffer(b"".join(table.column("strings").to_pylist()), f"S{repeats.width}")
                doc, text, low = unpacked(table, SPAN[:3])
                known = np.unique(strings)
                at = np.searchsorted(known, strings)
                least = np.full(len(known), np.iinfo(np.int64).max)
                np.minimum.at(least, at, doc)
                gone = doc > least[at]
                for b in deal([doc[gone], text[gone], low[gone], np.full(int(gone.sum()), repeats.width)], parts):
                    yield filled(b, _SHARDED, kind=0)

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[bytes, int, int]]]]:
    """Blocks of documents and, for each row, the bytes that stay, how many go and in how many spans."""
    for batch in batches:
        for block in blocks(batch):
            data, offsets = raw(block.column("text"))
            out = []
            for a, b, low, size in zip(offsets[:-1].tolist(), offsets[1:].tolist(), block.column("__low").to_pylist(), block.column("__size").to_pylist(), strict=True):
                kept, n_removed, n_spans = data[a:b], 0, 0
                if low:
                    gone = covered(b - a, np.frombuffer(low, np.int32), np.frombuffer(size, np.int32))
                    n_removed, n_spans = int(gone.sum()), int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1]))
                    kept = kept[~gone]
                out.append((kept.tobytes(), n_removed, n_spans))
            yield block, out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, found in _removed(batches):
        columns = [[len(k) + n for k, n, _ in found], [n for _, n, _ in found], [m for _, _, m in found], [hashlib.sha256(k).hexdigest() for k, _, _ in found]]
        yield pa.record_batch([block.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_spans(documents: DataFrame, repeats: Repeats) -> DataFrame:
    """documents with low and size, packed: the spans of each row that go."""
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, parts = pieces(total, repeats.bucket_bytes), pieces(total, repeats.part_bytes)

    most = repeats.most_tasks
    own = identified(documents)
    docs = own.where("__id is not null").select(F.col("__id").alias("doc_id"), F.col("__hash").alias("hash"), F.col("text").cast("string").alias("text"))
    sent = docs.mapInArrow(_scan(repeats, buckets, parts), f"key int, {packed_sql(_OCCURRENCE)}")
    decided = cut(grouped(sent, buckets, most).mapInArrow(_decide(repeats, parts), _DECIDED_SQL))

    asks = spans_of(decided.where("kind = 1").drop("kind"), parts, most, ("shard", "split"))
    texts = docs.withColumnRenamed("doc_id", "doc").dropDuplicates(["doc", "hash"])
    fetched = texts.join(asks, ["doc", "hash"]).mapInArrow(_fetch, f"key long, split boolean, {packed_sql(SPAN)}, bytes binary")
    sharded = cut(grouped(fetched, buckets, most).mapInArrow(_sort_shards(repeats, parts, buckets), _SHARDED_SQL))
    merged = grouped(sharded.where("kind = 1"), buckets, most).mapInArrow(_merge(repeats, parts), _SHARDED_SQL)

    names = ["key", *[k for k, _ in SPAN]]
    spans = decided.where("kind = 0").select(*names).union(sharded.where("kind = 0").select(*names)).union(merged.select(*names))
    return with_spans(own, spans_of(spans, parts, most))


def remove_repeats(documents: DataFrame, repeats: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    rows = _with_spans(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), repeats)
    return rows.mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(documents: DataFrame, repeats: Repeats = Repeats()) -> DataFrame:
    """The documents in their own columns, without their repeats; those of which white space at most is left go.

    A character that loses some of its bytes loses all. n_chars follows where it is a column.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, found in _removed(batches):
            yield block.drop_columns(["__low", "__size"]).append_column("__kept", pa.array([k.decode("utf-8", "ignore") if n else None for k, n, _ in found], pa.string()))

    rows = _with_spans(documents, repeats)
    schema = T.StructType([*documents.schema.fields, T.StructField("__kept", T.StringType())])
    out = rows.mapInArrow(kept, schema).where(F.col("__kept").isNull() | F.col("__kept").rlike(r"\S")).withColumn("text", F.coalesce("__kept", "text"))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)
