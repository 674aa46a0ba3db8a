"""Repeated word passages by recompression: runs and pairs of words get names, and shared names reveal long repeats.

A window is `width` words of one document; words in a window whose sequence also starts elsewhere, in the same document
or another, are removed. Words have 64-bit names. The first step names runs of equal words, the next ones name pairs: a
name is in the left or right class of a step by a hash, and a left one with a right one behind it becomes their pair's
name. A name is made of what it stands for, so equal substrings get equal symbols in their interior: symbols have at most
`caps` words, so what becomes of a place depends on the words near it alone, and a window's symbols are its own but for
`margin` words at either end (see `margins`).

Which names are shared is known only globally. Spark's rounds bring the occurrences of each name together, from long
symbols down:

1. Symbols of `width` words and more, of steps up to `longest` words. Where two have one name and one hash of their words,
   all windows inside are verified at once. One occurrence of each goes on to speak for the others, whose windows are done.
2. Windows that aren't done pick the symbol of the least hash in their interior, so equal windows pick equal symbols at
   equal places. Each pick's name (with the words about it that each of its windows holds, as a common symbol alone reveals
   nothing) goes out with a hash of its context, the words of all windows that picked it. Contexts that occur twice verify
   all their windows; symbols that contexts share which differ leave these open.
3. Open contexts fetch their words, and two hashes of each of their windows meet: windows that occur twice are verified one
   by one.

Then the spans meet the documents again, in one join. Names are hashes and not numbers dealt out by a table, so a round
sends a name once and needs no answer before the next step of the parse; two symbols, contexts or windows are compared by
128 bits. In a block of texts occurrences of equal content are sent once.

Defined results: doc_id is any integer type; null text has no words; texts of fewer than `width` words lose nothing; rows
with a null doc_id take no part and lose nothing; equal rows are each other's repeats, and rows of one doc_id with other
texts each have their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._anchors import anchors
from ledgerloom.llm._groups import SPAN, by_key, covered, deal, filled, grouped, identified, packed_rows, packed_sql, packed_types, pieces, spans_of, unpacked, whole_groups, with_spans
from ledgerloom.llm._shared import cut
from ledgerloom.llm._text import U, blocks, join_hashes, mix, raw, rows_of, run_hashes, spans


@dataclass(frozen=True)
class Passages:
    width: int = 35
    #: Words of the longest symbols, in steps of doubling.
    longest: int = 128
    bucket_bytes: int = 48 << 20
    part_bytes: int = 16 << 20
    most_tasks: int = 20_000


def margins(width: int) -> tuple[list[int], int]:
    """Caps of the rounds' symbols in words, and the words at a window's ends that its symbols may depend on more than it.

    A run or pair is decided by the symbols on both sides of a place, so a round adds the cap of the symbols before it
    to the margin; the run round also has to see where a run ends. Rounds go on while a window's interior surely holds a
    whole symbol.
    """
    caps, margin = [2, 2], 1 + 2 + 2
    while width - 2 * (margin + caps[-1]) >= 2 * (2 * caps[-1]) - 1:
        margin += caps[-1]
        caps.append(2 * caps[-1])
    return caps, margin


@dataclass
class Symbols:
    """Names, first words and lengths in words of a parse, and the text of each."""

    name: np.ndarray
    start: np.ndarray
    size: np.ndarray
    row: np.ndarray

    def merged(self, joined: np.ndarray, name: np.ndarray) -> Symbols:
        """joined: symbols that become part of the one before; name: names of those that stay."""
        first = np.flatnonzero(~joined)
        return Symbols(name[first], self.start[first], np.add.reduceat(self.size, first) if len(first) else self.size, self.row[first])


def name_runs(s: Symbols, cap: int) -> Symbols:
    """Runs of equal symbols of at most `cap` words in all become one symbol; longer runs stay as they are."""
    n = len(s.name)
    same = np.zeros(n, bool)
    same[1:] = (s.name[1:] == s.name[:-1]) & (s.row[1:] == s.row[:-1])
    first = np.flatnonzero(~same)
    count = np.diff(np.append(first, n))
    words = np.add.reduceat(s.size, first) if n else s.size
    short = words <= cap
    joined = same & np.repeat(short, count)
    run = np.repeat(np.where(short, count, 1), count).astype(U)
    return s.merged(joined, np.where(run > 1, mix(s.name ^ mix(run)), s.name))


def name_pairs(s: Symbols, cap: int, turn: int) -> Symbols:
    """A left-class symbol and a right-class one behind it become one symbol of at most `cap` words."""
    left = (mix(s.name ^ U(0x9E37 + turn)) & U(1)) == 0
    joined = np.zeros(len(s.name), bool)
    joined[1:] = left[:-1] & ~left[1:] & (s.row[1:] == s.row[:-1]) & (s.size[1:] + s.size[:-1] <= cap)
    name = s.name.copy()
    k = np.flatnonzero(joined)
    name[k - 1] = mix(mix(s.name[k - 1] + U(turn)) * U(0x9E3779B97F4A7C15) + s.name[k])
    return s.merged(joined, name)


def recompress(words: np.ndarray, row: np.ndarray, caps: list[int]) -> Symbols:
    s = Symbols(words, np.arange(len(words)), np.ones(len(words), np.int64), row)
    s = name_runs(s, caps[0])
    for turn, cap in enumerate(caps[1:], 1):
        s = name_pairs(s, cap, turn)
    return s


def _words(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, their text, each text's first word."""
    data, offsets = raw(block.column("text"))
    starts, ends, first = spans(data, offsets)
    return run_hashes(data, starts, ends), rows_of(first), first


_PICK = (*SPAN[:3], ("size", np.uint16), ("many", np.uint8), ("name", U), ("context", U))
_WINDOW = (*SPAN[:3], ("many", np.uint8), ("first", U), ("second", U))


#: Pair steps for each doubling of the cap of long symbols.
STEPS = 4


def long_symbols(block: pa.RecordBatch, passages: Passages) -> list[np.ndarray]:
    """row, low, size, name, context of each symbol of `width` words and more, in words of its text."""
    words, row, first = _words(block)
    caps = [2]
    while caps[-1] < passages.longest:  # a step joins about a quarter of the symbols, so each cap has several
        caps += [caps[-1] * 2] * STEPS
    s = recompress(words, row, caps)
    k = np.flatnonzero(s.size >= passages.width)
    start, size = s.start[k], s.size[k]
    return [row[start], start - first[row[start]], size, s.name[k], _between(words, start, start + size)]


def picks(block: pa.RecordBatch, passages: Passages, done: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """row, low, size, name, context of each pick of the block's texts, in words; done: each text's spans whose windows are verified."""
    words, row, first = _words(block)
    width = passages.width
    caps, margin = margins(width)
    s = recompress(words, row, caps)
    n = len(words)
    names = np.full(n, U(2**64 - 1))
    names[s.start] = s.name
    windows = max(0, n - width + 1)
    valid = row[:windows] == row[width - 1 :]
    within = width - 2 * margin - caps[-1] + 1
    order = np.full(n, U(2**64 - 1))
    order[s.start] = mix(s.name)
    at, low, high = anchors(order[margin : margin + windows + within - 1], within, valid)
    # whole contexts, as they are alike in all texts, but for those whose windows are all done
    change = np.zeros(n + 1, np.int64)
    for r, (a, size) in enumerate(done):
        np.add.at(change, first[r] + a, 1)
        np.add.at(change, first[r] + a + size - width + 1, -1)
    open_ = np.append(0, np.cumsum((np.cumsum(change[:-1]) == 0)[:windows]))
    some = open_[high + 1] > open_[low]
    at, low, high = at[some] + margin, low[some], high[some]
    # the words that every window of a pick holds, so that common symbols in different surroundings don't meet
    core = join_hashes(words, width - within + 1)
    context = _between(words, low, high + width) ^ mix(((high - low) * 64 + (at - low)).astype(U))
    return [row[low], low - first[row[low]], high - low + width, mix(names[at] ^ core[at - margin]), context]


def _between(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the words in [low, high), by sums of the words' hashes times powers of the place."""
    if not len(low):
        return np.zeros(0, U)
    longest = int((high - low).max())
    out = np.zeros(len(low), U)
    for k in range(longest):
        at = low + k
        live = at < high
        out[live] = out[live] * U(0xD6E8FEB86659FD93) + words[at[live]]
    return mix(out)


def _equal_runs(arrays: list[np.ndarray]) -> np.ndarray:
    """Whether each element of sorted arrays differs from the one before in any of them."""
    new = np.ones(len(arrays[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in arrays])
    return new


def _sent(block: pa.RecordBatch, found: list[np.ndarray], buckets: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Occurrences by the bucket of their names. Of equal ones in the block the first is sent, as one of many, and the others are verified here."""
    row, low, size, name, context = found
    doc, text = (np.asarray(block.column(k), np.int64)[row] for k in ("doc_id", "hash"))
    k = np.lexsort((low, text, doc, context, name))
    new = _equal_runs([name[k], context[k]])
    count = np.diff(np.append(np.flatnonzero(new), len(k)))
    gone, send = k[~new], k[new]
    # apart from the buckets, and spread like them
    for b in deal([x[gone] for x in (doc, text, low, size)], parts):
        yield filled(b.set_column(0, "key", pa.array(-1 - np.asarray(b.column("key")), pa.int32())), _SENT)
    yield from packed_rows((name[send] >> U(40)).astype(np.int64) % buckets, [x[send] for x in (doc, text, low, size)] + [count > 1, name[send], context[send]], _PICK)


_SENT = {"key": pa.int32()} | packed_types(_PICK)
_SENT_SQL = f"key int, {packed_sql(_PICK)}"


def _scan_long(passages: Passages, buckets: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, most=1 << 23):
                yield from _sent(block, long_symbols(block, passages), buckets, parts)

    return run


def _scan(passages: Passages, buckets: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, most=1 << 23):
                done = [tuple(np.frombuffer(x or b"", np.int32) for x in pair) for pair in zip(block.column("low").to_pylist(), block.column("size").to_pylist(), strict=True)]
                yield from _sent(block, picks(block, passages, done), buckets, parts)

    return run


_DECIDED = {"key": pa.int32(), "kind": pa.int32(), "many": pa.int64()} | packed_types(SPAN)
_DECIDED_SQL = f"key int, kind int, many long, {packed_sql(SPAN)}"


def _decide(parts: int, long: bool):
    """Of whole buckets: verified spans of those that others speak for (kind 0), of those that speak (kind 2), and open contexts (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("key",)):
            for table in by_key(table):
                if int(table.column("key")[0].as_py()) < 0:
                    yield from rows(0, unpacked(table, SPAN))
                    continue
                doc, text, low, size, many, name, context = unpacked(table, _PICK)
                k = np.lexsort((low, text, doc, context, name))
                new = _equal_runs([name[k], context[k]])
                group = np.cumsum(new) - 1
                twice = ((np.bincount(group) > 1) | (np.bincount(group, many[k]) > 0))[group] if len(k) else new
                spans = [doc, text, low, size]
                yield from rows(0, [x[k[twice & ~new]] for x in spans])
                yield from rows(2, [x[k[twice & new]] for x in spans])
                if not long:
                    # one record of each context of symbols that contexts share
                    symbol = np.cumsum(_equal_runs([name[k]])) - 1
                    ask = new & (np.bincount(symbol[new]) > 1)[symbol] if len(k) else new
                    for verified in (False, True):
                        for b in deal([x[k[ask & (twice == verified)]] for x in spans], parts):
                            yield filled(b, _DECIDED, kind=1, many=int(verified))

    def rows(kind: int, spans: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for b in deal(spans, parts):
            yield filled(b, _DECIDED, kind=kind)

    return run


def _windows_of(passages: Passages, buckets: int):
    """Two hashes of each window of the open contexts, by bucket."""
    width = passages.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                words, _, first = _words(block)
                low, size, many = (np.concatenate([np.frombuffer(x, kind) for x in block.column(k).to_pylist()]) for k, kind in (("low", np.int32), ("size", np.int32), ("many", np.int64)))
                row = np.repeat(np.arange(block.num_rows), [len(x) // 4 for x in block.column("low").to_pylist()])
                doc, text = (np.asarray(block.column(k), np.int64)[row] for k in ("doc", "hash"))
                one, two = join_hashes(words, width), join_hashes(mix(words ^ U(0x5851F42D4C957F2D)), width)
                n = size - width + 1
                which = np.repeat(np.arange(len(row)), n)
                step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                at = (first[row] + low)[which] + step
                yield from packed_rows((one[at] >> U(40)).astype(np.int64) % buckets, [doc[which], text[which], low[which] + step, many[which], one[at], two[at]], _WINDOW)

    return run


def _verify(passages: Passages, parts: int):
    """Windows that occur twice in a bucket, as spans; those of verified contexts only speak for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("key",)):
            for table in by_key(table):
                doc, text, low, many, one, two = unpacked(table, _WINDOW)
                k = np.lexsort((two, one))
                group = np.cumsum(_equal_runs([one[k], two[k]])) - 1
                k = k[(np.bincount(group) > 1)[group] & (many[k] == 0)]
                k = k[np.lexsort((low[k], text[k], doc[k]))]
                # windows next to one another are one span
                new = _equal_runs([doc[k], text[k]])
                new[1:] |= low[k][1:] > low[k][:-1] + 1
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(k)) - 1
                size = low[k][last] - low[k][first] + passages.width if len(k) else low[k]
                for b in deal([doc[k][first], text[k][first], low[k][first], size], parts):
                    yield filled(b, _DECIDED, kind=0)

    return run


def _kept_texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """For each row its kept words joined by one space."""
    row = rows_of(first)[keep]
    starts, size = starts[keep], ends[keep] - starts[keep] + 1
    total = np.cumsum(size)
    index = np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - size), size)
    out = np.append(data, np.uint8(32))[np.minimum(index, len(data))]
    out[total - 1] = 32
    per_row = np.bincount(row, size, len(first) - 1).astype(np.int64)
    upto = np.cumsum(per_row)
    joined = out.tobytes()
    return [joined[a : b - 1] if b > a else b"" for a, b in zip((upto - per_row).tolist(), upto.tolist(), strict=True)]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch):
            data, offsets = raw(block.column("text"))
            starts, ends, first = spans(data, offsets)
            gone = np.zeros(len(starts), bool)
            for i, (low, size) in enumerate(zip(block.column("__low").to_pylist(), block.column("__size").to_pylist(), strict=True)):
                if low:
                    gone[first[i] : first[i + 1]] = covered(int(first[i + 1] - first[i]), np.frombuffer(low, np.int32), np.frombuffer(size, np.int32))
            removed = np.bincount(rows_of(first)[gone], minlength=block.num_rows)
            kept = _kept_texts(data, starts, ends, first, ~gone)
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
            yield pa.record_batch([block.column("doc_id"), np.diff(first), removed, [hashlib.sha256(k).hexdigest() for k in kept], [k.decode() for k in kept]], names=names)


def remove_passages(documents: DataFrame, passages: Passages = Passages()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (its words joined by one space) of each row."""
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, parts, most = pieces(total, passages.bucket_bytes), pieces(total, passages.part_bytes), passages.most_tasks
    own = identified(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    docs = own.where("__id is not null").select("doc_id", F.col("__hash").alias("hash"), "text")
    named = docs.withColumnRenamed("doc_id", "doc")
    names = ["key", *[k for k, _ in SPAN]]

    # round 1: long symbols
    long = cut(grouped(docs.mapInArrow(_scan_long(passages, buckets, parts), _SENT_SQL), buckets, most).mapInArrow(_decide(parts, True), _DECIDED_SQL))
    # round 2: the symbols that the other windows pick
    left = named.join(spans_of(long.where("kind = 0").select(*names), parts, most), ["doc", "hash"], "left").withColumnRenamed("doc", "doc_id")
    decided = cut(grouped(left.mapInArrow(_scan(passages, buckets, parts), _SENT_SQL), buckets, most).mapInArrow(_decide(parts, False), _DECIDED_SQL))
    # round 3: the windows of open contexts
    asks = decided.where("kind = 1").select("key", *[k for k, _ in SPAN], "many")
    asked = named.dropDuplicates(["doc", "hash"]).join(spans_of(asks, parts, most, ("many",)), ["doc", "hash"])
    verified = cut(grouped(asked.mapInArrow(_windows_of(passages, buckets), f"key int, {packed_sql(_WINDOW)}"), buckets, most).mapInArrow(_verify(passages, parts), _DECIDED_SQL))

    spans_ = long.where("kind <> 1").select(*names).union(decided.where("kind <> 1").select(*names)).union(verified.select(*names))
    return with_spans(own, spans_of(spans_, parts, most)).mapInArrow(_apply, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
