"""Bytes, words and hashes of Arrow text columns as numpy arrays; all in linear time, no loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed byte classes: the white space of the word contracts, and what separates terms (all ASCII but letters and digits).
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

U = np.uint64
#: Bytes that are hashed at once; their tables of powers fit a CPU's cache.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_BYTE = mix(np.arange(1, 257, dtype=U))
_POWER: np.ndarray | None = None
_INVERSE: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    global _POWER, _INVERSE
    if _POWER is None:
        _POWER, _INVERSE = _powers(_BASE, PIECE + 1), _powers(pow(_BASE, -1, 2**64), PIECE + 1)
    return _POWER, _INVERSE


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the column, null as empty, and the offsets of its rows (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    column = pc.fill_null(column, b"") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _give_back() -> None:
    """Returns free memory to the system: a Python worker lives on, and beside others, when its task is done."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lowered(column: pa.Array) -> pa.Array:
    """The texts in lower case, of every script."""
    return pc.utf8_lower(column)


def blocks(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text; a longer text is a slice of its own."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()))
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
    _give_back()


def spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't `outside`, and each row's first run (one more than rows)."""
    inner = ~outside[data]
    first, last = inner.copy(), inner.copy()
    first[1:] &= ~inner[:-1]
    last[:-1] &= ~inner[1:]
    full = offsets[:-1] < offsets[1:]
    first[offsets[:-1][full]] = inner[offsets[:-1][full]]
    last[offsets[1:][full] - 1] = inner[offsets[1:][full] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes; runs are in order and may be cut from the front of one another, not nested."""
    power, inverse = _tables()
    out = np.empty(len(starts), U)
    k = 0
    while k < len(starts):
        low = starts[k]
        to = max(k + 1, int(np.searchsorted(starts, low + PIECE // 2)))
        high = int(ends[k:to].max())
        if high - low > PIECE:  # a run longer than the tables
            to = k + 1
            high = int(ends[k])
            if high - low > PIECE:
                h = U(0)
                for a in range(int(low), high, PIECE):
                    part = _BYTE[data[a : min(a + PIECE, high)]]
                    h = mix(np.array([h + (part * power[: len(part)]).sum(dtype=U)], U))[0]
                out[k] = h
                k = to
                continue
        sums = np.zeros(high - low + 1, U)
        np.cumsum(_BYTE[data[low:high]] * power[: high - low], out=sums[1:])
        s, e = starts[k:to] - low, ends[k:to] - low
        out[k:to] = (sums[e] - sums[s]) * inverse[s]
        k = to
    return mix(out ^ ((ends - starts).astype(U) * U(0xD6E8FEB86659FD93)))


def window_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive bytes; shorter by n - 1."""
    power, inverse = _tables()
    out = np.empty(max(0, len(data) - n + 1), U)
    step = PIECE - n
    for low in range(0, len(out), step):
        part = _BYTE[data[low : low + step + n - 1]]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        k = len(part) - n + 1
        out[low : low + k] = mix((sums[n:] - sums[:k]) * inverse[:k])
    return out


def join_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive elements, by doubling; shorter by n - 1."""
    if len(h) < n:
        return h[:0]
    done, out, power, size = 0, None, h, 1
    rest = n
    while rest:
        if rest & 1:
            piece = power[done : done + len(h) - n + 1]
            out = piece * U(size * 2 + 1) if out is None else mix(out) * U(0xC2B2AE3D27D4EB4F) + piece * U(size * 2 + 1)
            done += size
        rest >>= 1
        if rest:
            power = mix(power[:-size] * U(0x9E3779B97F4A7C15) + power[size:])
            size *= 2
    return mix(out)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each run."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def pack(x: np.ndarray) -> bytes:
    """The array's bytes, first bytes first: zeros of small numbers lie together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def spark_hash(x: np.ndarray) -> np.ndarray:
    """xxhash64 of 64-bit integers with seed 42, as Spark computes it."""
    p1, p2, p3, p4, p5 = (U(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: v << U(n) | v >> U(64 - n)
    with np.errstate(over="ignore"):
        h = turn((U(42) + p5 + U(8)) ^ turn(x.astype(np.int64).view(U) * p2, 31) * p1, 27) * p1 + p4
    h = (h ^ (h >> U(33))) * p2
    h = (h ^ (h >> U(29))) * p3
    return (h ^ (h >> U(32))).view(np.int64)


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    """pmod(xxhash64(x), parts)."""
    return np.mod(spark_hash(x), parts).astype(np.int32)
