"""Suffix arrays by Larsson-Sadakane refinement and common prefixes by Kasai's bound, in numpy."""

from __future__ import annotations

import numpy as np

#: Places that take Kasai's steps one after the other.
LANE = 256


def _sorted_places(group: np.ndarray, value: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of (group, value), equal ones in any order, and where a new pair begins; all values are in [0, places]."""
    bits = max(1, int(places).bit_length())
    own = max(1, int(len(group)).bit_length())
    if 2 * bits + own <= 64:
        key = (group.astype(np.uint64) << np.uint64(bits) | value.astype(np.uint64)) << np.uint64(own) | np.arange(len(group), dtype=np.uint64)
        key.sort()
        order = (key & np.uint64((1 << own) - 1)).astype(np.int64)
        pair = key >> np.uint64(own)
    else:
        order = np.lexsort((value, group))
        pair = group[order] * (places + 1) + value[order]
    new = np.ones(len(group), bool)
    new[1:] = pair[1:] != pair[:-1]
    return order, new


def _first_ranks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """All places ordered by their first bytes, where a new string begins, and how many bytes that were: what fits beside a place in 64 bits."""
    n = len(data)
    letter = np.zeros(256, np.uint64)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    letter[used] = np.arange(1, len(used) + 1)  # 0 is the end of the data
    bits, own = int(len(used)).bit_length(), int(n).bit_length()
    length = max(1, (64 - own) // bits)
    padded = np.concatenate([letter[data], np.zeros(length, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(length):
        key = key << np.uint64(bits) | padded[k : k + n]
    if own + length * bits <= 64:
        key = key << np.uint64(own) | np.arange(n, dtype=np.uint64)
        key.sort()
        order, key = (key & np.uint64((1 << own) - 1)).astype(np.int64), key >> np.uint64(own)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    return order, new, length


def suffix_array(data: np.ndarray, repeated: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and which of them may have their first `repeated` bytes in common with another.

    Ranks start from a few bytes. Each round doubles the sorted length, and only groups of more than one suffix are
    sorted again, by the rank of the suffix that much further on; those that are open at a length up to `repeated` may.
    """
    n = len(data)
    shared = np.ones(n, bool)
    if not n:
        return np.zeros(0, np.int64), shared
    order, new, length = _first_ranks(data)
    rank = np.zeros(n + 1, np.int64)  # the empty suffix is the least
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    # a group's number is the place of its last suffix and one, so numbers stay when other groups split
    rank[order] = np.repeat(start + size, size)
    open_at = np.flatnonzero(np.repeat(size > 1, size))
    while len(open_at):
        if length <= repeated:
            shared[:] = False
            shared[order[open_at]] = True
        members = order[open_at]
        again, new = _sorted_places(rank[members], rank[np.minimum(members + length, n)], n)
        members = members[again]
        order[open_at] = members
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(members)))
        rank[members] = np.repeat(open_at[start + size - 1] + 1, size)
        open_at = open_at[np.repeat(size > 1, size)]
        length *= 2
    if length <= repeated:
        shared[:] = False
    return order, shared


def _lanes(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lanes of LANE places at most."""
    n = -(-sizes // LANE)
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return starts[text] + k * LANE, np.minimum(sizes[text] - k * LANE, LANE)


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int, asked: np.ndarray | None = None) -> np.ndarray:
    """For each place in `order`, the common prefix with the suffix before it, at most `most`.

    Kasai's bound: from a suffix to the one a byte on, the prefix shrinks by one at most, so it is only extended from
    there. The texts (starts, sizes) are cut into lanes that take their steps together, one place a step. Lanes in which no
    place is asked for stay 0.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    # the eight bytes from each place on, the first one lowest, so that the lowest bit that differs counts the equal bytes
    eight = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8).view("<u8").reshape(-1).copy()
    out = np.zeros(n, np.int64)  # by place in the data
    starts, sizes = _lanes(starts, sizes)
    if asked is not None:
        upto = np.append(0, np.cumsum(asked))
        some = upto[starts + sizes] > upto[starts]
        starts, sizes = starts[some], sizes[some]
    longest_first = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[longest_first], sizes[longest_first]
    have = np.zeros(len(starts), np.int64)
    for step in range(int(sizes.max()) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -step, "left"))  # lanes longer than step
        at = starts[:live] + step
        other = before[at]
        h = have[:live]
        h -= 1
        np.maximum(h, 0, out=h)
        room = np.minimum(n - np.maximum(at, other), most)
        if other.min() < 0:  # the least suffix has none before it
            room[other < 0] = 0
        np.minimum(h, room, out=h)
        k = np.flatnonzero(h < room)
        a, b = at[k], other[k]
        while len(k):
            done = h[k]
            differ = eight[a + done] ^ eight[b + done]
            same = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3
            done += same
            h[k] = np.minimum(done, room[k])
            more = np.flatnonzero(same == 8)
            more = more[done[more] < room[k[more]]]
            k, a, b = k[more], a[more], b[more]
        out[at] = h
    return out[order]
