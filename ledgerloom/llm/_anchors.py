"""Content-defined anchors: places that every window of a fixed length picks out of its own content."""

from __future__ import annotations

import numpy as np

from ledgerloom.llm._text import U


def least_in(values: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n consecutive values, by doubling; shorter by n - 1."""
    if len(values) < n:
        return values[:0]
    size = 1
    out = values
    while size * 2 <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = n - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


#: Windows that are looked at together: places in them fit the 24 low bits.
AT_ONCE = 1 << 23


def anchors(h: np.ndarray, within: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows of `within` consecutive hashes: (anchor, first window, last window) of each run of windows with one anchor.

    A window's anchor is its leftmost hash of the least 40 high bits, so equal windows have it at the same place.
    valid: which windows count; a run never holds one that doesn't. A run may also end every AT_ONCE windows.
    """
    parts = [_anchors(h[k : k + AT_ONCE + within - 1], within, valid[k : k + AT_ONCE]) for k in range(0, max(1, len(valid)), AT_ONCE)]
    return tuple(np.concatenate([part[i] + k * AT_ONCE for k, part in enumerate(parts)]) for i in range(3))


def _anchors(h: np.ndarray, within: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = (h >> U(24) << U(24)) | np.arange(len(h), dtype=U) & U(0xFFFFFF)
    least = least_in(order, within)
    starts = np.flatnonzero(valid)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    at = (least[starts] & U(0xFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    low = np.flatnonzero(new)
    return at[low], starts[low], starts[np.append(low[1:], len(starts)) - 1]
