"""Words of whole Arrow string columns as numpy arrays: ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole rows of about ``max_bytes`` (one row at least), with their first row: bounds numpy's memory."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + max_bytes, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


class Words:
    """The words of a slice: first and end byte of each, its row, and where each row's words begin."""

    def __init__(self, column: pa.Array, lower: bool = False):
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        whole = column.buffers()[2]
        raw = np.frombuffer(whole, np.uint8)[bounds[0] : bounds[-1]] if whole is not None else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        self.data = LOWER[raw] if lower else raw
        ink = ~IS_SPACE[self.data]
        edge = np.zeros(len(raw) + 1, bool)
        edge[bounds] = True
        before = np.concatenate([[False], ink])[: len(raw)]
        after = np.concatenate([ink[1:], [False]])[: len(raw)]
        self.first = np.flatnonzero(ink & (~before | edge[: len(raw)]))
        self.end = np.flatnonzero(ink & (~after | edge[1:])) + 1
        self.rows = np.searchsorted(self.first, bounds)
        self._ink = ink

    def __len__(self) -> int:
        return len(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        size = self.end - self.first
        start = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(start, size)
        terms = _BYTE[self.data[self._ink]] * _powers(int(size.max()))[place]
        return mix(np.add.reduceat(terms, start) + size.astype(np.uint64))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive hashes; the caller masks those that cross rows."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * _STEP + hashes[i : i + count]
    return mix(out)
