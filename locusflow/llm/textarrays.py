"""Vectorised word arrays over Arrow string columns.

A batch of whole texts is looked at as one byte array.  Words are maximal runs
of bytes outside ``[\\x20\\x09-\\x0D]`` (all single-byte characters, so the rule
is the same on UTF-8 bytes as on code points).  Every word gets a 64-bit
polynomial hash whose byte values come from a fixed random table; the work is
done slice by slice so that the memory needed does not follow the length of a
text.  Equality of words and of word windows is decided by these hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _PINV)):
            steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Word ``i`` is ``data[start[i]:end[i]]``; text ``d`` has words ``first[d]`` to ``first[d + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    #: What has been measured of every text, by name.
    memo: dict[str, np.ndarray] = field(default_factory=dict)

    def measured(self, measure: Callable[[Words], np.ndarray]) -> np.ndarray:
        """One number for each text, worked out once."""
        if measure.__name__ not in self.memo:
            self.memo[measure.__name__] = measure(self)
        return self.memo[measure.__name__]

    def take(self, keep: np.ndarray) -> Words:
        """The texts that a mask keeps, without looking at their words again."""
        size, count = np.diff(self.offsets), np.diff(self.first)
        moved = np.repeat(np.cumsum(np.where(keep, 0, size)), count)
        of_kept = np.repeat(keep, count)
        ends = lambda n: np.concatenate([[0], np.cumsum(n[keep])])
        return Words(
            self.data[np.repeat(keep, size)], ends(size), (self.start - moved)[of_kept], (self.end - moved)[of_kept], self.hash[of_kept], ends(count), {k: v[keep] for k, v in self.memo.items()}
        )

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def of(self, d: int) -> slice:
        return slice(int(self.first[d]), int(self.first[d + 1]))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def _slices(data: np.ndarray, offsets: np.ndarray):
    """Bounds of slices that end at a text's end or in front of white space."""
    at, n = 0, len(data)
    while at < n:
        to = at + SLICE_BYTES
        if to >= n:
            yield at, n
            return
        step = 4096
        while True:
            found = np.flatnonzero(_SPACE[data[to : to + step]])
            text_end = offsets[np.searchsorted(offsets, to)]
            if len(found) and to + found[0] <= text_end:
                to += int(found[0])
                break
            if text_end <= to + step:
                to = int(text_end)
                break
            to += step
        yield at, to
        at = to


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """64-bit hashes of byte spans that follow each other without overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    out, at = [], 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + SLICE_BYTES, "right")))
        a, b = int(start[at]), int(end[to - 1])
        power, inverse = _power(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[data[a:b]] * power[: b - a], out=sums[1:])
        s, e = start[at:to] - a, end[at:to] - a
        out.append(mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        at = to
    return np.concatenate(out)


def words_of(column: pa.Array, lower: bool = False, space: np.ndarray = _SPACE) -> Words:
    """All words of a column of texts; ``space`` says which bytes separate words."""
    data, offsets = string_buffers(column)
    starts, ends = [], []
    for a, b in _slices(data, offsets):
        solid = ~space[data[a:b]]
        inner = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        before = np.empty_like(solid)
        before[0] = False
        before[1:] = solid[:-1]
        before[inner] = False
        after = np.empty_like(solid)
        after[-1] = False
        after[:-1] = solid[1:]
        after[inner[inner > 0] - 1] = False
        starts.append(np.flatnonzero(solid & ~before) + a)
        ends.append(np.flatnonzero(solid & ~after) + 1 + a)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return Words(data, offsets, start, end, span_hashes(data, start, end, _LOWER if lower else _TABLE), np.searchsorted(start, offsets))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of ``k`` neighbouring values (fewer than ``k``: none)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[j : j + n]
    return mix(out)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of one text; a text of fewer words is one shingle."""
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(windows(h, min(k, len(h))))


def code_points(data: np.ndarray) -> np.ndarray:
    """Where each code point begins (a mask over bytes)."""
    return (data & 0xC0) != 0x80
