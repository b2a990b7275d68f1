"""Whole-text scanning inside Arrow batches.

Texts reach Python tasks as one UTF-8 buffer with offsets.  Words, lines and
their 64-bit hashes are computed over slices of that buffer with array
operations, so no text is cut, sampled or copied per word.  A slice holds about
``SLICE`` bytes, or one text where that text is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

BLANKS = bytes([0x20, *range(0x09, 0x0E)])


def byte_class(predicate) -> np.ndarray:
    return np.array([bool(predicate(b)) for b in range(256)])


#: Words are runs of anything but ASCII white space.
NON_BLANK = byte_class(lambda b: b not in BLANKS)
#: Words are runs of ASCII letters, digits and non-ASCII characters.
ALPHANUMERIC = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())
#: Words are runs of ASCII letters and non-ASCII characters.
LETTERS = byte_class(lambda b: b >= 0x80 or chr(b).isalpha())

_IDENTITY = np.arange(256, dtype=np.uint8)
_FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_TABLES = {False: _CODES[_IDENTITY], True: _CODES[_FOLDED]}


def _power(base: int, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * SLICE:
            _powers[name] = have
    return have[:n]


@dataclass
class Slice:
    """Rows ``first`` to ``last`` of a batch: their bytes, and where each text begins (one more entry than texts)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def prefix(self, folded: bool) -> np.ndarray:
        """Running polynomial hash; ``folded`` ignores the case of A-Z."""
        n = len(self.data)
        out = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLES[folded][self.data] * _power(_BASE, "up", n), out=out[1:])
        return out

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of marked bytes within each text: starts, ends, and for each text its first run (one more entry)."""
        n = len(self.data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.offsets), np.int64)
        fresh = np.ones(n + 1, dtype=bool)
        fresh[1:n] = ~inside[:-1]
        fresh[self.offsets] = True
        starts = np.flatnonzero(inside & fresh[:-1])
        last = np.ones(n, dtype=bool)
        last[:-1] = ~inside[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets <= n)] - 1
        last[edges] = True
        ends = np.flatnonzero(inside & last) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        down = _power(_INVERSE, "down", len(self.data) + 1)
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def totals(self, marked: np.ndarray) -> np.ndarray:
        """Marked bytes of each text."""
        run = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(marked, out=run[1:])
        return run[self.offsets[1:]] - run[self.offsets[:-1]]

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(column: pa.Array, size: int = SLICE) -> Iterator[Slice]:
    """Cut a string column into slices; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def owners(bounds: np.ndarray) -> np.ndarray:
    """Text number of each run, from the first run of each text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words that stay inside one text, and the word each begins at.

    The result is in text order; windows across texts are left out.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        value = mix(value + words[k : k + n] * np.uint64(2 * k + 3))
    left = np.repeat(bounds[1:], np.diff(bounds))[:n] - np.arange(n)
    at = np.flatnonzero(left >= width)
    return value[at], at


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of marked words that stay inside one text."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[bounds[bounds < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[bounds[(bounds > 0) & (bounds <= n)] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *added.values()], [*batch.schema.names, *added])


def windows_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` values, whatever the width, from one running hash."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mix(values) * _power(_BASE, "up", len(values)), out=run[1:])
    return mix((run[width:] - run[:-width]) * _power(_INVERSE, "down", len(values) + 1)[:n])
