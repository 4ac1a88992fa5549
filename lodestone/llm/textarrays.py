"""Words and word n-grams of many texts at once, as numpy arrays.

A word is a longest run of characters other than space and \\t \\n \\v \\f \\r. Hashes are 64-bit polynomials over
bytes (words) and over words (n-grams), so each is taken from one running sum. They depend on nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads close values apart."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """A 64-bit hash of each span of bytes, of spans in order and apart, from about `most` bytes at a time: a long text
    takes no more memory than its spans do."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(out):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + most, "right")))
        part = data[low : ends[to - 1]]
        a, b = starts[at:to] - low, ends[at:to] - low
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * powers(_P, len(part)), out=sums[1:])
        out[at:to] = mixed((sums[b] - sums[a]) * powers(_P_INVERSE, len(part) + 1)[a] + (b - a).astype(np.uint64))
        at = to
    return out


class Texts:
    """Some whole texts of a batch: data (bytes, end to end), bounds (where each begins, and the end), first (row)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first, self.n = data, bounds, first, len(bounds) - 1
        free = ~_SPACES[data]
        begins = free.copy()
        begins[1:] &= ~free[:-1]
        inner = bounds[:-1][bounds[:-1] < len(data)]
        begins[inner] = free[inner]
        ends = free.copy()
        ends[:-1] &= ~free[1:]
        last = inner[inner > 0] - 1
        ends[last] = free[last]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        #: the words of text i are words word_bounds[i] to word_bounds[i + 1]
        self.word_bounds = np.searchsorted(self.starts, bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.data, self.starts, self.ends)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.word_bounds))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words; one less than n shorter than words."""
    m = len(words)
    if m < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(m + 1, np.uint64)
    np.cumsum(words * powers(_P, m), out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * powers(_P_INVERSE, m)[: m - n + 1])


def sliding(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """The smallest (or largest) of each n consecutive values, by doubling."""
    f, have = (np.minimum if least else np.maximum), 1
    while have < n:
        step = min(have, n - have)
        x = f(x[:-step], x[step:])
        have += step
    return x


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_slices(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 20) -> Iterator[Texts]:
    """The texts of a batch (null: empty) in slices of about most bytes, or of one longer text."""
    column = string_column(batch, name)
    rows = len(column)
    if not rows:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64, rows + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield Texts(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], at)
        at = to


def in_slices(batch: pa.RecordBatch, name: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about most bytes together."""
    column = string_column(batch, name)
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
