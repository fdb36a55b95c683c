"""Words of whole texts as numpy arrays, read straight from Arrow string buffers.

Both word rules of this package split on single bytes below 0x80, so UTF-8 bytes can be classified
without decoding. A word is known by a 64-bit fingerprint of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_SPACES = (0x20, *range(0x09, 0x0E))
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MULT, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


class Tables(dict):
    """Tables that a process makes for itself: functions are shipped to workers without them."""

    def __reduce__(self):
        return Tables, ()


_powers = Tables()

#: Words between white space: [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[list(_SPACES)] = False
#: Lower-cased words of letters, digits and all beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
PLAIN = np.zeros(256, bool)
PLAIN[0x30:0x3A] = PLAIN[0x61:0x7B] = PLAIN[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a sum depend on all its terms."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        table = np.full(1 << max(n - 1, (1 << 20) - 1).bit_length(), base, np.uint64)
        table[0] = 1
        _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers[name][:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text and ``rows`` rows, or of one row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, base + limit, "right")))
        end = min(end, start + rows) if rows else end
        yield start, end
        start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words:
    """Byte bounds, fingerprints and row offsets of the words of a string column."""

    def __init__(self, column: pa.Array, inside: np.ndarray, lower: bool = False):
        data, rows = text_bytes(column)
        self.data = LOWER[data] if lower else data
        n = len(data)
        within = inside[self.data]
        first = np.zeros(n + 1, bool)
        first[rows[:-1]] = True
        begins, ends = np.zeros(n, bool), np.zeros(n + 1, bool)
        if n:
            begins[0], begins[1:] = within[0], within[1:] & (first[1:n] | ~within[:-1])
            ends[1:n], ends[n] = within[:-1] & (first[1:n] | ~within[1:]), within[-1]
        self.rows = rows
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends)
        #: Word number of each row's first word, and the number of words at the end.
        self.at = np.searchsorted(self.starts, rows)
        self.counts = np.diff(self.at)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        upto = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _power("up", _MULT, n), out=upto[1:])
        inverse = _power("down", pow(_MULT, -1, 1 << 64), n)
        sizes = (self.ends - self.starts).astype(np.uint64)
        return mix((upto[self.ends] - upto[self.starts]) * inverse[self.starts] + sizes)

    def row_of(self) -> np.ndarray:
        """Row number of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def window_starts(self, size: int) -> np.ndarray:
        """Word numbers at which a window of ``size`` words of one row starts."""
        if len(self) < size:
            return np.zeros(0, np.int64)
        left = np.repeat(self.at[1:], self.counts) - np.arange(len(self))
        return np.flatnonzero(left >= size)


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Fingerprint of the ``size`` words that start at each word, rows ignored; short at the end."""
    n = max(len(words) - size + 1, 0)
    out = np.full(n, seed * 2 + 1, np.uint64)
    for j in range(size):
        out = out * _STEP + words[j : n + j]
    return mix(out)


def sums_by_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of a per-word array in each row."""
    upto = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=upto[1:])
    return upto[at[1:]] - upto[at[:-1]]


def covered(starts: np.ndarray, size: int | np.ndarray, n: int) -> np.ndarray:
    """True for the words within any of the windows."""
    edge = np.bincount(starts, minlength=n + 1).astype(np.int64)
    edge -= np.bincount(starts + size, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (a sort; numpy's own hashes are slower here)."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted ``table``, or -1."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    place = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[place] == values, place, -1)
