"""Words of Arrow string columns, found and hashed on the UTF-8 bytes.

Whole batches are handled at once: a table of 256 flags says which bytes
belong to words (bytes from 0x80 on are parts of non-ASCII characters, so a
class of ASCII characters and "all others" is a class of bytes), and a word's
64-bit hash comes from prefix sums of a polynomial. Only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes whose words are hashed at once; a longer word is hashed alone.
HASH_BYTES = 1 << 17

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (public domain)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: np.uint64) -> np.ndarray:
        t = np.full(n, base, dtype=np.uint64)
        t[0] = 1
        return np.cumprod(t, dtype=np.uint64)

    return table(_BASE), table(_INVERSE)


_short_tables = cache(_tables)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; spans are sorted and don't overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    low = 0
    while low < len(starts):
        base = starts[low]
        high = max(low + 1, int(np.searchsorted(ends, base + HASH_BYTES, side="right")))
        first, last = starts[low:high] - base, ends[low:high] - base
        n = int(last[-1])
        powers, inverses = _short_tables(HASH_BYTES + 1) if n <= HASH_BYTES else _tables(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((LOWER[data[base : base + n]].astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
        out[low:high] = mix((sums[last] - sums[first]) * inverses[first])
        low = high
    return out


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes, or one row each."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


class Words:
    """Words of some rows: hashes, byte spans, and where each row's words start."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        n = len(data)
        inside = is_word[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets[:-1]] = True
        first[n] = True
        before = np.empty(n, dtype=bool)
        before[1:] = inside[:-1]
        if n:
            before[0] = False
        after = np.empty(n, dtype=bool)
        after[:-1] = inside[1:]
        if n:
            after[-1] = False
        self.starts = np.flatnonzero(inside & (first[:n] | ~before))
        self.ends = np.flatnonzero(inside & (first[1:] | ~after)) + 1
        self.rows = np.searchsorted(self.starts, offsets)  # words of row i: rows[i] to rows[i + 1]
        self.hashes = _hashes(data, self.starts, self.ends)
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1


def words_of(column: pa.Array, is_word: np.ndarray) -> Iterator[tuple[int, Words]]:
    """(first row, :class:`Words`) for slices of a string column."""
    data, offsets = string_bytes(column)
    for low, high in slices(offsets):
        yield low, Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], is_word)


def chain(*columns: np.ndarray) -> np.ndarray:
    """One hash of several in order."""
    out = np.full(len(columns[0]), len(columns), dtype=np.uint64)
    for x in columns:
        out = mix(out * _BASE + x)
    return out


def shingles(words: Words, row: int, size: int) -> np.ndarray:
    """Sorted distinct hashes of the row's runs of ``size`` words; of all its words if it has fewer."""
    w = words.hashes[words.rows[row] : words.rows[row + 1]]
    if not len(w):
        return w
    k = min(size, len(w))
    return np.unique(chain(*(w[i : len(w) - k + 1 + i] for i in range(k))))
