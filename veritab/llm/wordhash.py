"""Vectorised splitting and hashing of words over whole Arrow batches of texts.

One numpy pass over the UTF-8 bytes of a batch gives every word a 64-bit hash, so the operators on
word sequences spend no Python step per word.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV_BASE = pow(_BASE, -1, 1 << 64)
_SEED = 20240613


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the result."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _byte_codes(lower: bool) -> np.ndarray:
    codes = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def _is_space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def _not_alnum() -> np.ndarray:
    """ASCII but for digits and letters; every byte of a longer code point belongs to a word."""
    out = np.zeros(256, bool)
    out[:128] = True
    out[48:58] = out[65:91] = out[97:123] = False
    return out


_CHUNK = 1 << 18
_TABLES: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n of each, kept up to the size of a chunk."""
    if _TABLES and n <= len(_TABLES[0]):
        return _TABLES
    made = []
    for x in (_BASE, _INV_BASE):
        p = np.full(max(n, _CHUNK), x, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= _CHUNK:
        _TABLES[:] = made
    return made


SPACES, NOT_ALNUM = _is_space(), _not_alnum()


@dataclass
class Words:
    """Words of a batch in order. starts/ends: byte places in data; doc: number of the text in the batch."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of each text, the number of its first word; one more entry at the end

    def hashes(self, lower: bool = False) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        h = np.empty(len(self.starts), np.uint64)
        codes, a = _byte_codes(lower), 0
        while a < len(h):
            # as many words as fit in a chunk, or one longer word
            at = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.ends, at + _CHUNK, "right")))
            powers, inverse = _powers(int(self.ends[b - 1] - at))
            total = np.zeros(self.ends[b - 1] - at + 1, np.uint64)
            np.cumsum(codes[self.data[at : self.ends[b - 1]]] * powers[: len(total) - 1], out=total[1:])
            h[a:b] = (total[self.ends[a:b] - at] - total[self.starts[a:b] - at]) * inverse[self.starts[a:b] - at]
            a = b
        return mix(h + (self.ends - self.starts).astype(np.uint64) * _U64(0xD6E8FEB86659FD93))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array, separators: np.ndarray = SPACES) -> Words:
    """Maximal runs of bytes that aren't separators, none of them across two texts."""
    data, offsets = utf8(column)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separators[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(starts):
        # a text may begin inside a run: cut there
        cuts = np.unique(offsets[1:-1])
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, starts, ends, doc, first)


def shingles(w: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words, and its text; a shorter text that has words gives one hash of all of them."""
    n = len(h)
    per = np.diff(w.first)
    out_h, out_d = [], []
    if n >= size:
        s = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            s = s * _U64(0xC2B2AE3D27D4EB4F) + h[k : n - size + 1 + k]
        good = w.doc[: n - size + 1] == w.doc[size - 1 :]
        out_h.append(mix(s[good]))
        out_d.append(w.doc[: n - size + 1][good])
    for d in np.flatnonzero((per > 0) & (per < size)):
        x = _U64(per[d]) * _U64(0x165667B19E3779F9)
        with np.errstate(over="ignore"):
            for v in h[w.first[d] : w.first[d + 1]]:
                x = x * _U64(0xC2B2AE3D27D4EB4F) + v
        out_h.append(mix(np.array([x], np.uint64)))
        out_d.append(np.array([d]))
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_d).astype(np.int64)


def bounded(batches, column: str = "text", most: int = 4 << 20):
    """Slices of Arrow batches with at most `most` bytes of text, but at least one row.

    At the end of a task its worker gives free memory back, as it stays for other tasks.
    """
    for b in batches:
        if not b.num_rows:
            continue
        _, offsets = utf8(b.column(b.schema.get_field_index(column)))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield b.slice(i, j - i)
            i = j
        del b
    give_back()


def give_back() -> None:
    """Free memory of a Python worker goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
