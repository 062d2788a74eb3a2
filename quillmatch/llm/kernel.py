"""Vectorised word kernel over the UTF-8 bytes of Arrow string columns.

A *word* is a maximal run of ASCII letters, digits and bytes of non-ASCII letters. Letters of ASCII and
Latin-1 are folded to lower case; the blocks U+0080-U+00BF and U+2000-U+2FFF (Latin-1 signs, general
punctuation, symbols) separate words. Other scripts keep their case. A null text counts as an empty one.
No Python string is made per word: word hashes come from prefix sums of byte * P**position modulo 2**64,
taken back to position 0 with the inverse of P and then mixed, so any word or prefix costs two lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

P = np.uint64(0x9E3779B97F4A7C15 | 1)
P_INV = np.uint64(pow(int(P), -1, 1 << 64))
CHUNK_BYTES = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("A") : ord("Z") + 1] = True
_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_pow = _inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i below n at least; the tables grow to the longest block seen."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 18)
        a, b = np.full(size, P, np.uint64), np.full(size, P_INV, np.uint64)
        a[0] = b[0] = 1
        _pow, _inv = np.cumprod(a), np.cumprod(b)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective): spreads the weak low bits of a polynomial hash."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copies, and n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    off = off.astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows and about ``size`` bytes; one row at least, however long it is."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, i + rows, max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1))
        yield i, j
        i = j


@dataclass
class Words:
    """Words of some texts: folded bytes, [start, end) of each, and of each text its words [ptr[i], ptr[i+1])."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    full: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def prefix(self, n: int) -> np.ndarray:
        """Hashes of the words' first n bytes, or of the words themselves where they are shorter."""
        return _hashes(self.low, self.start, np.minimum(self.end, self.start + n))


def fold(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, and which bytes belong to words."""
    low, isw = _LOWER[buf], _WORD[buf]
    if len(buf) and int(buf.max()) >= 0x80:
        lead = np.flatnonzero(buf == 0xC3)
        lead = lead[lead + 1 < len(buf)]
        nxt = buf[lead + 1]
        up = lead[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)] + 1
        low[up] += 0x20
        for first, width in ((0xC2, 2), (0xE2, 3)):
            at = np.flatnonzero(buf == first)
            for k in range(width):
                isw[at[at + k < len(buf)] + k] = False
    return low, isw


def _hashes(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of low[s:e]; done in blocks that end between words, so tables stay small."""
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        base = int(s[i])
        j = max(i + 1, int(np.searchsorted(e, base + (1 << 18), side="right")))
        top = int(e[j - 1])
        pw, inv = _powers(top - base + 1)
        sums = np.empty(top - base + 1, np.uint64)
        sums[0] = 0
        v = low[base:top].astype(np.uint64)
        v += np.uint64(1)
        v *= pw[: top - base]
        np.cumsum(v, out=sums[1:])
        a = s[i:j] - base
        out[i:j] = (sums[e[i:j] - base] - sums[a]) * inv[a]
        i = j
    return mix(out)


def words(buf: np.ndarray, off: np.ndarray) -> Words:
    """The words of the texts buf[off[i]:off[i+1]]."""
    low, isw = fold(buf)
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(low, z, z, np.zeros(len(off), np.int64), np.zeros(0, np.uint64))
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = isw.copy()
    first[1:] &= ~isw[:-1] | edge[1:n]
    last = isw.copy()
    last[:-1] &= ~isw[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(low, s, e, np.searchsorted(s, off).astype(np.int64), _hashes(low, s, e))


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n successive words of a text (of all its words, if it has fewer), and each text's range."""
    counts = np.diff(w.ptr)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    ptr = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    total = len(w.full)
    h = np.zeros(total, np.uint64)
    for k in range(n):
        part = w.full[k:] * np.uint64(2 * (0x51ED270B * (k + 1)) + 1)
        h[: total - k] += part
    h = mix(h)
    keep = np.repeat(w.ptr[:-1], sizes) + (np.arange(ptr[-1]) - np.repeat(ptr[:-1], sizes))
    out = h[keep]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        v = np.uint64(counts[d])
        with np.errstate(over="ignore"):
            for x in w.full[w.ptr[d] : w.ptr[d + 1]]:
                v = v * np.uint64(0x9E3779B97F4A7C15) + x
        out[ptr[d]] = v
    return out, ptr


def each_chunk(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, Words) over a column, about ``size`` bytes at a time."""
    buf, off = text_bytes(column)
    for i, j in chunks(off, size):
        yield i, j, words(buf[off[i] : off[j]], off[i : j + 1] - off[i])


def gather(ptr: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positions ptr[r]..ptr[r+1] of each r in rows, one after the other."""
    n = ptr[rows + 1] - ptr[rows]
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(ptr[rows] - (ends - n), n)


class HashIndex:
    """64-bit hashes to row numbers: open addressing in two arrays, looked up and filled by whole arrays."""

    def __init__(self, size: int = 1 << 16):
        self.keys, self.rows, self.n = np.zeros(size, np.uint64), np.zeros(size, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 where there is none."""
        h = np.where(h == 0, np.uint64(1), h)
        mask = np.uint64(len(self.keys) - 1)
        at = (h & mask).astype(np.int64)
        k = self.keys[at]
        out = np.where(k == h, self.rows[at], np.int32(-1))
        left = np.flatnonzero((k != h) & (k != 0))
        at, h = at[left], h[left]
        while len(left):
            at = (at + 1) & int(mask)
            k = self.keys[at]
            hit = k == h
            out[left[hit]] = self.rows[at[hit]]
            go = ~hit & (k != 0)
            left, at, h = left[go], at[go], h[go]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Rows for distinct hashes that are not there yet: the next numbers, in order."""
        if (self.n + len(h)) * 2 > len(self.keys):
            old = self.keys[self.keys != 0], self.rows[self.keys != 0]
            size = len(self.keys)
            while (self.n + len(h)) * 2 > size:
                size *= 4
            self.keys, self.rows = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._put(*old)
        rows = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self._put(np.where(h == 0, np.uint64(1), h), rows)
        self.n += len(h)
        return rows

    def _put(self, h: np.ndarray, rows: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            won = free & (self.keys[at] == h)
            self.rows[at[won]] = rows[won]
            h, rows, at = h[~won], rows[~won], (at[~won] + 1) & mask
