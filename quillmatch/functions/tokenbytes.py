"""The tokens of ``operators.tokens`` (no language, each byte outside ASCII a token) over the UTF-8 bytes of Arrow string columns.

Quoted strings and comments are found by one expression, as each begins where the one before it ended; all else follows
from where runs of byte classes begin and end, by whole arrays. No Python string is made per token: a token is the
64-bit hash of what it counts as, from prefix sums of byte * P**position modulo 2**64, and its place in the text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

P = np.uint64(0x9E3779B97F4A7C15)
P_INV = np.uint64(pow(int(P), -1, 1 << 64))
CHUNK_BYTES = 1 << 20
NUMBER = np.uint64(0x6E756D3A6E756D3A)  # tells a number from the name _1, which counts as 1
BLOCK = 1 << 18

_SPACE, _LETTER, _DIGIT, _DOT, _SIGN = range(5)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[list(b"\t\n\x0b\x0c\r ")] = _SPACE
_CLASS[list(b"_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER
_CLASS[list(b"0123456789")] = _DIGIT
_CLASS[ord(".")] = _DOT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SKIPPED = np.zeros(256, bool)
_SKIPPED[list(b";@#")] = True
_PAIRS = np.zeros((256, 256), np.uint8)
for _a, _b in "::|?.|->|=>|==|!=|<=|>=|&&|+=|-=|*=|/=|%=".split("|"):
    _PAIRS[ord(_a), ord(_b)] = 1
_PAIRS[ord("|"), ord("|")] = 1
_APART = re.compile(rb"""//[^\n]*+|/\*(?s:.*?)(?:\*/|\Z)|"[^"\\]*+(?:\\.[^"\\]*+)*+"?|'[^'\\]*+(?:\\.[^'\\]*+)*+'?""")
_CANONICAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i below n at least."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (P, P_INV):
            a = np.full(max(n, BLOCK + 1), base, np.uint64)
            a[0] = 1
            made.append(np.cumprod(a))
        _powers = made[0], made[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], which follow each other; done in blocks that end between them."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + BLOCK, side="right")))
        top = int(end[j - 1])
        pw, inv = _tables(top - base + 1)
        sums = np.empty(top - base + 1, np.uint64)
        sums[0] = 0
        v = data[base:top].astype(np.uint64)
        v += np.uint64(1)
        v *= pw[: top - base]
        np.cumsum(v, out=sums[1:])
        a = start[i:j] - base
        out[i:j] = (sums[end[i:j] - base] - sums[a]) * inv[a]
        i = j
    return mix(out)


def _hashes_of(terms: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
    return hashes(np.frombuffer(b"".join(terms), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copies, and n + 1 offsets into them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def _inside(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the spans, which follow each other."""
    step = np.zeros(n + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    return np.cumsum(step[:n], dtype=np.int8).astype(bool)


@dataclass
class Tokens:
    """Tokens of some texts, in order: hash of each, where it stands, and of each text its tokens [ptr[i], ptr[i+1])."""

    data: bytes
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    def text(self) -> np.ndarray:
        """The text that each token is of."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def term(self, k: int, aliases: dict[bytes, bytes]) -> str:
        """What token k counts as, as text."""
        return _term(self.data[self.start[k] : self.end[k]], aliases).decode("ISO-8859-1")


def _term(t: bytes, aliases: dict[bytes, bytes]) -> bytes:
    c = _CLASS[t[0]]
    if c == _LETTER:
        bare = t.translate(_CANONICAL, b"_")
        return aliases.get(bare, bare)
    if c == _DIGIT:
        return b"num:" + t
    return b"str" if t[:1] in (b'"', b"'") else {b"::": b".", b"?.": b".", b"->": b"arrow", b"=>": b"arrow"}.get(t, t)


def tokens(buf: np.ndarray, off: np.ndarray, aliases: dict[bytes, bytes]) -> Tokens:
    """The tokens of the texts buf[off[i]:off[i+1]] that count."""
    n, data = len(buf), buf.tobytes()
    if not n:
        z = np.zeros(0, np.int64)
        return Tokens(data, np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64))
    kind = _CLASS[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    spans = [m.span() for a, b in zip(off[:-1].tolist(), off[1:].tolist()) for m in _APART.finditer(data, a, b)]
    apart = np.array(spans, np.int64).reshape(-1, 2)
    if len(apart):
        kind[_inside(n, apart[:, 0], apart[:, 1])] = _SPACE
    quoted = apart[buf[apart[:, 0]] != ord("/")]

    def runs(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last = of.copy(), of.copy()
        first[1:] &= ~of[:-1] | edge[1:n]
        last[:-1] &= ~of[1:] | edge[1:n]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    word = (kind == _LETTER) | (kind == _DIGIT)
    ws, we = runs(word)
    # a number goes on over dots and names: from the first digit that begins a word to where its run of words and dots ends
    rs, re_ = runs(word | (kind == _DOT))
    digit = np.flatnonzero(kind[ws] == _DIGIT)
    run = np.searchsorted(rs, ws[digit], side="right") - 1
    lead = np.ones(len(run), bool)
    lead[1:] = run[1:] != run[:-1]
    ns, ne = ws[digit[lead]], re_[run[lead]]
    number = _inside(n, ns, ne) if len(ns) else np.zeros(n, bool)
    named = ~number[ws]
    ws, we = ws[named], we[named]

    sp = np.flatnonzero((kind >= _DOT) & ~number)
    after = np.minimum(sp + 1, n - 1)
    pair = (_PAIRS[buf[sp], buf[after]] == 1) & (kind[after] >= _DOT) & ~edge[sp + 1]
    at = np.arange(len(sp))
    begun = np.maximum.accumulate(np.where(pair, -1, at)) if len(sp) else at  # the last place before that begins no pair
    pair &= (at - begun) % 2 == 1
    taken = np.zeros(len(sp), bool)
    taken[1:] = pair[:-1]
    keep = ~taken & (pair | ~_SKIPPED[buf[sp]])
    ss, se = sp[keep], sp[keep] + 1 + pair[keep]

    low = _LOWER[buf]
    low[number] = buf[number]
    h = np.zeros(n, np.uint64)
    ends = np.zeros(n, np.int64)
    wh = hashes(low, ws, we)
    under = np.flatnonzero(buf == ord("_"))
    of = np.searchsorted(ws, under, side="right") - 1
    odd = np.unique(of[(of >= 0) & (under < np.append(we, 0)[of])])
    if aliases:
        odd = np.union1d(odd, np.flatnonzero(np.isin(wh, _hashes_of(list(aliases)))))
    gone = []
    if len(odd):  # names with underscores and names that stand for others, one by one
        terms = [_term(data[a:b], aliases) for a, b in zip(ws[odd].tolist(), we[odd].tolist())]
        there = [k for k, t in enumerate(terms) if t]
        gone = ws[odd[[k for k, t in enumerate(terms) if not t]]]
        if there:
            wh[odd[there]] = _hashes_of([terms[k] for k in there])
    sh = hashes(buf, ss, se)
    merged = {b"::": b".", b"?.": b".", b"->": b"arrow", b"=>": b"arrow"}
    for given, term in zip(_hashes_of(list(merged)), _hashes_of(list(merged.values()))):
        sh[sh == given] = term
    begins = np.zeros(n, bool)
    for s, e, x in ((ws, we, wh), (ns, ne, hashes(buf, ns, ne) ^ NUMBER), (ss, se, sh), (quoted[:, 0], quoted[:, 1], _hashes_of([b"str"])[0])):
        begins[s], h[s], ends[s] = True, x, e
    begins[gone] = False
    start = np.flatnonzero(begins)
    return Tokens(data, h[start], start, ends[start], np.searchsorted(start, off).astype(np.int64))


def each_chunk(column: pa.Array, aliases: dict[bytes, bytes], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Tokens]]:
    """(first row, row after the last, Tokens) over a column, about ``size`` bytes at a time, one row at least."""
    buf, off = text_bytes(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1))
        yield i, j, tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i], aliases)
        i = j


def kgrams(t: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the hash of every run of k tokens of a text, in order; of a text of fewer tokens, none."""
    total = len(t.hash) - k + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(total, np.uint64)
    for i in range(k):
        h += t.hash[i : i + total] * np.uint64(2 * (0x51ED270B * (i + 1)) + 1)
    text = t.text()
    whole = text[:total] == text[k - 1 :]
    return text[:total][whole], mix(h[whole])
