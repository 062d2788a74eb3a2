"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A byte-level pre-tokeniser cuts a text into pieces that are encoded independently, and most pieces of a
corpus repeat. So the pieces of a batch are found by vectorised byte classes, each distinct piece goes through
the library once per worker, and ids are gathered. Texts with characters outside ASCII and the Latin-1 letters
go to the library whole, and so do all texts if a tokeniser file cuts otherwise than by this pattern, normalises or adds
spaces (``Codec.cuts``). Every encoded text is decoded again and compared with its bytes; a text that would
differ is encoded by the library directly, so the result equals the library's in all cases.

A null text gives null ids, offsets and round_trip; an empty one empty lists. Repeated rows give equal rows.
"""

from __future__ import annotations

import base64
import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import Kept, list_array, map_arrow

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Distinct pieces that a worker remembers before it starts afresh: bounds memory only, never results.
CACHE_PIECES = 500_000
SCHEMA = "doc_id long, n_tokens int, ids array<int>, starts array<int>, round_trip boolean"

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_O, _L, _N, _S = 0, 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
for _c in range(0x80):
    _CLASS[_c] = _L if chr(_c).isalpha() else _N if chr(_c).isdigit() else _S if chr(_c) in " \t\n\v\f\r" else _O
_CLASS[0x80:] = _L
_ODD = np.zeros(256, bool)
_ODD[0x1C:0x20] = _ODD[0xC2] = True
_ODD[0xC4:] = True


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, with the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def ranked(path: str) -> tuple[object, list[bytes]]:
    """An encoder from a file of ranks (base64 bytes and id a line), with the same pattern and ids, and its pieces."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), pieces


def cuts_by_pattern(spec: dict) -> bool:
    """Whether a tokeniser file cuts texts into pieces by ``PATTERN`` alone, so that pieces can be encoded one by one."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return bool(plain and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout") and not spec.get("truncation") and not spec.get("padding"))


class Codec:
    """A tokeniser file with its byte table. One lives in each Python worker, until it does other work."""

    _here = Kept()

    @classmethod
    def of(cls, path: str) -> Codec:
        return cls._here.made(path, lambda: cls(path))

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".tiktoken"):
            self.lib, pieces = ranked(path)
            self.cuts = True
        else:
            self.lib, pieces = self.library(path)
            with open(path, encoding="utf-8") as f:
                self.cuts = cuts_by_pattern(json.load(f))
        self.table = np.frombuffer(b"".join(pieces), np.uint8)
        self.ptr = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.width = np.diff(self.ptr).astype(np.int32)
        self.clear()

    @staticmethod
    def library(path: str) -> tuple[object, list[bytes]]:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        lib.encode_special_tokens = True
        back = byte_chars()
        vocab = lib.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            pieces[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
        return lib, pieces

    def clear(self) -> None:
        self.index = K.HashIndex(1 << 20)
        self.flat, self.flat_ptr = array("i"), array("q", [0])

    def encode_texts(self, texts: list[str]) -> list[list[int]]:
        if hasattr(self.lib, "encode_ordinary"):
            return [self.lib.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        """Encodes the pieces buf[s:e] and keeps their ids. Pieces that aren't white space go through the library
        as one text, a line each: a line end is a piece of its own, so none is encoded otherwise for it."""
        raw, lone = buf.tobytes(), _CLASS[buf[e - 1]] == _S
        pieces = [raw[x:y] for x, y in zip(s.tolist(), e.tolist())]
        found: list = [None] * len(pieces)
        for k in np.flatnonzero(lone):
            found[k] = self.encode_texts([pieces[k].decode()])[0]
        rest = np.flatnonzero(~lone)
        for part in np.array_split(rest, max(1, len(rest) // 4096)):
            if not len(part):
                continue
            ids = np.array(self.encode_texts(["\n".join(pieces[k].decode() for k in part)])[0], np.int32)
            at = np.cumsum(self.width[ids], dtype=np.int64) - self.width[ids]
            size = np.array([len(pieces[k]) for k in part], np.int64)
            begin = np.cumsum(size + 1) - size - 1
            lo, hi = np.searchsorted(at, begin).tolist(), np.searchsorted(at, begin + size).tolist()
            for k, x, y in zip(part.tolist(), lo, hi):
                found[k] = ids[x:y].tolist()
        for ids in found:
            self.flat.extend(ids)
            self.flat_ptr.append(len(self.flat))

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.table[K.gather(self.ptr, ids)]

    def encode(self, buf: np.ndarray, off: np.ndarray, check: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts buf[off[i]:off[i+1]], and each text's range of them."""
        odd = np.full(len(off) - 1, not self.cuts)
        at = np.flatnonzero(_ODD[buf])
        odd[np.searchsorted(off, at, side="right") - 1] = True
        s = piece_starts(buf, off) if self.cuts else np.zeros(0, np.int64)
        e = np.append(s[1:], len(buf))
        h = K._hashes(buf, s, e) if len(s) else np.zeros(0, np.uint64)
        owner = np.searchsorted(off, s, side="right") - 1
        plain = ~odd[owner] if len(s) else np.zeros(0, bool)
        s, e, h, owner = s[plain], e[plain], h[plain], owner[plain]
        mine = self.index.find(h)
        new = np.flatnonzero(mine < 0)
        if len(new):
            codes, distinct = pd.factorize(h[new])
            if self.index.n + len(distinct) > CACHE_PIECES and self.index.n:
                self.clear()
                return self.encode(buf, off, check)
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = new[::-1]
            self.learn(buf, s[first], e[first])
            mine[new] = self.index.add(distinct)[codes]
        flat, fp = np.frombuffer(self.flat, np.int32), np.frombuffer(self.flat_ptr, np.int64)
        ids = flat[K.gather(fp, mine)]
        per_piece = np.concatenate([[0], np.cumsum(fp[mine + 1] - fp[mine])])
        ptr = per_piece[np.searchsorted(owner, np.arange(len(off)))].astype(np.int64)
        del flat, fp
        wrong = odd | ~self.same(ids, ptr, buf, off) if check else odd
        if wrong.any():
            rows = np.flatnonzero(wrong)
            own = self.encode_texts([buf[off[r] : off[r + 1]].tobytes().decode() for r in rows])
            parts = [ids[ptr[r] : ptr[r + 1]] for r in range(len(off) - 1)]
            for r, x in zip(rows, own):
                parts[r] = np.asarray(x, np.int32)
            ids, ptr = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids.astype(np.int32), ptr

    def same(self, ids: np.ndarray, ptr: np.ndarray, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Which texts the ids decode to, byte by byte."""
        ends = np.concatenate([[0], np.cumsum(self.width[ids], dtype=np.int64)])[ptr]
        fits = np.diff(ends) == np.diff(off)
        if fits.all():
            bad = np.flatnonzero(self.bytes_of(ids) != buf)
            fits[np.searchsorted(off, bad, side="right") - 1] = False
            return fits
        for r in np.flatnonzero(fits):
            fits[r] = np.array_equal(self.bytes_of(ids[ptr[r] : ptr[r + 1]]), buf[off[r] : off[r + 1]])
        return fits

    def starts(self, ids: np.ndarray, ptr: np.ndarray, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The character of its text in which each token's first byte lies; two tokens that share a split
        character carry the same offset. (Of a tokeniser that changes texts, offsets hold where round_trip does.)"""
        at = np.cumsum(self.width[ids], dtype=np.int64) - self.width[ids]
        char = np.cumsum((buf & 0xC0) != 0x80) - 1
        base = np.append(char, len(buf))[off[:-1]]
        return (np.append(char, 0)[np.minimum(at, len(char))] - np.repeat(base, np.diff(ptr))).astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of any id sequence; bytes that form no whole character become U+FFFD."""
        return self.bytes_of(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


def piece_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts begin, by the byte-level pattern: contractions, an optional space with
    letters, digits or signs, white space but its last character before other text, other white space."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    cls = _CLASS[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    times = lead[(buf[lead + 1] == 0x97) | (buf[lead + 1] == 0xB7)]
    cls[times] = cls[times + 1] = _O
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    run = edge[:n].copy()
    run[1:] |= cls[1:] != cls[:-1]
    t = np.zeros(n + 1, bool)
    at = np.flatnonzero(run)
    end = np.append(at[1:], n)
    space = cls[at] == _S
    solid = at[~space]
    joined = np.zeros(len(solid), bool)
    inner = (solid > 0) & ~edge[solid]
    joined[inner] = buf[solid[inner] - 1] == 0x20
    t[solid - joined] = True
    a, b = at[space], end[space]
    t[a] = True
    t[b[~edge[b]] - 1] = True
    quote = solid[~joined & (buf[solid] == 0x27)]
    if len(quote):
        pad = np.concatenate([buf, np.zeros(3, np.uint8)])
        left = off[np.searchsorted(off, quote, side="right")] - quote
        x, y = pad[quote + 1], pad[quote + 2]
        one = (left > 1) & np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = (left > 2) & ((((x == ord("r")) | (x == ord("v"))) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l"))))
        for which, k in ((one, 2), (two, 3)):
            q = quote[which]
            t[q + 1] = False
            if k == 3:
                t[q + 2] = False
            t[q + k] = True
    return np.flatnonzero(t[:n])


def encode_batch(batch: pa.RecordBatch, path: str, size: int = 2 * K.CHUNK_BYTES, check: bool = True) -> Iterator[tuple[int, int, Codec, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, codec, ids, ranges, bytes, offsets) over a batch's text column."""
    codec = Codec.of(path)
    buf, off = K.text_bytes(batch.column("text"))
    for i, j in K.chunks(off, size):
        b, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        ids, ptr = codec.encode(b, o, check)
        yield i, j, codec, ids, ptr, b, o


def encode(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids, starts (character offsets) and round_trip (decoding gives the text) of each row."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        there = batch.column("text").is_valid().to_numpy(zero_copy_only=False)
        for i, j, codec, ids, ptr, b, o in encode_batch(batch, tokenizer, K.CHUNK_BYTES):
            ok = there[i:j]
            yield {
                "doc_id": batch.column("doc_id").slice(i, j - i),
                "n_tokens": pa.array(np.diff(ptr), mask=~ok),
                "ids": list_array(ids, ptr, pa.int32(), ok),
                "starts": list_array(codec.starts(ids, ptr, b, o), ptr, pa.int32(), ok),
                "round_trip": pa.array(codec.same(ids, ptr, b, o), mask=~ok),
            }

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def decode(tokens: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """doc_id and text of rows of ids. Ids that are null or not in the vocabulary are left out; a null list gives
    a null text."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        codec, column = Codec.of(tokenizer), batch.column("ids")
        there = column.is_valid().to_numpy(zero_copy_only=False)
        size = np.where(there, pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False), 0)
        flat = column.flatten()
        ids = flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(column)), size)
        good = (ids >= 0) & (ids < len(codec.width))
        ids, owner = ids[good], owner[good]
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, codec.width[ids], minlength=len(column)))]).astype(np.int64)
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends), pa.py_buffer(codec.bytes_of(ids))])
        try:
            text = raw.cast(pa.large_string())
        except pa.ArrowInvalid:  # some row isn't UTF-8
            text = pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.large_string())
        yield {"doc_id": batch.column("doc_id"), "text": pc.if_else(pa.array(there), text, pa.scalar(None, pa.large_string()))}

    return map_arrow(tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")), run, "doc_id long, text string")
