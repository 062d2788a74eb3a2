"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized, written as NPY tiles with difference hashes.

Decodes P1 to P7 (plain, raw and PAM of one to four channels; 8 and 16 bits, scaled to 8) and BMP of 1, 4, 8, 16, 24 and 32
bits with any of the headers, plain, by bit fields or run lengths, bottom-up or top-down. An image is a uint8 array of
height x width x channels (1 or 3; alpha is left out). Resizing averages the exact source area of each target pixel by an
integral image, of which only the columns that targets begin at are kept. A tile is the NPY file of the resized array; the
difference hash is 64 bits: of the 9 x 8 grey image, whether each pixel is brighter than its right neighbour (where they are
as bright, it isn't: the only tie there is).

Images are decoded ``STRIP`` pixels at a time, so a worker holds the file, the strip and a column of sums for each target,
whatever size the header claims; a file that is too short for its size is refused before. Small images of one size are
resized together.

A null, empty, truncated or foreign image gives null height, width, tile and hash, and the reason in ``error``. Rows
repeat as they come.
"""

from __future__ import annotations

import io
import re
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

STRIP, TILE = 1 << 21, 16
SCHEMA = "id long, format string, height int, width int, channels int, tile binary, dhash long, error string"


@dataclass
class Raster:
    """An image of which rows [a, b) can be had."""

    kind: str
    h: int
    w: int
    c: int
    rows: Callable[[int, int], np.ndarray]

    def strips(self) -> Iterator[np.ndarray]:
        step = max(1, STRIP // (self.w * self.c))
        for a in range(0, self.h, step):
            yield self.rows(a, min(self.h, a + step))

    def whole(self) -> np.ndarray:
        return self.rows(0, self.h)


_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*(\d{1,9})(?=[\s#]|$)")


def _check(ok: bool, reason: str = "truncated") -> None:
    if not ok:
        raise ValueError(reason)


def _scaled(top: int) -> np.ndarray:
    """For each value, what it is of 255."""
    v = np.arange(65536 if top > 255 else 256, dtype=np.int64)
    return ((np.minimum(v, top) * 255 + top // 2) // top).astype(np.uint8)


def open_netpbm(data: bytes) -> Raster:
    kind, at, values = data[1:2], 2, []
    if kind == b"7":
        return _open_pam(data)
    while len(values) < (2 if kind in b"14" else 3):
        m = _TOKEN.match(data, at)
        _check(m is not None, "bad header")
        values.append(int(m[1]))
        at = m.end()
    w, h, top = values[0], values[1], values[2] if kind not in b"14" else 1
    _check(w > 0 and h > 0 and 0 < top < 65536, "bad size")
    c = 3 if kind in b"36" else 1
    name = "P" + kind.decode()
    if kind in b"123":
        body = data[at:]
        if b"#" in body:
            body = re.sub(rb"#[^\n]*", b"", body)
        _check(len(body) >= w * h * c)
        if kind == b"1":
            a = np.frombuffer(body, np.uint8)
            a = a[a > 32]
            _check(len(a) >= w * h)
            a = a[: w * h] - 48
            _check(int(a.max()) <= 1, "bad value")
            out = ((1 - a) * 255).reshape(h, w, 1)
        else:
            out = _plain(body, w * h * c)
            out = np.minimum(out, top).astype(np.uint8) if top == 255 else _scaled(top)[np.minimum(out, top)]
            out = out.reshape(h, w, c)
        return Raster(name, h, w, c, lambda a, b: out[a:b])
    return _raw(name, data, at + 1, h, w, c, c, top, bits=kind == b"4")


def _plain(body: bytes, n: int) -> np.ndarray:
    """n numbers of a plain image, a part of its text at a time."""
    out, have, at = np.empty(n, np.uint16), 0, 0
    while have < n and at < len(body):
        end = at + (1 << 20)
        while end < len(body) and body[end] > 32:
            end += 1
        part = body[at:end]
        _check(not part.translate(None, b"0123456789 \t\n\r\v\f"), "bad value")
        v = np.fromstring(part, np.int64, sep=" ")[: n - have] if part.strip() else np.zeros(0, np.int64)
        out[have : have + len(v)] = np.clip(v, 0, 65535)
        have, at = have + len(v), end
    _check(have == n)
    return out


def _raw(name: str, data: bytes, at: int, h: int, w: int, depth: int, c: int, top: int, bits: bool = False) -> Raster:
    """Rows of a raw image of which the first c of depth channels count."""
    size = -(-w // 8) if bits else w * depth * (2 if top > 255 else 1)
    _check(len(data) - at >= size * h)

    def rows(a: int, b: int) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8, size * (b - a), at + size * a).reshape(b - a, size)
        if bits:
            return ((1 - np.unpackbits(raw, axis=1)[:, :w]) * 255)[:, :, None]
        v = (raw.view(">u2") if top > 255 else raw).reshape(b - a, w, depth)[:, :, :c]
        return v if top == 255 else _scaled(top)[v]

    return Raster(name, h, w, c, rows)


def _open_pam(data: bytes) -> Raster:
    end = data.find(b"ENDHDR\n")
    _check(end > 0, "bad header")
    fields = {k.upper(): v.strip() for k, _, v in (line.strip().partition(b" ") for line in data[2:end].split(b"\n") if not line.startswith(b"#"))}
    numbers = [fields.get(k, b"") for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL")]
    _check(all(re.fullmatch(rb"\d{1,9}", x) for x in numbers), "bad header")
    w, h, depth, top = map(int, numbers)
    _check(w > 0 and h > 0 and 0 < top < 65536 and 0 < depth <= 4, "bad size")
    return _raw("P7", data, end + 7, h, w, depth, 3 if depth > 2 else 1, top)


def _field(v: np.ndarray, mask: int) -> np.ndarray:
    """The bits of a mask, scaled to 255."""
    if not mask:
        return np.zeros(v.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    top = mask >> low
    return ((((v & np.uint32(mask)) >> np.uint32(low)).astype(np.uint64) * 255 + top // 2) // top).astype(np.uint8)


def _runs(data: bytes, h: int, w: int, bits: int) -> np.ndarray:
    """Palette indexes of a run-length coded bitmap, its first row first; what isn't coded is 0."""
    _check(w * h <= 1024 * max(len(data), 1), "truncated")  # as much as runs of 255 in two bytes can make, and skipped rows
    out, x, y, i = np.zeros((h, w), np.uint8), 0, 0, 0
    per = 8 // bits
    while i + 1 < len(data) and y < h:
        n, v = data[i], data[i + 1]
        i += 2
        if n:
            run = np.array([v] * n if bits == 8 else [v >> 4, v & 15] * ((n + 1) // 2), np.uint8)[:n]
        elif v == 0:
            x, y = 0, y + 1
            continue
        elif v == 1:
            break
        elif v == 2:
            _check(i + 1 < len(data))
            x, y, i = x + data[i], y + data[i + 1], i + 2
            continue
        else:
            n, size = v, -(-v // per)
            _check(i + size <= len(data))
            own = np.frombuffer(data, np.uint8, size, i)
            run = (own if bits == 8 else np.stack([own >> 4, own & 15], 1).ravel())[:n]
            i += size + size % 2
        run = run[: max(0, w - x)]
        out[y, x : x + len(run)] = run
        x += n
    return out


def open_bmp(data: bytes) -> Raster:
    _check(len(data) >= 26)
    start, head = struct.unpack_from("<II", data, 10)
    if head == 12:
        w, h, _, bits = struct.unpack_from("<HHHH", data, 18)
        packed = used = 0
    else:
        _check(head >= 40 and len(data) >= 54)
        w, h = struct.unpack_from("<ii", data, 18)
        bits, packed, used = struct.unpack_from("<HI12xI", data, 28)
    allowed = {0: (1, 4, 8, 16, 24, 32), 1: (8,), 2: (4,), 3: (16, 32), 6: (16, 32)}
    _check(bits in allowed.get(packed, ()) and w > 0 and h != 0, "unsupported bitmap")
    size, rows, up = (w * bits + 31) // 32 * 4, abs(h), h > 0
    masks = (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
    if packed in (3, 6):
        _check(len(data) >= 66)
        masks = struct.unpack_from("<III", data, 54)
    colours = None
    if bits <= 8:
        entry, first = (3 if head == 12 else 4), 14 + head
        n = min(used or 1 << bits, max(0, (len(data) - first) // entry))
        colours = np.frombuffer(data, np.uint8, entry * n, first).reshape(-1, entry)[:, 2::-1]

    def looked_up(index: np.ndarray) -> np.ndarray:
        _check(int(index.max()) < len(colours), "bad palette")
        return colours[index]

    if packed in (1, 2):
        index = _runs(data[start:], rows, w, bits)
        return Raster("BMP", rows, w, 3, lambda a, b: looked_up(index[rows - b : rows - a][::-1] if up else index[a:b]))
    _check(len(data) - start >= size * rows)

    def read(a: int, b: int) -> np.ndarray:
        first = rows - b if up else a
        raw = np.frombuffer(data, np.uint8, size * (b - a), start + size * first).reshape(b - a, size)
        if up:
            raw = raw[::-1]
        if bits == 24 or bits == 32 and masks == (0xFF0000, 0xFF00, 0xFF):
            return raw[:, : w * bits // 8].reshape(b - a, w, bits // 8)[:, :, 2::-1]
        if bits >= 16:
            v = np.ascontiguousarray(raw).view("<u2" if bits == 16 else "<u4")[:, :w].astype(np.uint32)
            return np.stack([_field(v, m) for m in masks], 2)
        if bits == 8:
            return looked_up(raw[:, :w])
        return looked_up(np.stack([raw >> (8 - bits * (k + 1)) & ((1 << bits) - 1) for k in range(8 // bits)], axis=2).reshape(b - a, -1)[:, :w])

    return Raster("BMP", rows, w, 3, read)


def open_image(data: bytes) -> Raster:
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6", b"7"):
        return open_netpbm(data)
    if data[:2] == b"BM":
        return open_bmp(data)
    raise ValueError("unknown format")


def decode(data: bytes) -> tuple[str, np.ndarray]:
    r = open_image(data)
    return r.kind, r.whole()


def _edges(s: np.ndarray, axis: int, n: int) -> np.ndarray:
    """Running sums along an axis, at the n + 1 edges between n equal parts, interpolated where one falls within a pixel."""
    size = s.shape[axis] - 1
    edge = np.arange(n + 1) * (size / n)
    low = np.minimum(edge.astype(int), size - 1)
    part = (edge - low).reshape([-1 if k == axis else 1 for k in range(s.ndim)])
    return np.take(s, low, axis) * (1 - part) + np.take(s, low + 1, axis) * part


def _summed(a: np.ndarray, axis: int) -> np.ndarray:
    shape = list(a.shape)
    shape[axis] += 1
    out = np.zeros(shape)
    np.cumsum(a, axis=axis, out=out[tuple(slice(1, None) if k == axis else slice(None) for k in range(a.ndim))])
    return out


def columns(a: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Of images (n, h, w, c), sums of each row over the target columns, for each number of them."""
    s = _summed(a, 2)
    return [np.diff(_edges(s, 2, w), axis=2) for w in sizes]


def down(a: np.ndarray, h: int) -> np.ndarray:
    """Sums of such columns over the h target rows."""
    return np.diff(_edges(_summed(a, 1), 1, h), axis=1)


def resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means of exact areas: differences of the integral image, interpolated at fractional edges."""
    return down(columns(a[None], (w,))[0], h)[0] / (a.shape[0] / h * a.shape[1] / w)


def rounded(a: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(a + 0.5 + 1e-9), 0, 255).astype(np.uint8)


_GREY = np.array([0.299, 0.587, 0.114])


def hashes(g: np.ndarray) -> np.ndarray:
    """Difference hashes of grey images (n, 8, 9)."""
    g = np.round(g, 6)
    return np.packbits((g[:, :, :-1] > g[:, :, 1:]).reshape(len(g), 64), axis=1).view(">i8")[:, 0].astype(np.int64)


def reduce(strips: Iterator[np.ndarray], h: int, w: int, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Tiles (n, tile, tile, c) and difference hashes of n images of one size, from strips (n, rows, w, c) of their rows."""
    parts = [columns(s, (tile, 9)) for s in strips]
    wide, nine = (np.concatenate(x, axis=1) if len(x) > 1 else x[0] for x in zip(*parts))
    tiles = rounded(down(wide, tile) / (h / tile * w / tile))
    grey = down(nine, 8) / (h / 8 * w / 9)
    return tiles, hashes(grey[..., 0] if grey.shape[3] == 1 else grey @ _GREY)


def npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def process(images: DataFrame, tile: int = TILE) -> DataFrame:
    """id, format, size, NPY tile of tile x tile pixels and difference hash of the rows (id, image) of images."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        rows: list[tuple] = [()] * batch.num_rows
        small: dict[tuple[int, int, int], list[tuple[int, str, np.ndarray]]] = defaultdict(list)
        heads = {c: npy(np.zeros((tile, tile, c), np.uint8))[: -tile * tile * c] for c in (1, 3)}

        def close(shape: tuple[int, int, int]) -> None:
            own = small.pop(shape)
            tiles, codes = reduce(iter([np.stack([a for _, _, a in own])]), shape[0], shape[1], tile)
            for (at, kind, _), t, code in zip(own, tiles, codes.tolist()):
                rows[at] = (kind, *shape, heads[shape[2]] + t.tobytes(), code, None)

        for at, data in enumerate(batch.column("image")):
            data = data.as_py()
            try:
                _check(bool(data), "no image")
                r = open_image(data)
                shape = (r.h, r.w, r.c)
                if r.h * r.w * r.c <= STRIP // 16:
                    small[shape].append((at, r.kind, r.whole()))
                    if len(small[shape]) * r.h * r.w * r.c >= STRIP // 4:
                        close(shape)
                else:
                    tiles, codes = reduce((s[None] for s in r.strips()), r.h, r.w, tile)
                    rows[at] = (r.kind, *shape, heads[r.c] + tiles[0].tobytes(), int(codes[0]), None)
            except (ValueError, struct.error) as e:
                rows[at] = (None,) * 6 + (str(e) or "bad image",)
        for shape in list(small):
            close(shape)
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string())
        names = ("format", "height", "width", "channels", "tile", "dhash", "error")
        yield {"id": batch.column("id")} | {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds))}

    return map_arrow(images.select(F.col("id").cast("long"), F.col("image").cast("binary")), run, SCHEMA)


def encode_bmp(a: np.ndarray) -> bytes:
    h, w, _ = a.shape
    rgb = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a
    row = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    row[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + row.size, 0, 0, 54, 40, w, h, 1, 24, 0, row.size, 2835, 2835, 0, 0) + row.tobytes()


def encode_netpbm(a: np.ndarray, kind: int) -> bytes:
    h, w, _ = a.shape
    if kind == 4:
        return b"P4\n%d %d\n" % (w, h) + np.packbits(a[:, :, 0] < 128, axis=1).tobytes()
    if kind == 2:
        return b"P2\n# plain\n%d %d\n255\n" % (w, h) + " ".join(map(str, a[:, :, 0].ravel())).encode() + b"\n"
    return b"P%d\n%d %d\n255\n" % (kind, w, h) + (a if kind == 5 else np.repeat(a, 3, axis=2)[:, :, :3]).tobytes()


def rasters(embeddings: DataFrame, scale: int = 6) -> DataFrame:
    """id and image of each embedding: its values as a square grey raster, each a block of scale x scale pixels, as
    P5, P6, P4, P2 or BMP by turns. An embedding that is null or empty gives a null image."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out = []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
            v = np.array([0.0 if x is None or x != x else x for x in v.as_py() or []], np.float64)
            if not len(v):
                out.append(None)
                continue
            side = int(np.ceil(np.sqrt(len(v))))
            grid = np.zeros(side * side)
            low, high = v.min(), v.max()
            grid[: len(v)] = (v - low) / (high - low if high > low else 1.0)
            a = np.kron(rounded(grid.reshape(side, side) * 255), np.ones((scale, scale), np.uint8))[:, :, None]
            turn = (i or 0) % 5
            out.append(encode_bmp(a) if turn == 4 else encode_netpbm(a, (5, 6, 4, 2)[turn]))
        yield {"id": batch.column("vec_id"), "image": pa.array(out, pa.binary())}

    return map_arrow(embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")), run, "id long, image binary")
