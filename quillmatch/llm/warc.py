"""WARC files as a PySpark data source, read and written: format "warc".

Reading plans one partition a file (the largest first), and takes filters on record type, URI, status and other
header columns before anything of a payload is decoded: headers are parsed first, from as few bytes as hold them, and a
record that a predicate rules out is skipped - in a plain file by seeking over it, in a gzip file by the member's length
where the writer noted it (extra field "SL": lengths packed and unpacked, so that a member of several records isn't
skipped with the first), else by inflating without keeping. ``payload=false`` skips all payloads. Predicates are pushed
down where spark.sql.python.filterPushdown.enabled is on; with it or without, they can be given as options: ``types``,
``status`` (lists with commas) and ``host`` (that host and those under it).

The records of a file are read from one stream of bytes: gzip members may hold several records, or parts of one, and
zeros may pad them. Heads of WARC and HTTP end at the first blank line, with or without carriage returns. A head longer
than ``_HEAD_MOST`` is damage, as what is held must be bounded. What can't be read gives one row of type "damaged" with
the file as uri and the reason as content_type, and reading goes on at the next record or gzip member: a record cut off
by the file's end, broken gzip data, bytes between records that are no WARC header (up to the next line that is one).
``damaged=fail`` raises an error instead; count the rows of that type, or set it, where nothing may be lost.

Writing makes one file a task, a warcinfo record first, each record a gzip member (or plain with ``compress=false``);
mode "overwrite" deletes the files that were there when the job commits.

Columns: type, record_id, uri, date, content_type, length (of the record's block), page_id, status, http_type, payload
(of an HTTP response what follows its head, as stored). A header that a record lacks gives null, as does a number that
isn't one. Without a length that is one, a block goes on to the next blank line that a WARC header follows, or to the
end. A block of 2 GB or more fits no column: reading it with its payload raises an error, without works. A row without
html is written as a metadata record without a block, so that it comes back with a null payload. Records repeat as they
come, in the order of the file; there are no ties to break.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import filesystem

SCHEMA = "type string, record_id string, uri string, date string, content_type string, length long, page_id long, status int, http_type string, payload binary"
_ARROW = pa.schema([(n, t) for n, t in zip([c.split()[0] for c in SCHEMA.split(", ")], [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary()])])
_WARC = {"type": "warc-type", "record_id": "warc-record-id", "uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "page_id": "warc-page-id"}
_HTTP = {"status", "http_type"}
#: Bytes of a head beyond which it is damage; of a block, beyond which no binary column can hold it.
_HEAD_MOST, _BLOCK_MOST = 1 << 26, (1 << 31) - (1 << 16)
_BLANK, _NEXT = re.compile(rb"\r?\n\r?\n"), re.compile(rb"\r?\n\r?\n(?=WARC/\d)")
_LINE = re.compile(rb"\nWARC/\d")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)")


def headers(block: bytes) -> dict[str, str]:
    """Header lines to values by lower-case name; lines that begin with white space go on with the one before."""
    out, name = {}, None
    for line in block.split(b"\n")[1:]:
        text = line.rstrip(b"\r").decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _number(text: str | None, digits: int = 18, sign: str = "-?") -> int | None:
    """The whole number that a header's value is, if it is one of so many digits."""
    return int(text) if text and re.fullmatch(rf"{sign}[0-9]{{1,{digits}}}", text) else None


class Tests:
    """Pushed predicates by column."""

    def __init__(self, tests: list[tuple[str, str, object]]):
        self.warc = [t for t in tests if t[0] in _WARC]
        self.http = [t for t in tests if t[0] in _HTTP]

    @staticmethod
    def passes(tests: list[tuple[str, str, object]], row: dict) -> bool:
        for column, kind, value in tests:
            x = row.get(column)
            if kind == "in" and (x is None or x not in value) or kind == "there" and x is None or kind == "prefix" and not (x or "").startswith(value):
                return False
            if kind == "host":
                m = _HOST.match(x or "")
                if not m or not ("." + m[1].lower()).endswith("." + value.lower()):
                    return False
        return True


@dataclass
class FilePart(InputPartition):
    path: str
    size: int


class Stream:
    """The bytes of an open file in order, inflated if it is gzipped; ``held`` is what was made and not yet taken."""

    RAW = 1 << 16

    def __init__(self, f: pa.NativeFile):
        self.f, self.size, self.at, self.held = f, f.size(), 0, bytearray()
        self.window, self.base = b"", 0
        self.gz = self.raw(2) == b"\x1f\x8b"
        self.z, self.member, self.noted = None, 0, None
        self.fault: str | None = None

    def raw(self, n: int = RAW, least: int = 1) -> bytes:
        """Up to n bytes of the file from ``at`` on, which doesn't move; ``least`` of them, if the file has them."""
        i = self.at - self.base
        if not 0 <= i <= len(self.window) - least and (i < 0 or self.at < self.size):
            self.f.seek(self.at)
            self.window, self.base, i = self.f.read(max(n, self.RAW)), self.at, 0
        return self.window[i : i + n]

    def more(self, n: int) -> bytes:
        """Up to n more bytes; none at the end, or at a fault."""
        if not self.gz:
            out = self.raw(n)
            self.at += len(out)
            return out
        while not self.fault:
            if self.z is None and not self._open():
                return b""
            data = self.z.unconsumed_tail
            if not data:
                data = self.raw()
                self.at += len(data)
            try:
                out = self.z.decompress(data, n)
            except zlib.error as e:
                self.fault, self.z, self.at = f"broken gzip data: {e}", None, self.member + 1
                return b""
            if self.z.eof:
                self.at -= len(self.z.unused_data)
                self.z = None
            elif not data and not out:
                self.fault, self.z = "cut off in a gzip member", None
                return b""
            if out:
                return out
        return b""

    def _open(self) -> bool:
        """Begins the next gzip member; zeros before it are padding, anything else is a fault."""
        while raw := self.raw():
            bare = raw.lstrip(b"\0")
            self.at += len(raw) - len(bare)
            if not bare:
                continue
            head = self.raw(24, 24)
            if not head.startswith(b"\x1f\x8b"[: len(head)]):
                self.fault = "no gzip member"
                return False
            self.member, self.z = self.at, zlib.decompressobj(31)
            self.noted = struct.unpack("<II", head[16:24]) if len(head) == 24 and head[3] & 4 and head[12:16] == b"SL\x08\0" else None
            return True
        return False

    def resume(self) -> bool:
        """After a fault: drops what is held and goes to the next thing that looks like a member."""
        self.fault, self.z = None, None
        self.held.clear()
        while len(raw := self.raw()) > 1:
            k = raw.find(b"\x1f\x8b\x08")
            if k >= 0:
                self.at += k
                return True
            self.at += max(1, len(raw) - 2)
        return False

    def need(self, n: int) -> bool:
        """Whether n bytes are held, or can be had."""
        while len(self.held) < n:
            out = self.more(max(n - len(self.held), 1024))
            if not out:
                return False
            self.held += out
        return True

    def pass_line(self) -> None:
        """Drops what comes before the next line that begins like a WARC header; all of it, if none does."""
        while True:
            whole = self.need(len(self.held) + self.RAW)
            m = _LINE.search(self.held)
            if m or not whole:
                del self.held[: m.start() + 1 if m else len(self.held)]
                return
            del self.held[: len(self.held) - 16]

    def find(self, pattern: re.Pattern, most: int) -> re.Match | None:
        """The first match within ``most`` bytes, of which as few as needed are made, in steps that double."""
        n, at = min(1024, most), 0
        while True:
            whole = self.need(n)
            m = pattern.search(self.held, at, min(len(self.held), most))
            if m or not whole or n >= most:
                return m
            n, at = min(most, 2 * n), max(0, len(self.held) - 16)

    def skip(self, n: int) -> bool:
        """Passes over n bytes; whether there were so many."""
        k = min(n, len(self.held))
        del self.held[:k]
        n -= k
        if not self.gz:
            k = max(0, min(n, self.size - self.at))
            self.at += k
            return k == n
        while n:
            out = self.more(min(n, 1 << 18))
            if not out:
                return False
            n -= len(out)
        return True

    def jump(self, from_start: int, rest: int) -> bool:
        """Passes over the rest of a member without inflating it, if that is noted to end where the record does."""
        if self.z is None or not self.noted or from_start + rest != self.noted[1]:
            return False
        self.at, self.z = self.member + self.noted[0], None
        self.held.clear()
        return True


def records(where: fs.FileSystem, path: str, tests: Tests, payload: bool, fail: bool = False) -> Iterator[dict]:
    with where.open_input_file(path) as f:
        yield from parse(Stream(f), path, tests, payload, fail)


def parse(s: Stream, path: str, tests: Tests, payload: bool, fail: bool = False) -> Iterator[dict]:
    nothing = {name: None for name in _ARROW.names}

    def damaged(reason: str) -> Iterator[dict]:
        if fail:
            raise ValueError(f"{path}: {reason} (before byte {s.at} of the file)")
        row = nothing | {"type": "damaged", "uri": path, "content_type": reason}
        if tests.passes(tests.warc, row) and tests.passes(tests.http, row):
            yield row

    while True:
        fresh = not s.held and s.z is None
        if not s.need(1):
            if s.fault:
                yield from damaged(s.fault)
                if s.resume():
                    continue
            return
        origin = s.member
        if s.held[:1] in (b"\r", b"\n", b"\0"):
            del s.held[: len(s.held) - len(s.held.lstrip(b"\r\n\0"))]
            continue
        if not s.need(6) or not s.held.startswith(b"WARC/"):
            if s.fault:
                s.held.clear()
            else:
                yield from damaged("no WARC header")
                s.pass_line()
            continue
        end = s.find(_BLANK, _HEAD_MOST)
        if end is None:
            if s.fault:
                s.held.clear()
            else:
                yield from damaged("head cut off" if len(s.held) < _HEAD_MOST else "head too long")
                s.pass_line()
            continue
        h = headers(bytes(s.held[: end.start()]))
        del s.held[: end.end()]
        length = _number(h.get("content-length"), sign="")
        row = nothing | {k: h.get(v) for k, v in _WARC.items()} | {"length": length}
        row["page_id"] = _number(row["page_id"])
        wanted = tests.passes(tests.warc, row)
        if length is None:
            end_of = s.find(_NEXT, 1 << 62)
            length = end_of.start() if end_of else len(s.held)
            if not end_of and s.fault:
                s.held.clear()
                continue
        http = row["type"] == "response" and (row["content_type"] or "").startswith("application/http")
        cut = 0
        if wanted and http:
            m = s.find(_BLANK, length)
            first = bytes(s.held[: m.start() if m else min(length, len(s.held))])
            words = first.partition(b"\n")[0].split()
            row["status"] = _number(words[1].decode("latin-1"), 3, "") if len(words) > 1 else None
            row["http_type"] = headers(first).get("content-type")
            cut = m.end() if m else length
        wanted = wanted and tests.passes(tests.http, row)
        if not wanted or not payload:
            if fresh and s.member == origin and s.jump(end.end(), length + 4):
                if wanted:
                    yield row
                continue
            whole = s.skip(length)
        else:
            if length > _BLOCK_MOST:
                raise ValueError(f"{path}: a block of {length} bytes fits no column; read it with payload=false")
            whole = s.need(length)
            row["payload"] = bytes(s.held[cut:length]) if length or http else None
            del s.held[:length]
        if not whole:
            if not s.fault:
                yield from damaged("record cut off")
                s.held.clear()
        elif wanted:
            yield row


class _Push:
    """pushFilters of a reader. It passes for the inherited method, as Spark refuses readers with one of their own where
    pushdown is off; there it is simply not called."""

    __func__ = staticmethod(DataSourceReader.pushFilters)

    def __init__(self, tests: list):
        self.tests = tests

    def __call__(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in _WARC or column in _HTTP:
                if isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                    self.tests.append((column, "in", {f.value}))
                    continue
                if isinstance(f, In):
                    self.tests.append((column, "in", set(f.value) - {None}))
                    continue
                if isinstance(f, IsNotNull):
                    self.tests.append((column, "there", None))
                    continue
                if isinstance(f, StringStartsWith):
                    self.tests.append((column, "prefix", f.value))
                    continue
            yield f


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.fail = options.get("damaged", "report").lower() == "fail"
        self.tests: list[tuple[str, str, object]] = []
        if options.get("types"):
            self.tests.append(("type", "in", set(options["types"].split(","))))
        if options.get("status"):
            self.tests.append(("status", "in", {int(x) for x in options["status"].split(",")}))
        if options.get("host"):
            self.tests.append(("uri", "host", options["host"]))
        self.pushFilters = _Push(self.tests)

    def partitions(self) -> list[FilePart]:
        where, inner = filesystem(self.path)
        info = where.get_file_info(inner)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(inner, recursive=True))
        scheme = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        parts = [FilePart(scheme + x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
        return sorted(parts, key=lambda p: (-p.size, p.path))

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        where, inner = filesystem(part.path)
        rows, size = [], 0
        for row in records(where, inner, Tests(self.tests), self.payload, self.fail):
            own = len(row["payload"] or b"") + 200
            if rows and size + own > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows, size = [], 0
            rows.append(row)
            size += own
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    path: str


def member(data: bytes, level: int) -> bytes:
    """A gzip member that notes its lengths, packed and unpacked, in an extra field."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = 10 + 2 + 12 + len(body) + 8
    noted = struct.pack("<H2sHII", 12, b"SL", 8, total, len(data)) if total < 1 << 32 and len(data) < 1 << 32 else struct.pack("<H2sHII", 12, b"XX", 8, 0, 0)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + noted + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    clean = lambda x: "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in x)
    lines = [f"WARC-Type: {kind}", *(f"{k}: {clean(v)}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    """Writes page_id, url and html as response records; other columns are ignored."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", "3")), overwrite
        self.compress = options.get("compress", "true").lower() != "false"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        where, inner = filesystem(self.path)
        where.create_dir(inner, recursive=True)
        name = f"{uuid.uuid4().hex}.warc" + ".gz" * self.compress
        pack = (lambda r: member(r, self.level)) if self.compress else (lambda r: r)
        with where.open_output_stream(f"{inner}/_{name}", compression=None) as f:
            f.write(pack(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"software: quillmatch\r\n")))
            for b in batches:
                out = io.BytesIO()
                for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    ident = hashlib.md5(f"{page}|{url}".encode()).hexdigest()
                    fields = [("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(ident)}>"), ("WARC-Target-URI", url), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Page-ID", None if page is None else str(page))]
                    if html is None:
                        out.write(pack(record("metadata", fields, b"")))
                        continue
                    body = html if isinstance(html, bytes) else html.encode()
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
                    out.write(pack(record("response", [*fields, ("Content-Type", "application/http; msgtype=response")], http + body)))
                f.write(out.getvalue())
        return Written(f"{inner}/_{name}")

    def commit(self, messages: list[Written | None]) -> None:
        where, inner = filesystem(self.path)
        if self.overwrite:
            for old in where.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)):
                if old.type == fs.FileType.File and not old.base_name.startswith(("_", ".")):
                    where.delete_file(old.path)
        for m in messages:
            if m is not None:
                head, _, tail = m.path.rpartition("/_")
                where.move(m.path, f"{head}/{tail}")

    def abort(self, messages: list[Written | None]) -> None:
        where, _ = filesystem(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(m.path)


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)
