"""Media, WARC, URL filters, the pipeline."""

import gzip
import io
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from quillmatch.llm import bpe, media, urlfilter, warc

from .test_text_ops import docs, labels, prose


def brute_resize(a, h, w):
    out = np.zeros((h, w, a.shape[2]))
    fy, fx = a.shape[0] / h, a.shape[1] / w
    for i in range(h):
        for j in range(w):
            for y in range(a.shape[0]):
                for x in range(a.shape[1]):
                    dy = max(0, min(y + 1, (i + 1) * fy) - max(y, i * fy))
                    dx = max(0, min(x + 1, (j + 1) * fx) - max(x, j * fx))
                    out[i, j] += a[y, x] * dy * dx / (fy * fx)
    return out


@pytest.mark.parametrize("shape", [(7, 5, 1), (4, 9, 3), (1, 1, 1), (3, 16, 3)])
def test_resize_matches_loops(shape):
    a = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    for h, w in ((3, 4), (8, 9), (1, 1)):
        assert np.allclose(media.resize(a, h, w), brute_resize(a, h, w))


def test_formats_round_trip():
    g = np.random.default_rng(2)
    a = g.integers(0, 256, (5, 11, 1)).astype(np.uint8)
    bits = (a > 127).astype(np.uint8) * 255
    assert (media.decode(media.encode_netpbm(a, 5))[1] == a).all()
    assert (media.decode(media.encode_netpbm(a, 2))[1] == a).all()
    assert (media.decode(media.encode_netpbm(bits, 4))[1] == bits).all()
    assert (media.decode(media.encode_netpbm(a, 6))[1] == np.repeat(a, 3, 2)).all()
    assert (media.decode(media.encode_bmp(a))[1] == np.repeat(a, 3, 2)).all()
    plain = b"P1\n# c\n3 2\n0 1 0\n1 0 1\n"
    assert media.decode(plain)[1][:, :, 0].tolist() == [[255, 0, 255], [0, 255, 0]]
    assert media.decode(b"P3 1 1 15 15 0 5\n")[1].tolist() == [[[255, 0, 85]]]
    wide = b"P5 2 1 65535\n" + struct.pack(">HH", 65535, 0)
    assert media.decode(wide)[1][:, :, 0].tolist() == [[255, 0]]
    palette = struct.pack("<4B4B", 1, 2, 3, 0, 9, 8, 7, 0)
    bmp = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 70, 0, 0, 62, 40, 3, -1, 1, 1, 0, 4, 0, 0, 2, 0) + palette + bytes([0b01000000, 0, 0, 0])
    assert media.decode(bmp)[1].tolist() == [[[3, 2, 1], [7, 8, 9], [3, 2, 1]]]


def bmp(w, h, bits, packed, body, extra=b"", used=0):
    start = 54 + len(extra)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", start + len(body), 0, 0, start, 40, w, h, 1, bits, packed, len(body), 0, 0, used, 0) + extra + body


def test_rarer_formats():
    pal = bytes([0, 0, 0, 0, 30, 20, 10, 0, 60, 50, 40, 0])
    two, one, zero = [40, 50, 60], [10, 20, 30], [0, 0, 0]
    assert media.decode(b"P7\nWIDTH 2\nHEIGHT 1\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n" + bytes([1, 2, 3, 9, 4, 5, 6, 9]))[1].tolist() == [[[1, 2, 3], [4, 5, 6]]]
    assert media.decode(b"P7\nWIDTH 2\nHEIGHT 1\nDEPTH 2\nMAXVAL 15\nENDHDR\n" + bytes([15, 9, 0, 9]))[1].tolist() == [[[255], [0]]]
    assert media.decode(bmp(2, 1, 16, 0, struct.pack("<HH", 0x7C00, 0x03FF)))[1].tolist() == [[[255, 0, 0], [0, 255, 255]]]
    assert media.decode(bmp(1, 1, 16, 3, struct.pack("<HH", 0x07E0, 0), struct.pack("<III", 0xF800, 0x7E0, 0x1F)))[1].tolist() == [[[0, 255, 0]]]
    assert media.decode(bmp(1, -1, 32, 3, struct.pack("<I", 0x11223344), struct.pack("<III", 0xFF, 0xFF00, 0xFF0000)))[1].tolist() == [[[0x44, 0x33, 0x22]]]
    rle8 = bytes([2, 1, 1, 2, 0, 0, 0, 3, 1, 2, 0, 0, 0, 1])  # a run of two, one; then three as they are
    assert media.decode(bmp(3, 2, 8, 1, rle8, pal, 3))[1].tolist() == [[one, two, zero], [one, one, two]]
    rle4 = bytes([3, 0x12, 0, 0, 0, 2, 1, 0, 1, 0x20, 0, 1])  # alternating; a step to the right, one
    assert media.decode(bmp(3, 2, 4, 2, rle4, pal, 3))[1].tolist() == [[zero, two, zero], [one, two, one]]
    core = b"BM" + struct.pack("<IHHI", 0, 0, 0, 32) + struct.pack("<IHHHH", 12, 2, 1, 1, 1) + bytes([0, 0, 0, 30, 20, 10]) + bytes([0b01000000, 0, 0, 0])
    assert media.decode(core)[1].tolist() == [[zero, one]]
    for bad in (bmp(9, 9, 8, 1, b"", pal, 3), bmp(60_000, 60_000, 8, 1, rle8, pal, 3), bmp(2, 1, 8, 0, bytes([7, 0, 0, 0]), pal, 3), bmp(1, 1, 5, 0, b"aaaa"), b"BM", b"P7\nWIDTH 1\n", b"P1\n2 1\n0 7\n", b"P2\n1 1\n255\n-3", b"P5\n1000000000 9\n255\n1"):
        if bad == bmp(9, 9, 8, 1, b"", pal, 3):
            assert not media.decode(bad)[1].any()
            continue
        with pytest.raises(ValueError):
            media.decode(bad)


def test_strips_give_what_the_whole_gives(spark, monkeypatch):
    g = np.random.default_rng(7)
    images = [media.encode_netpbm(g.integers(0, 256, (37, 53, 1)).astype(np.uint8), k) for k in (2, 4, 5, 6)] + [media.encode_bmp(g.integers(0, 256, (41, 29, 3)).astype(np.uint8))]
    images += [b"P6\n20 31\n900\n" + g.integers(0, 900, 20 * 31 * 3).astype(">u2").tobytes(), b"P1\n5 4\n" + b"01101" * 4]
    df = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(images * 3)], "id long, image binary")
    whole = {(r["id"], bytes(r["tile"]), r["dhash"]) for r in media.process(df, 4).collect()}
    assert len(whole) == 21
    for k, x in enumerate(images):
        a = media.decode(x)[1]
        tile = next(t for i, t, _ in whole if i == k)
        assert np.array_equal(np.load(io.BytesIO(tile)), media.rounded(brute_resize(a, 4, 4)))
        strips = media.open_image(x)
        monkeypatch.setattr(media, "STRIP", 150)
        tiles, code = media.reduce((s[None] for s in strips.strips()), strips.h, strips.w, 4)
        monkeypatch.undo()
        assert (k, media.npy(tiles[0]), int(code[0])) in whole


def test_media_rows(spark):
    a = np.arange(64, dtype=np.uint8).reshape(8, 8, 1) * 4
    good = media.encode_netpbm(a, 5)
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, good[:20]), (5, b"GIF89a"), (None, media.encode_bmp(a)), (6, b"P5\n999999 999999\n255\n"), (7, b"P5 x")]
    df = spark.createDataFrame([(i, bytearray(x) if x is not None else None, "q", 1) for i, x in rows], "id long, image binary, format string, height int")
    got = media.process(df, 4).collect()
    assert len(got) == len(rows)
    ok = [r for r in got if r["error"] is None]
    assert len(ok) == 3 and all(r["tile"] is None and r["dhash"] is None for r in got if r["error"])
    tile = np.load(io.BytesIO(bytes(ok[0]["tile"])))
    assert tile.shape == (4, 4, 1) and (tile == media.rounded(brute_resize(a, 4, 4))).all()
    g = np.round(brute_resize(a, 8, 9)[:, :, 0], 6)
    want = int("".join("1" if g[i, j] > g[i, j + 1] else "0" for i in range(8) for j in range(8)), 2)
    assert ok[0]["dhash"] == (want if want < 1 << 63 else want - (1 << 64))
    assert media.process(df.limit(0)).count() == 0
    e = spark.createDataFrame([(0, [0.1, 0.5, None]), (1, None), (2, []), (3, [1.0] * 64), (None, [2.0])], "vec_id long, embedding array<float>")
    r = media.rasters(e).collect()
    assert len(r) == 5 and [x["image"] is None for x in r] == [False, True, True, False, False]


PAGES = [(1, "http://a.example/x", "<p>é</p>"), (2, "http://b.example/\r\nX: y", "x" * 300_000), (3, None, ""), (None, "http://a.example/y", "z"), (4, "http://c.example/", None), (1, "http://a.example/x", "<p>é</p>")]


@pytest.mark.parametrize("compress", ["true", "false"])
def test_warc_round_trip(spark, tmp_path, compress):
    spark.dataSource.register(warc.Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(*p, "clash", 9) for p in PAGES], "page_id long, url string, html string, type string, status int").coalesce(2)
    pages.write.format("warc").option("compress", compress).mode("append").save(path)
    all_ = spark.read.format("warc").load(path)
    kinds = Counter(r["type"] for r in all_.collect())
    assert kinds["response"] == 5 and kinds["metadata"] == 1 and kinds["warcinfo"] >= 1
    got = Counter((r["page_id"], bytes(r["payload"]).decode()) for r in all_.filter("type = 'response'").collect())
    assert got == Counter((p, h) for p, _, h in PAGES if h is not None)
    assert all_.filter("type = 'response' AND status = 404").count() == 0
    assert {r["page_id"] for r in all_.filter("uri LIKE 'http://a.%'").collect()} == {1, None}
    lean = spark.read.format("warc").option("payload", "false").option("types", "response").load(path)
    assert lean.count() == 5 and lean.filter("payload IS NOT NULL").count() == 0
    assert lean.filter("page_id = 3").first()["uri"] is None


def test_warc_of_nothing_and_of_damaged_files(spark, tmp_path):
    spark.dataSource.register(warc.Warc)
    (tmp_path / "e").mkdir()
    assert spark.read.format("warc").load(f"file://{tmp_path}/e").count() == 0
    one = warc.record("response", [("WARC-Page-ID", "7"), ("Content-Type", "application/http")], b"HTTP/1.1 nope\r\n\r\nbody")
    (tmp_path / "e/a.warc").write_bytes(b"junk line\n" + one + one[:60])
    (tmp_path / "e/b.warc.gz").write_bytes(warc.member(one, 1) + warc.member(one, 1)[:40])
    (tmp_path / "e/c.warc").write_bytes(b"")
    rows = spark.read.format("warc").load(f"file://{tmp_path}/e").collect()
    good, bad = ([r for r in rows if (r["type"] == kind)] for kind in ("response", "damaged"))
    assert len(good) == 2 and all(r["page_id"] == 7 and r["status"] is None and bytes(r["payload"]) == b"body" for r in good)
    assert sorted((r["uri"].rsplit("/", 1)[1], r["content_type"]) for r in bad) == [("a.warc", "head cut off"), ("a.warc", "no WARC header"), ("b.warc.gz", "cut off in a gzip member")]


class Counting:
    def __init__(self, data):
        self.f, self.n = io.BytesIO(data), 0

    def size(self):
        return len(self.f.getbuffer())

    def seek(self, n):
        self.f.seek(n)

    def read(self, n):
        out = self.f.read(n)
        self.n += len(out)
        return out


def parsed(data, tests=(), **options):
    return list(warc.parse(warc.Stream(Counting(data)), "f", warc.Tests(list(tests)), options.pop("payload", True), **options))


def page(k, body=None, status=b"200", more=()):
    http = b"HTTP/1.1 %b OK\r\nContent-Type: text/html\r\n\r\n" % status
    return warc.record("response", [("WARC-Page-ID", str(k)), ("WARC-Target-URI", f"http://h{k}.a.com/{k}"), ("Content-Type", "application/http"), *more], http + (f"body {k}".encode() if body is None else body))


def test_a_ruled_out_record_is_not_inflated():
    big = warc.record("response", [("WARC-Page-ID", "1"), ("Content-Type", "text/plain")], random.Random(0).randbytes(3_000_000))
    f = Counting(warc.member(big, 1) * 2)
    assert list(warc.parse(warc.Stream(f), "f", warc.Tests([("page_id", "in", {9})]), True)) == [] and f.n < 200_000
    f = Counting(warc.member(big, 1) * 2)
    assert len(list(warc.parse(warc.Stream(f), "f", warc.Tests([]), False))) == 2 and f.n < 200_000


def test_warc_members_of_several_records():
    recs = [page(k) for k in range(3)]
    whole = b"".join(recs)
    ids = lambda rows: [r["page_id"] for r in rows]
    for data in (gzip.compress(whole), warc.member(whole, 1), whole, gzip.compress(whole[:500]) + gzip.compress(whole[500:]), b"".join(warc.member(r, 1) for r in recs)):
        got = parsed(data)
        assert ids(got) == [0, 1, 2] and [r["payload"] for r in got] == [b"body 0", b"body 1", b"body 2"]
        for payload in (True, False):
            assert ids(parsed(data, [("page_id", "in", {2})], payload=payload)) == [2]
            assert ids(parsed(data, [("uri", "host", "a.com")], payload=payload)) == [0, 1, 2]
        assert ids(parsed(data, [("uri", "host", "h1.a.com")])) == [1] and parsed(data, [("uri", "host", "b.com")]) == []
    padded = gzip.compress(recs[0]) + bytes(4) + gzip.compress(recs[1]) + bytes(70_000) + gzip.compress(recs[2]) + bytes(3)
    assert ids(parsed(padded)) == [0, 1, 2] and all(r["type"] == "response" for r in parsed(padded))


@pytest.mark.parametrize("pack", [lambda r: r, gzip.compress, lambda r: warc.member(r, 1)])
def test_warc_cut_off_anywhere(pack):
    one, two = pack(page(1)), pack(page(2, b"x" * 3000 + random.Random(3).randbytes(500)))
    for n in [*range(0, len(two), max(1, len(two) // 150)), len(two) - 1]:
        for payload in (True, False):
            got = parsed(one + two[:n], payload=payload)
            whole = [r["page_id"] for r in got if r["type"] == "response"]
            assert whole[0] == 1 and whole[1:] in ([], [2])
            if 0 < n < len(two) - 12:
                assert [r["type"] for r in got[1:]] == ["damaged"] or (not payload and whole == [1, 2]), n
    with pytest.raises(ValueError):
        parsed(one + two[: len(two) // 2], fail=True)


def test_warc_damage_is_counted_and_passed():
    one = gzip.compress(page(1))
    bad = bytearray(gzip.compress(page(2, random.Random(1).randbytes(9000))))
    bad[len(bad) // 2] ^= 0xFF
    for middle in (bytes(bad), b"garbage that is no member", gzip.compress(b"no header at all\r\n" * 9)):
        got = parsed(one + middle + gzip.compress(page(3)))
        assert [r["page_id"] for r in got if r["type"] == "response" and r["page_id"] != 2] == [1, 3]
        assert sum(r["type"] == "damaged" and r["uri"] == "f" for r in got) >= 1
    got = parsed(page(1) + b"junk\nmore junk\n" + b"y" * 300_000 + b"\n" + page(3))
    assert [r["type"] for r in got] == ["response", "damaged", "response"] and got[2]["page_id"] == 3


def test_warc_heads_and_numbers(monkeypatch):
    long_ = "v" * 1_500_000
    for pack in (lambda r: r, gzip.compress, lambda r: warc.member(r, 1)):
        got = parsed(pack(page(1, more=[("X-Long", long_)])) + pack(page(2)))
        assert [(r["page_id"], r["payload"]) for r in got] == [(1, b"body 1"), (2, b"body 2")]
        http = b"HTTP/1.1 200 OK\r\nX: " + long_.encode() + b"\r\n\r\nafter"
        wide = warc.record("response", [("Content-Type", "application/http")], http)
        assert [r["payload"] for r in parsed(pack(wide))] == [b"after"]
        bare = page(1).replace(b"Content-Length", b"X-Length") + page(2)
        got = parsed(pack(bare))
        assert [(r["page_id"], r["length"] is None, r["payload"]) for r in got] == [(1, True, b"body 1"), (2, False, b"body 2")]
        for hostile in (b"--5", b"-5", b"5e3", b"9" * 40, "\u0665".encode(), b""):
            got = parsed(pack(page(1).replace(b"WARC-Page-ID: 1", b"WARC-Page-ID: " + hostile)) + pack(page(2)))
            assert [r["page_id"] for r in got] == [-5 if hostile == b"-5" else None, 2]
            got = parsed(pack(re.sub(rb"Content-Length: \d+", b"Content-Length: " + hostile, page(1)) + page(2)))
            assert [r["payload"] for r in got if r["type"] == "response"] == [b"body 1", b"body 2"]
            assert [r["status"] for r in parsed(pack(page(1, status=hostile)))] == [None]
        lf = page(1).replace(b"\r\n", b"\n")
        lf = re.sub(rb"Content-Length: \d+", b"Content-Length: %d" % len(b"HTTP/1.1 200 OK\nContent-Type: text/html\n\nbody 1"), lf)
        assert [(r["status"], r["http_type"], r["payload"]) for r in parsed(pack(lf) + pack(page(2)))] == [(200, "text/html", b"body 1"), (200, "text/html", b"body 2")]
    monkeypatch.setattr(warc, "_HEAD_MOST", 2000)
    assert [r["type"] for r in parsed(page(1, more=[("X", "v" * 9000)]) + page(2))] == ["damaged", "response"]
    monkeypatch.setattr(warc, "_BLOCK_MOST", 40)
    assert len(parsed(page(1), payload=False)) == 1
    with pytest.raises(ValueError, match="fits no column"):
        parsed(page(1))


def test_warc_without_pushdown_and_over_again(spark, tmp_path):
    spark.dataSource.register(warc.Warc)
    path = f"file://{tmp_path}/o"
    pages = spark.createDataFrame([(1, "http://u:p@x.a.com:80/q", "h"), (2, "http://xa.com/", "i")], "page_id long, url string, html string").coalesce(1)
    for _ in range(2):
        pages.write.format("warc").mode("overwrite").save(path)
    for on in ("false", "true"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", on)
        there = spark.read.format("warc").load(path)
        assert sorted(r["page_id"] for r in there.filter("type = 'response' AND status IN (200, 201)").collect()) == [1, 2]
        hosted = spark.read.format("warc").option("host", "a.com").load(path)
        assert [r["page_id"] for r in hosted.filter("type = 'response'").collect()] == [1]


LENGTHS, DEPTHS = [1, 2, 3, 4, 6], [0, 1, 2, 3, 5]


def brute_expressions(url):
    rest = url.strip().split("://", 1)[-1].split("#")[0]
    cut = min([rest.find(x) for x in "/?" if x in rest] or [len(rest)])
    host, tail = rest[:cut].split("@")[-1].split(":")[0].lower().strip("."), rest[cut:]
    if not host:
        return set()
    path, q, query = tail.partition("?")
    path = "/" + path.lstrip("/")
    labels_ = host.split(".")
    hosts = {host} | {".".join(labels_[-k:]) for k in LENGTHS if k < len(labels_)}
    dirs = path.split("/")[1:-1]
    paths = {path + q + query, path} | {"/" + "".join(d + "/" for d in dirs[:k]) for k in DEPTHS if k <= len(dirs)}
    return {h + p for h in hosts for p in paths}


URLS = ["http://a.b.c.d.e.f.example.com:80/1/2/3/4/5/6.html?x=1#f", "https://user@Spam.Example/", "example.com", "http://e.com/a/b", "http://e.com?q", "ftp://x.y.z/p/"]


def test_url_expressions_match_a_plain_version(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    made = defaultdict(list)
    for r in urlfilter.expressions(df, LENGTHS, DEPTHS).collect():
        made[r["url"]].append(r["asked"])
    assert all(set(made[u]) == brute_expressions(u) and len(set(made[u])) == len(made[u]) for u in URLS)
    deep = "http://h.com/" + "x/../" * 9 + "a/./b/../../../c/../d%2Ehtml"
    odd = spark.createDataFrame([("http://h.com//a/./b/../c%2Ehtml",), ("http://1.2.3.4/x",), ("http://[::ffff:1.2.3.4]:8080/x",), ("",), ("http://",), (deep,), ("http://h.com/a/b/..",), ("http://h.com/..",)], "url string")
    got = defaultdict(set)
    for r in urlfilter.expressions(odd, LENGTHS, DEPTHS).collect():
        got[r["url"]].add(r["asked"])
    assert "h.com/a/c.html" in got["http://h.com//a/./b/../c%2Ehtml"] and got["http://1.2.3.4/x"] == {"1.2.3.4/x", "1.2.3.4/"} and got[""] == got["http://"] == set()
    assert got["http://[::ffff:1.2.3.4]:8080/x"] == {"[::ffff:1.2.3.4]/x", "[::ffff:1.2.3.4]/"} and "h.com/d.html" in got[deep] and "h.com/a/" in got["http://h.com/a/b/.."] and "h.com/" in got["http://h.com/.."]


@pytest.mark.parametrize("most", [0, 200_000])
def test_url_rules_of_any_depth_and_form(spark, monkeypatch, most):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", most)
    rules = [(1, "a.com/a/b/c/d/", "block", 1), (2, "h5.h4.h3.h2.b.com/", "block", 1), (3, "HTTPS://U@C.com:443//x/../Y/", "block", 1), (4, "D.org", "block", 1), (5, "1.2.3.4", "block", 1), (6, "http://", "block", 9), (7, "e.net/p?Q=1", "block", 1)]
    urls = ["http://a.com/a/b/c/d/e.html", "http://x.h7.h6.h5.h4.h3.h2.b.com/z", "http://c.com/Y/1", "http://c.com/y/1", "http://www.d.org", "http://1.2.3.4:99/", "http://9.1.2.3.4/", "http://e.net/p?Q=1#x", "http://e.net/p", "http://a.com/a/b/c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r["rule_id"] for r in urlfilter.apply(pages, urlfilter.rules_table(spark, rules)).orderBy("page_id").collect()]
    assert got == [1, 2, 3, None, 4, 5, None, 7, None, None]


def test_url_rules(spark):
    rules = [(1, "e.com/", "block", 1), (2, "e.com/a/", "allow", 1), (3, "x.y.z/p/", "block", None), (4, "y.z/", "allow", 0), (5, "e.com/", "allow", 1), (5, "e.com/", "allow", 1), (6, None, "block", 9), (7, "q.com/", None, 9)]
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate([*URLS, None, "", "http://e.com/a/b"])], "page_id long, url string, action string, priority int")
    got = {r["page_id"]: (r["rule_id"], r["action"]) for r in urlfilter.apply(pages, urlfilter.rules_table(spark, rules)).collect()}
    assert got == {0: (None, "allow"), 1: (None, "allow"), 2: (None, "allow"), 3: (2, "allow"), 4: (5, "allow"), 5: (3, "block"), 6: (None, "allow"), 7: (None, "allow"), 8: (2, "allow")}
    assert urlfilter.apply(pages.limit(0), urlfilter.rules_table(spark, rules)).count() == 0
    assert {r["action"] for r in urlfilter.apply(pages, urlfilter.rules_table(spark, [])).collect()} == {"allow"}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of documents, labels and benchmark with planted cases."""
    folder = tmp_path_factory.mktemp("corpus")
    g = random.Random(8)
    bad, item = ["grubfoul", "vexmuck"], prose(900, 40)
    rows, marks, planted = [], [], {"toxic": set(), "copy": set(), "leak": set()}
    for k in range(300):
        w = prose(k, 90).split()
        if k % 6 == 0:
            for _ in range(4):
                w.insert(g.randrange(len(w)), g.choice(bad))
            planted["toxic"].add(k)
        rows.append((k, " ".join(w), "en"))
        marks.append((k, 1, int(k % 6 == 0)))
    for k in (7, 13, 19):
        rows.append((1000 + k, rows[k][1], "en"))
        planted["copy"].add(1000 + k)
    for k in (25, 31):
        rows.append((2000 + k, prose(k + 5000, 60) + " " + item, "en"))
        planted["leak"].add(2000 + k)
    rows += [(3000, None, "en"), (3001, "", None), (None, prose(77, 50), "en"), (None, prose(9077, 50), "en")]
    planted["copy"].add(None)  # the first words of document 77
    frame = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    for name, df in (("documents", frame), ("labels", labels(spark, marks)), ("benchmark", spark.createDataFrame([(1, item), (2, None)], "item_id long, text string"))):
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder), rows, planted


def test_pipeline_stages_take_effect(spark, corpus):
    folder, rows, planted = corpus
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = now.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, now, folder)
        assert nxt.columns == columns
        before, after = (Counter(r["doc_id"] for r in d.select("doc_id").collect()) for d in (now, nxt))
        seen[name] = set(before - after)
        now = spark.createDataFrame(nxt.collect(), now.schema)
    assert planted["toxic"] <= seen["toxicity"] and len(seen["toxicity"] - planted["toxic"]) <= 3
    assert not seen["language_id"]
    assert seen["near_dedup"] == planted["copy"] - seen["toxicity"]
    assert seen["decontamination"] == planted["leak"]
    got = corpus_pipeline.run(spark, folder).collect()
    left = {r["doc_id"] for r in now.select("doc_id").collect()}
    assert {r["doc_id"] for r in got} == left and {3000, 3001, None} <= left
    text = {i: t for i, t, _ in rows}
    codec = bpe.Codec.of(bpe.DEFAULT_TOKENIZER)
    assert all(codec.decode(np.array(r["ids"])) == text[r["doc_id"]] for r in got if r["ids"] is not None and r["doc_id"] is not None)


def test_pipeline_of_an_empty_table(spark, corpus, tmp_path):
    folder = corpus[0]
    for name in ("documents", "labels", "benchmark"):
        t = pq.read_table(f"{folder}/{name}.parquet")
        pq.write_table(t.slice(0, 0), f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
