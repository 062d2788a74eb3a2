"""The ten registered queries, as they are registered: against SQL where there is some, else against plain versions."""

import io
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from quillmatch.llm import bpe, kernel, langid, lmscore, media, toxicity

from ..test_queries import DATA, TABLES, normal
from .test_media_web import brute_resize
from .test_text_ops import jaccard, words_of


@pytest.fixture(scope="module")
def rows(spark):
    """Results of the registered queries, made once each."""
    made = {}

    def of(n):
        if n not in made:
            name = next(x for x in entry.queries() if x.startswith(f"op{n}_"))
            made[n] = entry.queries()[name](spark, DATA).collect()
        return made[n]

    return of


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = c.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(x) for x in columns]
    want = sorted(tuple(normal(r[i]) for i in at) for r in cursor.fetchall())
    assert sorted(tuple(normal(r[x]) for x in columns) for r in df.collect()) == want and want


def test_op1_and_op9(rows, documents):
    lib = Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)
    want = {d["doc_id"]: lib.encode(d["text"], add_special_tokens=False) for d in documents}
    one, nine = rows(1), rows(9)
    assert len(one) == len(nine) == len(documents)
    assert all(r["ids"] == want[r["doc_id"]].ids and r["n_tokens"] == len(r["ids"]) and r["starts"] == [a for a, _ in want[r["doc_id"]].offsets] and r["round_trip"] for r in one)
    lang = {d["doc_id"]: d["lang"] for d in documents}
    assert all(r["tokens"] == want[r["doc_id"]].ids and r["n_tokens"] == len(r["tokens"]) and r["lang"] == lang[r["doc_id"]] for r in nine)


def test_op2(rows):
    e = pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()
    got = {r["id"]: r for r in rows(2)}
    assert len(got) == len(rows(2)) == len(e) and {r["format"] for r in rows(2)} == {"P2", "P4", "P5", "P6", "BMP"}
    for x in e[::25]:
        v = np.array(x["embedding"], np.float64)
        side = int(np.ceil(np.sqrt(len(v))))
        grid = np.zeros(side * side)
        grid[: len(v)] = (v - v.min()) / (v.max() - v.min())
        a = media.rounded(grid.reshape(side, side) * 255).repeat(6, 0).repeat(6, 1)[:, :, None]
        r = got[x["vec_id"]]
        if r["format"] == "P4":
            a = (a >= 128).astype(np.uint8) * 255
        if r["format"] in ("P6", "BMP"):
            a = a.repeat(3, 2)
        assert (r["height"], r["width"], r["channels"]) == a.shape
        assert np.array_equal(np.load(io.BytesIO(bytes(r["tile"]))), media.rounded(brute_resize(a, 16, 16)))
        g = np.round(brute_resize(a[:, :, :1], 8, 9)[:, :, 0], 6)
        want = int("".join("1" if g[i, j] > g[i, j + 1] else "0" for i in range(8) for j in range(8)), 2)
        assert r["dhash"] == (want if want < 1 << 63 else want - (1 << 64))


def test_op4(rows, documents):
    got = {r["doc_id"]: r["rep_id"] for r in rows(4)}
    near, far = [], 0
    for n, x in enumerate(documents):
        for y in documents[:n]:
            s = jaccard(x["text"], y["text"])
            if s >= 0.65:
                near.append((x["doc_id"], y["doc_id"]))
            far = max(far, s if s < 0.5 else 0)
    assert near and all(got[a] == got[b] for a, b in near)
    # no group without a pair of its own that is like enough for 128 minima to agree by half
    members = defaultdict(list)
    text = {d["doc_id"]: d["text"] for d in documents}
    for d, rep in got.items():
        members[rep].append(d)
    assert all(len(m) > 1 and min(m) == rep and all(max(jaccard(text[d], text[o]) for o in m if o != d) > 0.35 for d in m) for rep, m in members.items())


def test_op5(rows, documents):
    target = {r["doc_id"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist() if r["quality"] == 1}
    uni, hist, both = ([Counter(), Counter()] for _ in range(3))
    text = {d["doc_id"]: ["<s>", *words_of(d["text"])] for d in documents}
    for k, w in text.items():
        for c in range(1 + (k in target)):
            uni[c].update(w[1:])
            hist[c].update(w[:-1])
            both[c].update(zip(w, w[1:]))
    total, size = uni[1].total(), max(len(uni[0]), lmscore.WORDS) + 1

    def p(c, scale, h, w):
        return (both[c][h, w] * scale + lmscore.PRIOR * (uni[c][w] * scale + 1) / (total + size)) / (hist[c][h] * scale + lmscore.PRIOR)

    assert len(rows(5)) == len(documents)
    for r in rows(5):
        w = text[r["doc_id"]]
        want = np.mean([np.log(p(0, total / uni[0].total(), h, x) / p(1, 1, h, x)) for h, x in zip(w, w[1:])]) if len(w) > 1 else None
        assert r["n_words"] == len(w) - 1 and (r["ce_diff"] is None if want is None else abs(r["ce_diff"] - want) < 2e-6)


def test_op7(spark, rows, documents):
    """Scores by loops over the trained net; thresholds by trying all of them; flags from both."""
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    net, trained = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in rows(7)}
    assert len(got) == len(documents)

    def score(text):
        _, _, w = next(kernel.each_chunk(pa.array([text])))
        if not len(w.full):
            return 0.0
        e = [sum(net.emb[f] for f in c) for c in toxicity.features(w).T] + [np.zeros(toxicity.DIM)] * toxicity.PAD
        top = np.concatenate([np.max([sum(e[i + k] @ net.conv[n][k] for k in range(n) if i + k < len(e)) for i in range(len(e))], axis=0) for n in toxicity.WIDTHS])
        return 1 / (1 + np.exp(-(np.maximum(top + net.bias, 0) @ net.out + net.out_bias)))

    short = sorted(documents, key=lambda d: len(d["text"]))[:80]
    assert all(abs(got[d["doc_id"]]["score"] - score(d["text"])) < 1e-4 for d in short)
    mark = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()}
    held = [(got[d["doc_id"]]["lang"], got[d["doc_id"]]["score"], mark[d["doc_id"]]) for d in documents if d["doc_id"] in mark and d["doc_id"] not in trained]

    def limit(own):
        hits = sum(t for _, _, t in own)
        tried = sorted({round(s * toxicity.BINS) for _, s, _ in own}, reverse=True)
        f1 = [2 * sum(t for _, s, t in own if round(s * toxicity.BINS) >= b) / (sum(round(s * toxicity.BINS) >= b for _, s, _ in own) + max(hits, 1)) for b in tried]
        k = int(np.argmax(f1))
        return (tried[k] + (tried[k + 1] if k + 1 < len(tried) else 0)) / 2 / toxicity.BINS

    by = {}
    for lang in {x for x, _, _ in held}:
        own = [x for x in held if x[0] == lang]
        if all(sum(t == kind for _, _, t in own) >= toxicity.LEAST for kind in (0, 1)):
            by[lang] = limit(own)
    pooled = limit(held) if any(t for _, _, t in held) else 0.5
    assert all(r["toxic"] == (r["score"] >= by.get(r["lang"], pooled) and r["score"] > 0) for r in got.values())


def test_op8(spark, rows, documents):
    """Features, document frequencies, distances and limits in plain Python; the centroids are the trained ones."""
    model = langid.train(spark.read.parquet(f"{DATA}/documents.parquet"))

    def grams(text):
        s = " ".join(["", *(w for w in words_of(text)), ""]).encode()
        out = Counter()
        for k in (2, 3):
            for i in range(len(s) - k + 1):
                cell = int.from_bytes(s[i : i + k], "little") * (0x9E3779B1 + 0x7F4A7C2E * k & 0xFFFFFFFF) & 0xFFFFFFFF
                out[cell >> (32 - 13)] += 1
        return out

    # white space and signs between words are as many blanks as they are bytes, so the plain version folds them first
    plain = {d["doc_id"]: langid.counts(*kernel.text_bytes(pa.array([d["text"]])))[0] for d in documents}
    one = "ab cd"
    assert {int(k): int(v) for k, v in enumerate(langid.counts(*kernel.text_bytes(pa.array([f" {one} "])))[0]) if v} == dict(grams(one))
    df = sum((c > 0).astype(int) for c in plain.values())
    idf = np.log((1 + len(documents)) / (1 + df)) + 0.05
    assert np.allclose(idf, model.idf, atol=1e-5)
    found = {}
    for d in documents:
        c = plain[d["doc_id"]]
        if c.sum():
            v = np.sqrt(c) * idf
            sim = model.centroids @ (v / np.linalg.norm(v))
            found[d["doc_id"]] = (model.langs[int(sim.argmax())], 1 - sim.max(), int(np.log2(c.sum())), d["lang"])
    got = {r["doc_id"]: r for r in rows(8)}
    assert len(got) == len(documents)
    for k, (lang, dist, _, _) in found.items():
        assert abs(got[k]["distance"] - dist) < 1e-4 and got[k]["pred"] == lang
    by = defaultdict(list)
    for k, (lang, _, size, label) in found.items():
        if lang == label:
            by[size].append(got[k]["distance"])
    at = lambda v, q: sorted(v)[max(0, int(np.ceil(q * len(v))) - 1)]
    own = {s: at(v, langid.HIGH) + at([abs(x - at(v, 0.5)) for x in v], 0.5) * (1 + langid.FEW / len(v)) for s, v in by.items() if len(v) >= langid.LEAST}
    for k, (_, _, size, _) in found.items():
        near = [s for s in own if s <= size]
        limit = own[max(near)] if near else np.inf
        if abs(got[k]["distance"] - limit) > 1e-6:
            assert got[k]["rejected"] == (got[k]["distance"] > limit)


def test_op10(rows, documents):
    items = {r["item_id"]: words_of(r["text"]) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()}
    text = {d["doc_id"]: words_of(d["text"]) for d in documents}
    got = {(r["doc_id"], r["item_id"]): r for r in rows(10)}

    def verbatim(item, own):
        key = "\0" + "\0".join(item) + "\0"
        return key in "\0" + "\0".join(own) + "\0"

    want = {(d, i) for d, own in text.items() for i, item in items.items() if item and verbatim(item, own)}
    assert want and want <= set(got)
    for (d, i), r in got.items():
        item, own = items[i], text[d]
        best = 0
        for a in range(0, len(own), 16):  # the share anywhere in the document is what was reported, or more
            region = own[a : a + 4 * len(item) + 64]
            t = [0] * (len(region) + 1)
            for x in item:
                last = 0
                for k, y in enumerate(region):
                    last, t[k + 1] = t[k + 1], last + 1 if x == y else max(t[k + 1], t[k])
            best = max(best, t[-1])
        assert r["lcs_share"] >= 0.55 and best / len(item) >= r["lcs_share"] - 1e-6
