"""Encoding, near-dedup, language-model scores, toxicity, language ID, decontamination and token files."""

import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillmatch.llm import bpe, decontaminate, kernel, langid, lmscore, minhash, tokenstore, toxicity

WORD = re.compile(r"[0-9A-Za-zÀ-῿　-\U0010ffff]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, ids string, n int, key int, root string, target int, word string"
SYLLABLES = {"en": "the an er ing tion re th ou nd st", "de": "der ein sch ung lich ver keit au ge be"}


def words_of(text):
    return [w.lower() for w in WORD.findall(text)]


def prose(seed, n=120, lang="en"):
    g = random.Random(seed)
    s = SYLLABLES[lang].split()
    return " ".join("".join(g.choice(s) for _ in range(g.choice([1, 1, 2, 3, 4]))) for _ in range(n)) + "."


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5, "x", "y", 1, 2, "z", 3, "w") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    """Null and empty fields, no words, a very long text, repeated rows, ties; clashing column names throughout."""
    rows = [(i, prose(i, lang=lang), lang) for i, lang in enumerate(["en"] * 20 + ["de"] * 20)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "?!  \n", "en"), (103, prose(103, 60_000), "en"), (104, prose(3), None), (3, prose(3), "en"), (3, prose(3), "en"), (None, prose(55), "en"), (None, None, None)]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_words_match_a_regex():
    g = random.Random(1)
    texts = ["".join(g.choice("ab AB09 éÉñ×–“ 中д_-\n") for _ in range(g.randint(0, 60))) for _ in range(500)]
    known = {}
    for i, j, w in kernel.each_chunk(pa.array(texts), 700):
        for k in range(j - i):
            # scripts beyond Latin-1 keep their case; times and its like are letters of this kernel
            want = [re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), x) for x in WORD.findall(texts[i + k])]
            got = w.full[w.ptr[k] : w.ptr[k + 1]].tolist()
            assert len(got) == len(want)
            for a, b in zip(want, got):
                assert known.setdefault(a, b) == b
    assert len(set(known.values())) == len(known)


def test_hash_index_finds_what_was_added():
    g = np.random.default_rng(0)
    h = np.unique(g.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    index = kernel.HashIndex(16)
    assert (index.add(h[:100]) == np.arange(100)).all()
    index.add(h[100:])
    assert (index.find(h) == np.arange(len(h))).all()
    assert (index.find(h + np.uint64(1 << 63)) == -1).all()


def test_encoding_equals_the_library(spark):
    g = random.Random(0)
    parts = ["'s", "'re", "'ll", " ", "  ", "\n", "foo", " Bar", "É", "é", "×", "!", "%%%", "12", "''", "\t", "—", "中", "ß", "²", "\x1c", "<|endoftext|>"]
    texts = ["".join(g.choice(parts) for _ in range(g.randint(0, 30))) for _ in range(3000)]
    codec = bpe.Codec.of(bpe.DEFAULT_TOKENIZER)
    ranks = bpe.Codec.of(tokenstore.DEFAULT_RANKS)
    for i, j, _, ids, ptr, buf, off in bpe.encode_batch(pa.record_batch({"text": pa.array(texts)}), bpe.DEFAULT_TOKENIZER, 4096):
        starts = codec.starts(ids, ptr, buf, off)
        other, other_ptr = ranks.encode(buf, off)
        for k, e in enumerate(codec.lib.encode_batch(texts[i:j], add_special_tokens=False)):
            own = slice(ptr[k], ptr[k + 1])
            assert ids[own].tolist() == e.ids
            assert starts[own].tolist() == [a for a, _ in e.offsets]
            assert codec.decode(ids[own]) == texts[i + k]
            assert other[other_ptr[k] : other_ptr[k + 1]].tolist() == e.ids


def test_encode_and_decode_edges(spark, edge, none):
    rows = bpe.encode(edge)
    assert rows.count() == edge.count() and bpe.encode(none).count() == 0
    by = {r["doc_id"]: r for r in rows.collect()}
    assert by[100]["ids"] is None and by[100]["round_trip"] is None and by[101]["ids"] == [] and by[101]["n_tokens"] == 0
    assert all(r["round_trip"] for r in by.values() if r["ids"] is not None)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(rows).collect()}
    assert back[103] == prose(103, 60_000) and back[100] is None
    odd = spark.createDataFrame([(1, [None, -1, 999_999, 36])], "doc_id long, ids array<int>")
    assert bpe.decode(odd).first()["text"] == "E"
    half = bpe.Codec.of(bpe.DEFAULT_TOKENIZER)
    first = half.encode(*kernel.text_bytes(pa.array(["\U00013080"])))[0][:1]
    assert half.decode(first) == "�"


def test_a_tokeniser_that_cuts_otherwise_goes_through_the_library_whole(spark, tmp_path):
    """Files with another pre-tokeniser: piece boundaries of their own, spaces added, texts normalised."""
    from tokenizers import Tokenizer

    with open(bpe.DEFAULT_TOKENIZER, encoding="utf-8") as f:
        spec = json.load(f)
    texts = ["it's 12345 words", " two  spaces", "ABC é!!", "", None, "中文 text", "x" * 3000]
    variants = {"digits": {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, spec["pre_tokenizer"]]}}, "prefix": {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, "lower": {"normalizer": {"type": "Lowercase"}}}
    for name, change in variants.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(spec | change))
        lib = Tokenizer.from_file(str(tmp_path / f"{name}.json"))
        got = bpe.encode(docs(spark, [(k, t, "en") for k, t in enumerate(texts)]), str(tmp_path / f"{name}.json")).orderBy("doc_id").collect()
        for r, t in zip(got, texts):
            assert r["ids"] == (None if t is None else lib.encode(t, add_special_tokens=False).ids)
            if t and (name != "lower" or t == t.lower()) and name != "prefix":
                assert r["round_trip"] and r["starts"] == [a for a, _ in lib.encode(t, add_special_tokens=False).offsets]


def test_decoding_many_rows_equals_one_by_one(spark):
    codec, g = bpe.Codec.of(bpe.DEFAULT_TOKENIZER), random.Random(5)
    rows = [(k, None if k % 17 == 0 else [g.choice([None, -3, 60_000, g.randrange(256), g.randrange(50_000)]) for _ in range(g.randrange(12))]) for k in range(400)]
    got = {r["doc_id"]: r["text"] for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    for k, ids in rows:
        assert got[k] == (None if ids is None else codec.decode(np.array([x for x in ids if x is not None and 0 <= x < len(codec.width)], np.int64)))


def jaccard(a, b):
    def grams(t):
        w = words_of(t)
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def edited(text, seed, rate):
    g = random.Random(seed)
    return " ".join("edit%d" % g.randrange(9999) if g.random() < rate else w for w in text.split())


def test_near_duplicates_match_brute_force(spark):
    rows = []
    for k in range(25):
        base = prose(1000 + k, 150)
        rows += [(100 * k, base, "en"), (100 * k + 1, base, "en"), (100 * k + 2, edited(base, k, 0.03), "en"), (100 * k + 3, edited(base, k + 500, 0.06), "en")]
    rows += [(10_000 + k, prose(k), "en") for k in range(100)]
    got = {r["doc_id"]: r["rep_id"] for r in minhash.groups(docs(spark, rows)).collect()}
    pairs = [(a, b) for n, (a, x, _) in enumerate(rows) for b, y, _ in rows[:n] if jaccard(x, y) >= 0.5]
    found = sum(a in got and got.get(a) == got.get(b) for a, b in pairs)
    assert found >= 0.9 * len(pairs)
    assert not [d for d in got if d >= 10_000]
    kept = {r["doc_id"] for r in minhash.dedup(docs(spark, rows)).collect()}
    assert kept == {d for d, _, _ in rows if got.get(d, d) == d}


def test_a_group_of_hundreds_and_a_chain(spark):
    base = prose(5, 200)
    rows = [(k, edited(base, k, 0.04), "en") for k in range(300)]
    reps = {r["rep_id"] for r in minhash.groups(docs(spark, rows)).collect()}
    assert len(reps) == 1
    sig = np.arange(128)[None, :] + np.zeros((3, 1))
    sig[1, :60] += 1000
    sig[2, :] = sig[1]
    sig[2, 60:120] += 1000
    assert sorted(minhash.tie(sig.astype(np.uint16))) == [(0, 1), (1, 2)]


def union(pairs, n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("hot", [3, 8, 30, 4096])
def test_hot_keys_lose_no_link(spark, monkeypatch, hot):
    """Keys that all or many share, with clusters, chains and loners: the components of comparing all who meet."""
    monkeypatch.setattr(minhash, "HOT", hot)
    g = np.random.default_rng(4)
    sig = g.integers(0, 60_000, (150, 128)).astype(np.uint16)
    for k in range(1, 60):  # a cluster
        sig[k] = np.where(g.random(128) < 0.2, sig[k], sig[0])
    for k in range(61, 100):  # a chain, whose ends have little in common
        sig[k] = sig[k - 1]
        sig[k, g.permutation(128)[:55]] = g.integers(0, 60_000, 55)
    for k in range(101, 110, 2):  # pairs
        sig[k] = sig[k - 1]
        sig[k, :50] += 1
    bands = [[1 if k < 140 else 2, 3 if k % 2 else 4, 5 if k < 130 else 1000 + k, *range(10_000 + 100 * k, 10_005 + 100 * k)] for k in range(150)]
    sigs = spark.createDataFrame([(k, 0, k, bytearray(sig[k].tobytes()), b) for k, b in enumerate(bands)], "id long, own long, node long, sig binary, bands array<long>")
    met = [(a, b) for a in range(150) for b in range(a) if set(bands[a]) & set(bands[b]) and (sig[a] == sig[b]).mean() >= 0.5]
    edges = {(r["u"], r["v"]) for r in minhash.verified(sigs).collect()}
    assert edges <= {(b, a) for a, b in met} and union(edges, 150) == union(met, 150)


def test_documents_of_several_texts_and_without_ids(spark):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, a, "en"), (1, b, "en"), (2, b, "en"), (3, a, "en"), (1, a, "en"), (None, c, "en"), (None, c, "de"), (None, b, "en"), (4, prose(4, 80), "en")]
    frame = docs(spark, rows).withColumnRenamed("key", "__n").withColumnRenamed("root", "_0").withColumnRenamed("n", "_1")
    assert {(r["doc_id"], r["rep_id"]) for r in minhash.groups(frame).collect()} == {(1, 1), (2, 1), (3, 1)}
    for _ in range(2):
        kept = minhash.dedup(frame.repartition(3))
        assert kept.columns == frame.columns
        left = sorted(((r["doc_id"] or 0, r["text"], r["lang"]) for r in kept.collect()))
        assert left == sorted([(1, a, "en"), (1, b, "en"), (0, c, "de"), (4, prose(4, 80), "en")])


def test_components_match_union_find(spark):
    g = random.Random(3)
    edges = [(g.randrange(400), g.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)]
    parent = list(range(600))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in minhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {x: find(x) for a, b in edges for x in (a, b) if a != b}
    assert {k: v for k, v in got.items()} | {k: k for k in want if k not in got} == want


def test_dedup_edges(spark, edge, none):
    got = {(r["doc_id"], r["rep_id"]) for r in minhash.groups(edge).collect()}
    assert got == {(3, 3), (104, 3)}
    kept = minhash.dedup(edge)
    assert kept.columns == edge.columns
    left = Counter(r["doc_id"] for r in kept.collect())
    assert left[3] == 1 and 104 not in left and left[None] == 2 and left[100] == left[101] == left[102] == 1
    assert minhash.groups(none).count() == 0 and minhash.dedup(none).count() == 0


def test_minima_of_long_texts_are_the_same():
    h = kernel.mix(np.arange(3 * minhash._STEP + 7, dtype=np.uint64))
    whole = minhash.minima(h, np.array([0, len(h)]))[0]
    brute = [min(((int(x) >> 32) * int(a) + int(b) & (1 << 64) - 1) >> 32 for x in h[::997]) for a, b in zip(minhash._A, minhash._B)]
    sub = minhash.minima(h[::997].copy(), np.array([0, len(h[::997])]))[0]
    assert sub.tolist() == brute and (whole <= sub).all()


def test_scores_match_a_plain_model(spark):
    texts = {k: prose(k, 30, "en" if k % 2 else "de") for k in range(40)}
    target = {k for k in texts if k % 2}
    got = {r["doc_id"]: r for r in lmscore.score(docs(spark, [(k, t, "en") for k, t in texts.items()]), labels(spark, [(k, 1, 0) for k in target])).collect()}
    size = lmscore.WORDS + 1
    vocab = {w for t in texts.values() for w in words_of(t)}
    assert len(vocab) <= lmscore.WORDS
    b, t = Counter(), Counter()
    for k, text in texts.items():
        w = ["<s>", *words_of(text)]
        for pair in zip(w, w[1:]):
            b[pair] += 1
            t[pair] += k in target
    n_b, n_t = sum(b.values()), sum(t.values())
    scale = n_t / n_b

    def tables(c, scale):
        uni, hist = defaultdict(float), defaultdict(float)
        for (h, w), n in c.items():
            uni[w] += n * scale
            hist[h] += n * scale
        total = sum(uni.values())
        return lambda h, w: np.log((c[h, w] * scale + lmscore.PRIOR * (uni[w] + 1) / (total + size)) / (hist[h] + lmscore.PRIOR))

    lb, lt = tables(b, scale), tables(t, 1)
    for k, text in texts.items():
        w = ["<s>", *words_of(text)]
        want = np.mean([lb(h, x) - lt(h, x) for h, x in zip(w, w[1:])])
        assert got[k]["n_words"] == len(w) - 1 and abs(got[k]["ce_diff"] - want) < 1e-4
    assert np.mean([got[k]["ce_diff"] for k in target]) < 0 < np.mean([got[k]["ce_diff"] for k in texts if k not in target])


def test_scores_edges(spark, edge, none, monkeypatch):
    few = labels(spark, [(1, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, None)])
    got = lmscore.score(edge, few).collect()
    assert len(got) == edge.count()
    by = {r["doc_id"]: r for r in got}
    assert by[100]["ce_diff"] is None and by[101]["n_words"] == 0 and by[103]["n_words"] == 60_000
    monkeypatch.setattr(lmscore, "SHIP_IDS", 0)
    joined = lmscore.score(edge, few).collect()
    assert sorted(map(str, joined)) == sorted(map(str, got))
    assert lmscore.score(none, few).count() == 0
    assert {r["ce_diff"] for r in lmscore.score(edge, labels(spark, [])).collect()} <= {0.0, None}


def toxic_rows(n, lang, bad, seed):
    g = random.Random(seed)
    rows = []
    for k in range(n):
        w = prose(seed * 1000 + k, 80, lang).split()
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(g.randrange(len(w)), g.choice(bad) + g.choice(["", "er", "ing"]))
        rows.append((seed * 10_000 + k, " ".join(w), lang, int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows(240, "en", ["grubfoul", "vexmuck"], 1) + toxic_rows(240, "de", ["zorkmist", "quaddel"], 2)
    known = [r for n, r in enumerate(rows) if n % 3]
    got = {r["doc_id"]: r["toxic"] for r in toxicity.detect(docs(spark, [r[:3] for r in rows]), labels(spark, [(r[0], 1, r[3]) for r in known])).collect()}
    held = [r for n, r in enumerate(rows) if n % 3 == 0]
    hits = sum(got[r[0]] for r in held if r[3])
    false = sum(got[r[0]] for r in held if not r[3])
    assert hits >= 0.9 * sum(r[3] for r in held) and false <= 0.03 * sum(not r[3] for r in held)
    kept = {r["doc_id"] for r in toxicity.keep(docs(spark, [r[:3] for r in rows]), labels(spark, [(r[0], 1, r[3]) for r in known])).collect()}
    assert kept == {d for d, t in got.items() if not t}


def test_toxicity_edges(spark, edge, none):
    some = labels(spark, [(k, 1, k % 2) for k in range(20)] + [(None, 1, 1), (5, 0, 0), (6, 0, None), (777, 1, 1)])
    got = toxicity.detect(edge, some).collect()
    assert len(got) == edge.count()
    assert all(r["score"] == 0 and not r["toxic"] for r in got if r["doc_id"] in (100, 101, 102))
    assert not any(r["toxic"] for r in toxicity.detect(edge, labels(spark, [])).collect())
    assert toxicity.detect(none, some).count() == 0
    kept = toxicity.keep(edge, labels(spark, []))
    assert kept.columns == edge.columns and kept.count() == edge.count()


def test_convolution_matches_loops():
    net = toxicity.Net(3)
    _, _, w = next(kernel.each_chunk(pa.array(["one two three four", "", "x"])))
    feats = toxicity.features(w)
    want = []
    for d in range(3):
        e = [sum(net.emb[f[i]] for f in feats) for i in range(w.ptr[d], w.ptr[d + 1])]
        if not e:
            want.append(0.0)
            continue
        e += [np.zeros(toxicity.DIM)] * toxicity.PAD
        top = np.concatenate([np.max([sum(e[i + k] @ net.conv[n][k] for k in range(n) if i + k < len(e)) for i in range(len(e))], axis=0) for n in toxicity.WIDTHS])
        want.append(1 / (1 + np.exp(-(np.maximum(top + net.bias, 0) @ net.out + net.out_bias))))
    assert np.allclose(net.score(w), want, atol=1e-5)


def test_a_score_does_not_depend_on_the_texts_beside_it():
    net, texts = toxicity.Net(5), [prose(k, 1 + k % 7) for k in range(60)] + ["", "x"]
    whole = toxicity.score_column(pa.array(texts), net)
    assert np.allclose(whole, [toxicity.score_column(pa.array([t]), net)[0] for t in texts], atol=1e-6) and len(set(whole.tolist())) > 50


def test_long_texts_go_in_parts_with_the_same_result(monkeypatch):
    text = pa.array([prose(4, 3000).replace("the", "é", 50)])
    _, _, w = next(kernel.each_chunk(text))
    net, whole = toxicity.Net(3), langid.counts(*kernel.text_bytes(text))
    score = net.score(w)
    monkeypatch.setattr(toxicity, "LONG", 700)
    monkeypatch.setattr(langid, "_LONG", 1000)
    assert np.allclose(net.score(w), score, atol=1e-6)
    assert (langid.counts(*kernel.text_bytes(text)) == whole).all()


def test_threshold_has_the_best_f1():
    g = np.random.default_rng(4)
    score = g.integers(0, 100, 400)
    toxic = (score + g.normal(0, 25, 400) > 60).astype(int)
    limit = toxicity.best_threshold(score, toxic, np.ones(400, int)) * toxicity.BINS

    def f1(t):
        hit = ((score >= t) & (toxic == 1)).sum()
        return 2 * hit / ((score >= t).sum() + toxic.sum())

    assert abs(f1(limit) - max(f1(t) for t in range(101))) < 1e-12


def test_language_id_on_held_out_rows(spark):
    found = {r["doc_id"]: r for r in langid.identify(docs(spark, [(k, t, lang) for k, t, lang in [(k, prose(k, 60, x), x if k % 4 < 2 else None) for k, x in enumerate(["en", "de"] * 60)]])).collect()}
    truth = dict(enumerate(["en", "de"] * 60))
    held = [k for k in truth if k % 4 >= 2]
    assert sum(found[k]["pred"] == truth[k] for k in held) >= 0.97 * len(held)
    assert not any(r["rejected"] for r in found.values())


def test_other_scripts_are_rejected_and_clean_ones_kept(spark, edge, none):
    rows = [(k, prose(k, 150, lang), lang) for k, lang in enumerate(["en", "de"] * 40)]
    foreign = [(1000 + k, " ".join("".join(random.Random(k * 99 + i).choice("жшщыцюяфъ") for _ in range(6)) for i in range(150)), None) for k in range(3)]
    got = {r["doc_id"]: r["rejected"] for r in langid.identify(docs(spark, rows + foreign)).collect()}
    assert all(got[k] for k in (1000, 1001, 1002)) and not any(v for k, v in got.items() if k < 1000)
    kept = langid.keep(docs(spark, rows + foreign))
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if not v}
    found = langid.identify(edge).collect()
    assert len(found) == edge.count()
    assert all(r["pred"] is None and r["distance"] is None and not r["rejected"] for r in found if r["doc_id"] in (100, 101, 102))
    assert langid.identify(none).count() == 0 and langid.keep(none).count() == 0
    assert langid.keep(edge).columns == edge.columns


def test_ngram_vectors_match_a_plain_count():
    texts = ["Abc ab!", "", "zz"]
    got = langid.counts(*kernel.text_bytes(pa.array(texts)))
    for row, text in zip(got, texts):
        s = "".join(c.lower() if c.isalnum() else " " for c in text)
        assert row.sum() == sum(s[i : i + 2] != "  " for k in (2, 3) for i in range(len(s) - k + 1))


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks_match_brute_force(spark):
    items = [(k, prose(9000 + k, 18 + 3 * (k % 14))) for k in range(40)]
    rows, truth = [], set()
    for k in range(200):
        w = prose(k, 150 + k).split()
        if k % 5 == 0:
            item = items[(k // 5) % 40]
            w[k % 100 : k % 100] = item[1].split()
            truth.add((k, item[0]))
        rows.append((k, " ".join(w), "en"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(spark, rows), bench(spark, items)).collect()}
    brute = set()
    for d, t, _ in rows:
        w = words_of(t)
        for i, text in items:
            x = words_of(text)
            for a in range(0, max(1, len(w) - len(x) + 1)):
                if w[a : a + len(x)] == x:
                    brute.add((d, i))
    assert truth <= brute and len(brute & got) >= 0.95 * len(brute) and len(got - brute) <= 1
    kept = {r["doc_id"] for r in decontaminate.keep(docs(spark, rows), bench(spark, items)).collect()}
    assert kept == {d for d, _, _ in rows} - {d for d, _ in got}


def test_paraphrases_need_the_answer(spark):
    item = prose(77, 40)
    w = item.split()
    close = [x if k % 4 or k > 30 else f"other{k}" for k, x in enumerate(w)]
    no_answer = [x if k < 24 else f"wrong{k}" for k, x in enumerate(w)]
    rows = [(1, " ".join(["lead"] * 5 + close), "en"), (2, " ".join(no_answer), "en"), (3, prose(3), "en")]
    got = {r["doc_id"]: r for r in decontaminate.leaks(docs(spark, rows), bench(spark, [(1, item)])).collect()}
    assert set(got) == {1} and got[1]["answer"]


def test_subsequences_match_the_table():
    g = np.random.default_rng(2)
    for _ in range(50):
        a, b = g.integers(0, 6, g.integers(1, 40)), g.integers(0, 6, g.integers(0, 70))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs(a, b) == t[-1, -1]


def dense(space, passages, n_own):
    """The TF-IDF matrix of passages, the benchmark's n_own first, as latent() weighs it."""
    at = {x: i for i, x in enumerate(space.vocab.tolist())}
    x = np.zeros((len(passages), len(at)))
    for r, p in enumerate(passages):
        for h in p.tolist():
            if h in at:
                x[r, at[h]] += space.weight[at[h]]
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    if len(passages) > n_own:
        x[n_own:] *= np.sqrt(n_own / (len(passages) - n_own))
    return x


def test_latent_space_is_the_leading_one_of_the_matrix(spark, monkeypatch):
    """Fewer directions than passages, which hold what a dense SVD's hold; near passages are those of a plain search."""
    monkeypatch.setattr(decontaminate, "RANK", 24)
    items = next(decontaminate.read_items(decontaminate.passages(bench(spark, [(k, prose(600 + k, 40)) for k in range(60)]))))
    rows = [(k, prose(600 + k % 60, 30) + " " + prose(k, 50) if k % 2 else prose(2000 + k, 90), "en") for k in range(160)]
    df, total = decontaminate.frequencies(docs(spark, rows), items)
    weight = np.log((1 + total) / (1 + df)) + 0.01
    near = decontaminate.near_passages(docs(spark, rows), items, weight)
    found = sorted(bytes(r["words"]) for r in near.collect())
    cut_, w = [], next(K3 for _, _, K3 in kernel.each_chunk(pa.array([t for _, t, _ in rows])))
    for x, y in zip(w.ptr, w.ptr[1:]):
        cut_ += [w.full[i : min(i + 64, y)] for i in range(x, y, 64)]
    own = [items.words[k][x:y] for k, x, y in items.passages()]
    plain = decontaminate.Space(items.vocab, weight)
    cos = dense(plain, cut_, len(cut_)) @ dense(plain, own, len(own)).T
    assert found == sorted(p.tobytes() for p, c in zip(cut_, cos.max(1)) if c >= decontaminate.NEAR) and 0 < len(found) < len(cut_)
    extra, n = decontaminate.extra_words(near, items.vocab)
    counted = Counter(x for p in found for x in set(np.frombuffer(p, np.uint64).tolist()) - set(items.vocab.tolist()))
    assert dict(zip(extra.tolist(), n.tolist())) == {x: c for x, c in counted.items() if c >= 3}
    space = decontaminate.Space(np.concatenate([items.vocab, extra]), np.concatenate([weight, np.ones(len(extra))]))
    v = decontaminate.latent(near, len(found), items, space)
    assert v.shape[1] == 24 < len(own) and np.allclose(v.T @ v, np.eye(24), atol=1e-4)
    x = dense(space, [*own, *(np.frombuffer(p, np.uint64) for p in found)], len(own))
    best = (np.linalg.svd(x, compute_uv=False)[:24] ** 2).sum()
    assert ((x @ v) ** 2).sum() >= 0.97 * best
    assert np.linalg.norm(x - x @ v @ v.T) > 0.2 * np.linalg.norm(x)  # it does leave something out


def test_paraphrases_that_plain_vectors_miss(spark):
    """Items whose rare words are all exchanged for others that stand beside them in the corpus."""
    g = random.Random(12)
    common = [f"plain{i}" for i in range(120)]
    items, changed, rows = [], [], [(k, " ".join(g.choices(common, k=12) + [f"filler{g.randrange(3000)}" for _ in range(80)]), "en") for k in range(300)]
    for k in range(30):
        w = [g.choice(common) if i % 2 == 0 or i > 31 else f"rare{k}n{i}" for i in range(40)]
        items.append((k, " ".join(w)))
        changed.append([x.replace("rare", "other") for x in w])
        for c in range(4):
            beside = [x for i in range(1, 32, 2) for x in (f"rare{k}n{i}", f"other{k}n{i}")]
            g.shuffle(beside)
            rows.append((1000 + 10 * k + c, " ".join(beside), "en"))
    rows += [(2000 + k, " ".join([f"filler{i}" for i in range(20)] + w + [f"filler{i}" for i in range(30, 50)]), "en") for k, w in enumerate(changed)]
    rows += [(3000 + k, " ".join(w[:24] + g.sample(w[24:], 16)[:4] + [f"filler{i}" for i in range(30)]), "en") for k, w in enumerate(changed)]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs(spark, rows), bench(spark, items)).collect()}
    assert {d for d, _ in got} == {2000 + k for k in range(30)} and all(got[2000 + k, k]["cosine"] >= decontaminate.COSINE and got[2000 + k, k]["answer"] for k in range(30))
    lot = next(decontaminate.read_items(decontaminate.passages(bench(spark, items))))
    df, total = decontaminate.frequencies(docs(spark, rows), lot)
    weight = np.log((1 + total) / (1 + df)) + 0.01
    plain = decontaminate.Space(lot.vocab, weight)
    w = next(x for _, _, x in kernel.each_chunk(pa.array([" ".join(x) for x in changed])))
    hashes = [w.full[x:y] for x, y in zip(w.ptr, w.ptr[1:])]
    cos = np.einsum("ij,ij->i", dense(plain, hashes, 30), dense(plain, lot.words, 30))  # of the paraphrase alone, words that the items lack left out
    norm = [np.sqrt(sum((weight[list(lot.vocab).index(x)] if x in set(lot.vocab.tolist()) else np.log(1 + total)) ** 2 for x in h.tolist())) for h in hashes]
    own = [np.sqrt(sum(weight[list(lot.vocab).index(x)] ** 2 for x in h.tolist() if x in set(lot.vocab.tolist()))) for h in hashes]
    assert max(c * b / a for c, a, b in zip(cos, norm, own)) < decontaminate.COSINE


def test_leaks_edges(spark, edge, none):
    items = bench(spark, [(1, prose(3, 40)), (1, prose(3, 40)), (2, None), (3, ""), (None, prose(8, 30))])
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(edge, items).collect())
    assert got[3, 1] == 1 and got[104, 1] == 1 and (8, None) in got
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(edge, bench(spark, [])).count() == 0
    assert decontaminate.keep(edge, items).columns == edge.columns
    assert decontaminate.keep(edge, bench(spark, [])).count() == edge.count()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, edge, tmp_path, monkeypatch, encoding):
    manifest = tokenstore.write(edge, f"file://{tmp_path}/t", encoding).cache()
    names = tokenstore.files(manifest)
    assert manifest.agg({"rows": "sum"}).first()[0] == edge.count()
    rows = tokenstore.read(spark, names).collect()
    want = {r["doc_id"]: r["ids"] for r in bpe.encode(edge).collect()}
    assert len(rows) == edge.count() and all(r["tokens"] == want[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    meta = tokenstore.read_metadata(spark, names)
    plan = meta._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in plan.split("ReadSchema")[1].split("\n")[0].replace("n_tokens", "")
    some = tokenstore.read_tokens(spark, names, 5, 7)
    assert {r["doc_id"] for r in some.collect()} == {5, 6, 7}
    file = pq.ParquetFile(names[0].removeprefix("file://"))
    column = file.metadata.row_group(0).column(3)
    assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in column.encodings and column.has_column_index and column.has_offset_index


def test_token_row_groups_and_empty_table(spark, none, tmp_path):
    assert tokenstore.files(tokenstore.write(none, f"file://{tmp_path}/e")) == []
    assert tokenstore.read(spark, []).count() == 0
