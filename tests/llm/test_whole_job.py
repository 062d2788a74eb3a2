"""Cases that a bound on the vocabulary, on windows or on distances would lose."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from quillmatch.llm import bpe, common, decontaminate, kernel, langid, lmscore

from .test_text_ops import bench, dense, docs, labels, prose, words_of


def test_scores_tell_rare_words_apart(spark, monkeypatch):
    """More distinct words than WORDS: each counts for itself, in words and in bigrams."""
    texts = {k: " ".join(f"w{k}x{i}" if i % 2 else f"pair{k // 2}x{i}" for i in range(240)) + " the end" for k in range(40)}
    target = {k for k in texts if k % 4 == 0}
    assert len({w for t in texts.values() for w in words_of(t)}) > 1.5 * lmscore.WORDS
    uni, hist, both = ([Counter(), Counter()] for _ in range(3))
    for k, text in texts.items():
        w = ["<s>", *words_of(text)]
        for c in range(1 + (k in target)):
            uni[c].update(w[1:])
            hist[c].update(w[:-1])
            both[c].update(zip(w, w[1:]))
    total, size = uni[1].total(), len(uni[0]) + 1

    def p(c, scale, h, w):
        return (both[c][h, w] * scale + lmscore.PRIOR * (uni[c][w] * scale + 1) / (total + size)) / (hist[c][h] * scale + lmscore.PRIOR)

    for flush, partitions in ((lmscore.FLUSH, "4"), (500, "40")):
        monkeypatch.setattr(lmscore, "FLUSH", flush)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = {r["doc_id"]: r["ce_diff"] for r in lmscore.score(docs(spark, [(k, t, "en") for k, t in texts.items()]), labels(spark, [(k, 1, 0) for k in target])).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        for k, text in texts.items():
            w = ["<s>", *words_of(text)]
            want = np.mean([np.log(p(0, total / uni[0].total(), h, x) / p(1, 1, h, x)) for h, x in zip(w, w[1:])])
            assert abs(got[k] - want) < 2e-6
        assert max(got[k] for k in target) < min(v for k, v in got.items() if k not in target)


def test_copies_of_any_length_leak(spark):
    """Verbatim copies of 5 to 500 words, among words of other items and far from the corpus's own."""
    sizes = [1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 33, 64, 65, 100, 180, 200, 230, 240, 260, 300, 400, 500, 1500]
    items = [(k, prose(70_000 + k, n)) for k, n in enumerate(sizes) if n >= 5] + [(k, f"only{k} " * n) for k, n in enumerate(sizes) if n < 5]
    rows = []
    for k, text in items:
        g = random.Random(k)
        others = [w for i, t in items for w in t.split() if i != k and len(t) < 5000]
        rows.append((k, " ".join([*g.choices(others, k=301 + k), text, *g.choices(others, k=300)]), "en"))
        rows.append((100 + k, prose(80_000 + k, 213 + k) + " " + text, "en"))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs(spark, rows), bench(spark, items)).collect()}
    assert {(k, k) for k, _ in items} | {(100 + k, k) for k, _ in items} <= set(got)
    long = {k for k, n in enumerate(sizes) if n >= 20}
    assert all(got[k + d, k]["lcs_share"] > 0.99 for k in long for d in (0, 100))
    assert {(d, k) for d, k in got if k in long} == {(k + d, k) for k in long for d in (0, 100)}
    kept = decontaminate.keep(docs(spark, [*rows, (999, prose(5), "en")]), bench(spark, [x for x in items if x[0] in long]))
    assert {r["doc_id"] for r in kept.collect()} & {k + d for k in long for d in (0, 100)} == set()


def test_unknown_latin_languages_and_junk_are_rejected(spark):
    rows = [(k, prose(k, 150, lang), lang) for k, lang in enumerate(["en", "de"] * 60)] + [(200 + k, prose(200 + k, 150, lang), None) for k, lang in enumerate(["en", "de"] * 10)]
    g = random.Random(4)
    other = [(1000 + k, " ".join("".join(g.choice("que les ez oui aux ble ont eur ais pas".split()) for _ in range(g.choice([1, 1, 2, 3, 4]))) for _ in range(150)), None) for k in range(20)]
    junk = [(2000 + k, " ".join("".join(g.choices("abcdefghijklmnopqrstuvwxyz", k=g.randint(2, 9))) for _ in range(150)), None) for k in range(20)]
    got = {r["doc_id"]: r["rejected"] for r in langid.identify(docs(spark, rows + other + junk)).collect()}
    assert all(v for k, v in got.items() if k >= 1000)
    assert not any(v for k, v in got.items() if k < 200) and sum(v for k, v in got.items() if 200 <= k < 1000) <= 1
    kept = langid.keep(docs(spark, rows + other + junk))
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if not v}
    unlabelled = docs(spark, [(k, t, None) for k, t, _ in rows])
    assert langid.keep(unlabelled).count() == len(rows) and not any(r["rejected"] for r in langid.identify(unlabelled).collect())


def test_pipeline_bounds_what_workers_hold(spark, monkeypatch):
    """Batches are bounded by bytes, and a tokeniser goes from a worker that has turned to other work."""
    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 16)
    rows = docs(spark, [(k, prose(k, 400), "en") for k in range(200)]).coalesce(1)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        assert corpus_pipeline.tokenize(spark, rows, "").filter("round_trip").count() == 200
        sizes = common.map_arrow(rows.select("text"), lambda b: iter([{"n": [b.nbytes]}]), "n long").collect()
    finally:
        spark.conf.set(name, before)
    assert max(r["n"] for r in sizes) < 1 << 17
    codec = bpe.Codec.of(bpe.DEFAULT_TOKENIZER)
    common.tidy()
    assert bpe.Codec.of(bpe.DEFAULT_TOKENIZER) is codec
    common.tidy()
    common.tidy()
    assert bpe.Codec.of(bpe.DEFAULT_TOKENIZER) is not codec


def test_latent_space_is_that_of_all_passages(spark, monkeypatch):
    """Words beside the benchmark's are counted in all passages, and far passages enter the space by their cosine."""
    monkeypatch.setattr(decontaminate, "RANK", 16)
    g = random.Random(5)
    items = [(k, " ".join(f"item{k}n{i}" if i % 2 else f"all{g.randrange(60)}" for i in range(40))) for k in range(30)]
    rows = []
    for k in range(240):
        own = items[k % 30][1].split()
        if k % 3 == 0:  # near
            rows.append((k, " ".join([*own[:24], *(f"beside{g.randrange(300)}" for _ in range(20))]), "en"))
        else:  # far, with words that stand beside the benchmark's
            rows.append((k, " ".join(g.choices(own, k=2) + [f"all{g.randrange(60)}" for _ in range(6)] + [f"beside{g.randrange(300)}" for _ in range(9)] + [f"far{k}n{i}" for i in range(150)]), "en"))
    lot = next(decontaminate.read_items(decontaminate.passages(bench(spark, items))))
    space = decontaminate.prepare(docs(spark, rows), lot).space
    w = next(x for _, _, x in kernel.each_chunk(pa.array([t for _, t, _ in rows])))
    every = [w.full[i : min(i + 64, y)] for x, y in zip(w.ptr, w.ptr[1:]) for i in range(x, y, 64)]
    df, size = Counter(h for p in every for h in set(p.tolist())), len(lot.vocab)
    total = len(every) + len(items)
    extra = space.vocab[size:].tolist()
    assert len(extra) > 100 and (space.weight[size:] > 0).all()
    for h, weight in zip(extra, space.weight[size:]):
        assert abs(weight - (np.log((1 + total) / (1 + df[h])) + 0.01)) < 1e-9
    own = [lot.words[k][a:b] for k, a, b in lot.passages()]
    plain = decontaminate.Space(lot.vocab, space.weight[:size])
    near = (dense(plain, every, len(every)) @ dense(plain, own, len(own)).T).max(1)
    share = np.minimum(near / decontaminate.NEAR, 1) ** decontaminate.FADE
    assert share[near < decontaminate.NEAR].sum() > 0.01 * share.sum()
    x = dense(space, [*own, *every], len(own) + len(every))
    x[len(own) :] *= np.sqrt(share * len(own) / share.sum())[:, None]
    best = (np.linalg.svd(x, compute_uv=False)[:16] ** 2).sum()
    assert space.basis.shape[1] == 16 and 0.97 * best <= ((x @ space.basis) ** 2).sum() <= 1.0001 * best


def test_words_of_the_space_come_from_all_passages(spark, monkeypatch):
    """Words that no near passage has are in the space and counted; where there are too many, those whose passages weigh most."""
    g = random.Random(8)
    items = [(k, " ".join(f"item{k}n{i}" for i in range(40))) for k in range(20)]
    rows = []
    for k in range(120):
        own = items[k % 20][1].split()
        beside = [f"near{g.randrange(40)}" for _ in range(8)] if k % 3 == 0 else [f"away{g.randrange(40)}" for _ in range(8)]
        rows.append((k, " ".join([*g.sample(own, 20 if k % 3 == 0 else 1), *beside, *(f"fill{g.randrange(60)}" for _ in range(30))]), "en"))
    rows.append((500, " ".join(f"gone{i % 3}" for i in range(300)), "en"))
    lot = next(decontaminate.read_items(decontaminate.passages(bench(spark, items))))
    words = [f"{kind}{i}" for kind in ("near", "away", "fill", "gone") for i in range(60)]
    w = next(x for _, _, x in kernel.each_chunk(pa.array([" ".join(words)])))
    name = dict(zip(w.full.tolist(), words))
    df = Counter(x for _, t, _ in rows[:-1] for x in set(t.split())) + Counter({f"gone{i}": 5 for i in range(3)})
    space = decontaminate.prepare(docs(spark, rows), lot).space
    away = {x for x, y in df.items() if x.startswith("away") and 3 <= y <= decontaminate.COMMON_LEAST}
    assert len(away) > 20 and away <= {name[x] for x in space.vocab[len(lot.vocab) :].tolist()}
    for step in (1 << 20, 50):  # the second hands words on before the end
        monkeypatch.setattr(decontaminate, "_WORDS", step)
        extra, n, mass = decontaminate.beside(docs(spark, rows), lot, np.ones(len(lot.vocab)), 1000)
        got = {name[x]: int(y) for x, y in zip(extra.tolist(), n)}
        assert got == {x: y for x, y in df.items() if x in words and 3 <= y <= 50} and any(x.startswith("away") for x in got) and got["gone1"] == 5
        assert 40 < mass < 41
    monkeypatch.setattr(decontaminate, "EXTRA", 20)
    extra, _, _ = decontaminate.beside(docs(spark, rows), lot, np.ones(len(lot.vocab)), 1000)
    near = Counter(x for k, t, _ in rows if k % 3 == 0 for x in set(t.split()))
    least = min(near[name[x]] for x in extra.tolist())
    assert len(extra) == 20 and all(name[x] in got for x in extra.tolist()) and sum(near[x] > least for x in got) < 20


def test_nystrom_gives_the_leading_vectors_without_another_round():
    """From the last round alone, nearly what the small eigenproblem of one more round would hold; a rank that isn't full too."""
    g = np.random.default_rng(3)
    u = np.linalg.qr(g.normal(size=(300, 300)))[0]
    a = (u * (1 / (1 + np.arange(300)))) @ u.T
    q = np.linalg.qr(a @ np.linalg.qr(a @ g.normal(size=(300, 40)))[0])[0].astype(np.float32)
    v = decontaminate.nystrom(q, a @ q, 24)
    assert v.shape == (300, 24) and np.allclose(v.T @ v, np.eye(24), atol=1e-4)
    assert 0.995 * (1 / (1 + np.arange(24))).sum() <= np.trace(v.T @ a @ v)
    low = (u[:, :5] * np.arange(1, 6)) @ u[:, :5].T
    q = np.linalg.qr(low @ g.normal(size=(300, 40)))[0].astype(np.float32)
    v = decontaminate.nystrom(q, low @ q, 24)
    assert v.shape == (300, 5) and np.allclose(u[:, :5].T @ v @ v.T @ u[:, :5], np.eye(5), atol=1e-4)
