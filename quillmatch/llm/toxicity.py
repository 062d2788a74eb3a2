"""Toxicity by a convolutional text classifier trained in numpy, with thresholds calibrated by language.

A word's embedding is the sum of four hashed rows: the word and its first 4, 5 and 7 bytes, so inflected forms of a
stem share most of theirs. Filters one, two and three words wide slide over the text; the maximum of each filter
over the whole text, zeros behind it included, goes through a ReLU and a logistic layer.

Training takes at most ``TRAIN_TOXIC`` toxic and ``TRAIN_CLEAN`` clean labelled documents, of either at most half of those
there are and ``TRAIN_BYTES`` of text (one document at least), in the order of a hash of their ids. Thresholds come from every labelled document outside that sample: per language the score with the
best F1, or the pooled one where a language has fewer than ``LEAST`` toxic or clean labels. A document is toxic if
it scores its language's threshold or more.

A null or wordless text scores 0 and is not toxic. A null or unknown language takes the pooled threshold. Labels that
contradict each other for one doc_id count as toxic; rows whose doc_id is null are scored but never trained on. Without
labels of both kinds there is no model: all scores are 0. Rows repeat as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut, map_arrow, tidy

ROWS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 16, (1, 2, 3)
TRAIN_TOXIC, TRAIN_CLEAN, EPOCHS, BATCH, LEAST = 1000, 2000, 12, 32, 20
#: Share of the words that a step of training doesn't see, wherever they stand, so that the net learns each sign of toxicity
#: even where another stands beside it.
HIDE = 0.3
PREFIXES = (4, 5, 7)
PAD = max(WIDTHS) - 1
BINS = 10_000
TRAIN_BYTES = 64 << 20
#: Labelled doc_ids up to this number are broadcast, so that only their documents are scored for the thresholds; beyond it all are.
SHIP_LABELS = 2_000_000
#: Words of a text beyond which its parts are scored one after the other; bounds memory only.
LONG = 100_000
_SIZE = 1 << 17


def features(w: K.Words) -> np.ndarray:
    """Rows of the embedding table for each word: of itself and of its prefixes."""
    out = np.empty((1 + len(PREFIXES), len(w.full)), np.int32)
    for k, h in enumerate([w.full, *(w.prefix(n) for n in PREFIXES)]):
        out[k] = ((h * np.uint64(0x9E3779B97F4A7C15 + 2 * k)) >> np.uint64(64 - 15)).astype(np.int32)
    return out


class Net:
    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        self.emb = g.normal(0, 0.05, (ROWS, DIM)).astype(np.float32)
        self.conv = {w: g.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = g.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.out_bias = np.float32(0)

    def rows(self, feats: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedded words with PAD rows of zeros behind each text, and where each text begins in them."""
        n = np.diff(ptr)
        start = ptr[:-1] + PAD * np.arange(len(n))
        x = np.zeros((int(ptr[-1]) + PAD * len(n), DIM), np.float32)
        e = self.emb[feats[0]]
        for f in feats[1:]:
            e += self.emb[f]
        x[np.arange(ptr[-1]) + PAD * np.repeat(np.arange(len(n)), n)] = e
        return x, start

    def maps(self, x: np.ndarray) -> list[np.ndarray]:
        """Each width's filter responses at every word."""
        m = x @ np.concatenate([self.conv[w][k] for w in WIDTHS for k in range(w)], axis=1)
        out, at = [], 0
        for w in WIDTHS:
            z = m[:, at : at + FILTERS].copy()
            for k in range(1, w):
                z[:-k] += m[k:, at + k * FILTERS : at + (k + 1) * FILTERS]
            out.append(z)
            at += w * FILTERS
        return out

    def score(self, w: K.Words) -> np.ndarray:
        """The probability that each text is toxic; 0 for one without words."""
        n = np.diff(w.ptr)
        if not len(w.full):
            return np.zeros(len(n))
        feats = features(w)
        if len(w.full) > LONG and len(n) == 1:
            top = self.long_top(feats)[None]
        else:
            x, start = self.rows(feats, w.ptr)
            ranges = np.stack([start, start + n], axis=1).ravel()  # at the zeros behind a text, a filter would see the next one
            top = np.concatenate([np.maximum(np.maximum.reduceat(z, ranges, axis=0)[::2], 0) for z in self.maps(x)], axis=1)
        v = np.maximum(top + self.bias, 0) @ self.out + self.out_bias
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(v.astype(np.float64), -30, 30))), 0.0)

    def long_top(self, feats: np.ndarray) -> np.ndarray:
        """Maxima of one long text, a part at a time; parts overlap by what a filter spans."""
        total, tops = feats.shape[1], []
        for a in range(0, total, LONG):
            part = feats[:, a : a + LONG + PAD]
            x, _ = self.rows(part, np.array([0, part.shape[1]]))
            own = len(x) if a + LONG >= total else LONG
            tops.append(np.concatenate([z[:own].max(0) for z in self.maps(x)]))
        return np.max(tops, axis=0)

    def fit(self, texts: list[str], labels: np.ndarray) -> Net:
        """Adagrad on the logistic loss, both classes weighing the same."""
        g = np.random.default_rng(11)
        _, _, w = next(K.each_chunk(pa.array(texts, pa.large_string()), 1 << 62))
        feats, y = features(w), labels.astype(np.float32)
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        state = {k: np.full_like(v, 1e-3) for k, v in {"emb": self.emb, "bias": self.bias, "out": self.out, **{f"c{k}": v for k, v in self.conv.items()}}.items()}
        seen_bias = 1e-3
        size = np.diff(w.ptr)
        for epoch in range(EPOCHS):
            rate = 0.15 * (1 - epoch / EPOCHS) + 0.01
            order = g.permutation(np.flatnonzero(size > 0))
            for b in range(0, len(order), BATCH):
                pick = order[b : b + BATCH]
                f = feats[:, K.gather(w.ptr, pick)]
                ptr = np.concatenate([[0], np.cumsum(size[pick])])
                x, start = self.rows(f, ptr)
                at_word = np.arange(ptr[-1]) + PAD * np.repeat(np.arange(len(pick)), np.diff(ptr))
                seen = (g.random(ROWS) >= HIDE)[f[0]]
                x[at_word[~seen]] = 0
                maps = np.concatenate(self.maps(x), axis=1)
                arg = np.stack([maps[s : s + k].argmax(0) + s for s, k in zip(start, size[pick])])
                top = maps[arg, np.arange(maps.shape[1])]
                pre = np.maximum(top, 0) + self.bias
                act = np.maximum(pre, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.out_bias, -30, 30)))
                d = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                d_act = np.where(pre > 0, d[:, None] * self.out, 0)
                d_out, d_b = d @ act + 1e-4 * self.out, d.sum()
                d_bias = d_act.sum(0)
                d_act = np.where(top > 0, d_act, 0)
                word = np.full(len(x), -1)
                word[at_word[seen]] = np.flatnonzero(seen)
                rows, grads = [], []
                for i, width in enumerate(WIDTHS):
                    sl = slice(i * FILTERS, (i + 1) * FILTERS)
                    d_w = np.zeros_like(self.conv[width])
                    for k in range(width):
                        at = np.minimum(arg[:, sl] + k, len(x) - 1)
                        d_w[k] = np.einsum("nfd,nf->df", x[at], d_act[:, sl])
                        src, on = word[at].ravel(), (d_act[:, sl] != 0).ravel()
                        on &= src >= 0
                        rows.append(src[on])
                        grads.append((d_act[:, sl][..., None] * self.conv[width][k].T[None]).reshape(-1, DIM)[on])
                    state[f"c{width}"] += d_w**2
                    self.conv[width] -= rate * d_w / np.sqrt(state[f"c{width}"])
                src, grad = np.concatenate(rows), np.concatenate(grads)
                if len(src):
                    every, inverse = np.unique(f[:, src].ravel(), return_inverse=True)
                    total = np.zeros((len(every), DIM), np.float32)
                    np.add.at(total, inverse, np.tile(grad, (len(f), 1)))
                    state["emb"][every] += total**2
                    self.emb[every] -= rate * total / np.sqrt(state["emb"][every])
                state["bias"] += d_bias**2
                self.bias -= rate * d_bias / np.sqrt(state["bias"])
                state["out"] += d_out**2
                self.out -= rate * d_out / np.sqrt(state["out"])
                seen_bias += d_b**2
                self.out_bias -= rate * d_b / np.sqrt(seen_bias)
        return self


def known(labels: DataFrame) -> DataFrame:
    """doc_id and toxic (0 or 1) of what is labelled, one row each."""
    there = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    return there.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def sample(docs: DataFrame, labels: DataFrame) -> dict[int, int]:
    """The doc_ids to train on, with their labels; empty unless there are both kinds."""
    there = docs.filter("text IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("bytes")).join(known(labels), "doc_id")
    there = cut(there)
    total = {r["toxic"]: r["n"] for r in there.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    out: dict[int, int] = {}
    for kind, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        if not total.get(kind):
            return {}
        own = there.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(min(most, -(-total[kind] // 2))).collect()
        held = 0
        for r in own:
            held += r["bytes"]
            if held > TRAIN_BYTES and r is not own[0]:
                break
            out[r["doc_id"]] = kind
    return out


def train(docs: DataFrame, labels: DataFrame) -> tuple[Net | None, list[int]]:
    """The net, and the doc_ids it was trained on."""
    some = sample(docs, labels)
    if not some:
        return None, []
    ids = docs.sparkSession.createDataFrame(list(some.items()), "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").join(F.broadcast(ids), "doc_id")  # as many ids as the bound, at most
    rows = texts.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return Net().fit(rows.column("text").to_pylist(), rows.column("toxic").to_numpy()), sorted(some)


def scores(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, lang and score of every row."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "score": score_column(batch.column("text"), net)}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")), run, "doc_id long, lang string, score double")


def score_column(text: pa.Array, net: Net | None) -> np.ndarray:
    out = np.zeros(len(text))
    if net is not None:
        for i, j, w in K.each_chunk(text, _SIZE):
            out[i:j] = np.round(net.score(w), 6)
    return out


def best_threshold(score_bin: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> float:
    """The score with the best F1 among counted bins; of several, the highest. Midway to the next lower bin."""
    order = np.argsort(-score_bin, kind="stable")
    b, t, n = score_bin[order], toxic[order], n[order]
    hit, all_ = np.cumsum(np.where(t == 1, n, 0)), np.cumsum(n)
    last = np.append(b[1:] != b[:-1], True)
    f1 = np.where(last, 2 * hit / (all_ + max(hit[-1], 1)), -1)
    k = int(f1.argmax())
    below = b[k + 1] if k + 1 < len(b) else 0
    return float(b[k] + below) / 2 / BINS


def thresholds(scored: DataFrame, labels: DataFrame, trained: list[int]) -> tuple[dict[str, float], float]:
    """By language, and pooled; from all labelled documents that weren't trained on."""
    used = scored.sparkSession.createDataFrame([(x,) for x in trained], "doc_id long")
    counted = (
        scored.select("doc_id", "lang", F.round(F.col("score") * BINS).cast("int").alias("bin")).join(known(labels), "doc_id").join(used, "doc_id", "left_anti")
        .groupBy("lang", "bin", "toxic").agg(F.count("*").alias("n")).collect()
    )
    if not any(r["toxic"] == 1 for r in counted):
        return {}, 0.5
    cols = lambda rows: tuple(np.array([r[c] for r in rows]) for c in ("bin", "toxic", "n"))
    pooled, by = best_threshold(*cols(counted)), {}
    for lang in {r["lang"] for r in counted} - {None}:
        own = [r for r in counted if r["lang"] == lang]
        if all(sum(r["n"] for r in own if r["toxic"] == t) >= LEAST for t in (0, 1)):
            by[lang] = best_threshold(*cols(own))
    return by, pooled


def _limit(by: dict[str, float], pooled: float) -> F.Column:
    if not by:
        return F.lit(pooled)
    return F.coalesce(F.create_map([F.lit(x) for kv in sorted(by.items()) for x in kv])[F.col("lang")], F.lit(pooled))


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, score and toxic of every row of docs."""
    net, trained = train(docs, labels)
    scored = cut(scores(docs, net))
    by, pooled = thresholds(scored, labels, trained)
    return scored.select("doc_id", "lang", "score", ((F.col("score") >= _limit(by, pooled)) & (F.col("score") > 0)).alias("toxic"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not toxic, with their columns as they are."""
    net, trained = train(docs, labels)
    ids = cut(known(labels).select("doc_id"))
    few = docs.join(F.broadcast(ids), docs["doc_id"].cast("long") == ids["doc_id"], "left_semi") if ids.count() <= SHIP_LABELS else docs
    by, pooled = thresholds(scores(few, net), labels, trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score_column(batch.column("text").cast(pa.string()), net)
            limit = np.array([by.get(x, pooled) for x in batch.column("lang").to_pylist()])
            yield batch.filter(pa.array((s < limit) | (s <= 0)))
        tidy()

    return docs.mapInArrow(run, docs.schema)
