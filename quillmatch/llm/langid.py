"""Language ID by nearest centroids of TF-IDF n-gram vectors, with distance-based rejection.

Features are the byte bigrams and trigrams of a text's folded words (anything between words is one blank), hashed
to 8192 cells; a cell weighs sqrt(count) * idf and vectors are normalised. Document frequencies are counted over
all documents. Each language gets several centroids by spherical k-means over at most ``PER_LANGUAGE`` labelled
documents of ``LANGUAGE_BYTES`` together (one at least; the only bounded step), where its documents are. A document takes the language of its nearest centroid by cosine.

Rejection: labelled documents that come out as labelled give, for each class of n-gram numbers (a factor of two), a
high quantile of their distances (``HIGH``) and a median absolute deviation; a document is rejected if it lies further
than their sum. The deviation counts 1 + ``FEW`` / n times for n documents, as few of them tell little of the tail and
have mostly been trained on. The limit is the data's own: there is no distance below which all is kept or beyond which all goes. A
class with under ``LEAST`` such documents takes the limit of the next smaller class that has them (limits are wider
there as a rule), and rejects nothing if there is none; if no class has them, all together make one limit.

A null or wordless text has no vector: language and distance are null and it is not rejected, as there is nothing
to go by. Rows without a language are classified like others and never used for training. Rows repeat as they come;
ties between centroids go to the first language in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut, fold_arrow, map_arrow, tidy

CELLS, CENTROIDS, PER_LANGUAGE, LANGUAGE_BYTES, ROUNDS = 1 << 13, 3, 500, 16 << 20, 8
HIGH, LEAST, CLASSES, FEW = 0.995, 20, 32, 150
_ROWS, _SIZE, _LONG = 256, 1 << 19, 1 << 21


def counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """n-gram counts of each text by cell."""
    n = len(off) - 1
    if n == 1 and len(buf) > _LONG:
        return sum(_counted(buf[a : b + 2], np.array([0, min(b + 2, len(buf)) - a]), b - a) for a, b in _parts(buf))
    return _counted(buf, off, len(buf))


def _parts(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``_LONG`` bytes that end at ASCII bytes, so no character is cut."""
    a = 0
    while a < len(buf):
        b = min(a + _LONG, len(buf))
        while b < len(buf) and buf[b] >= 0x80:
            b += 1
        yield a, b
        a = b


def _counted(buf: np.ndarray, off: np.ndarray, starts: int) -> np.ndarray:
    """Counts of the n-grams that begin before ``starts``."""
    n = len(off) - 1
    low, isw = K.fold(buf)
    s = np.where(isw, low, np.uint8(0x20)).astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(off))
    out = np.zeros(n * CELLS)
    for k in (2, 3):
        if len(s) < k:
            continue
        code = s[: len(s) - k + 1].copy()
        for x in range(1, k):
            code |= s[x : len(s) - k + 1 + x] << np.uint32(8 * x)
        blank = np.uint32(0x20202020 & ((1 << 8 * k) - 1))
        own = doc[: len(code)]
        keep = (np.arange(len(code)) < starts) & (own == doc[k - 1 :]) & ((code ^ blank) & np.uint32(0xFFFF) != 0)
        cell = (code * np.uint32(0x9E3779B1 + 0x7F4A7C2E * k & 0xFFFFFFFF)) >> np.uint32(32 - 13)
        out += np.bincount(own[keep] * CELLS + cell[keep], minlength=n * CELLS)
    return out.reshape(n, CELLS).astype(np.float32)


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(c) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.maximum(norm, 1e-12)[:, None]


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    buf, off = K.text_bytes(column)
    for i, j in K.chunks(off, _SIZE, _ROWS):
        yield i, j, counts(buf[off[i] : off[j]], off[i : j + 1] - off[i])


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The documents that have each cell, and how many documents there are."""

    def step(state: list, batch: pa.RecordBatch) -> None:
        for i, j, c in _pieces(batch.column("text")):
            state[0] += (c > 0).sum(0)
            state[1] += j - i

    def end(state: list) -> Iterator[dict]:
        yield {"cell": np.append(np.arange(CELLS), -1), "n": np.append(state[0], state[1])}

    rows = fold_arrow(docs.select(F.col("text").cast("string")), lambda: [np.zeros(CELLS, np.int64), 0], step, end, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(CELLS), 0
    for cell, n in rows:
        if cell < 0:
            total = n
        else:
            df[cell] = n
    return df, total


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from the rows furthest from those chosen so far."""
    chosen = [0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    c = x[chosen]
    for _ in range(ROUNDS):
        at = (x @ c.T).argmax(1)
        c = np.stack([x[at == i].sum(0) if (at == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
    return c.astype(np.float32)


class Model:
    """idf, centroids and the language of each."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str]):
        self.idf, self.centroids, self.langs = idf, centroids, langs

    def nearest(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest centroid, the cosine distance to it, and the number of n-grams."""
        n = c.sum(1)
        if not len(self.langs):
            return np.zeros(len(c), int), np.ones(len(c)), n
        sim = vectors(c, self.idf) @ self.centroids.T
        at = sim.argmax(1)
        return at, 1.0 - sim[np.arange(len(c)), at].astype(np.float64), n


def train(docs: DataFrame) -> Model:
    df, total = frequencies(docs)
    idf = (np.log((1 + total) / (1 + df)) + 0.05).astype(np.float32)
    there = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = there.select("doc_id", "lang", F.octet_length("text").alias("bytes")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= PER_LANGUAGE)
    some = some.withColumn("held", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("held") <= LANGUAGE_BYTES) | (F.col("rank") == 1)).select("doc_id", "lang").distinct()
    rows = there.join(F.broadcast(some), ["doc_id", "lang"])  # a bounded number of ids a language

    def centre(own: pa.Table) -> pa.Table:
        own = own.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        x = vectors(np.concatenate([c for _, _, c in _pieces(own.column("text").combine_chunks())]), idf)
        x = x[np.linalg.norm(x, axis=1) > 0]
        c = cluster(x, CENTROIDS) if len(x) else np.zeros((0, CELLS), np.float32)
        return pa.table({"lang": pa.array([own.column("lang")[0].as_py()] * len(c), pa.string()), "centroid": pa.array([r.tobytes() for r in c], pa.binary())})

    made = rows.groupBy("lang").applyInArrow(centre, "lang string, centroid binary").collect()
    found = sorted(((r["lang"], k, np.frombuffer(bytes(r["centroid"]), np.float32)) for k, r in enumerate(made)), key=lambda x: x[:2])
    return Model(idf, np.stack([c for _, _, c in found]) if found else np.zeros((0, CELLS), np.float32), [lang for lang, _, _ in found])


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, pred, distance and size (a class of n-gram numbers) of every row."""
    langs = np.array([*model.langs, None], object)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for i, j, c in _pieces(batch.column("text")):
            at, dist, n = model.nearest(c)
            none = n == 0
            at = np.where(none | (len(model.langs) == 0), len(model.langs), at)
            yield {"doc_id": batch.column("doc_id").slice(i, j - i), "lang": batch.column("lang").slice(i, j - i), "pred": pa.array(langs[at], pa.string()), "distance": pa.array(np.round(dist, 6), mask=none), "size": pa.array(size_class(n))}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")), run, "doc_id long, lang string, pred string, distance double, size int")


def size_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)), CLASSES - 1).astype(np.int32)


def limits(found: DataFrame) -> dict[int, float]:
    """The distance beyond which a document of each size class is rejected, from all documents that come out as labelled."""
    there = found.filter("distance IS NOT NULL AND pred = lang").select("size", "distance")

    def over(rows: DataFrame) -> dict[int, float]:
        mid = rows.groupBy("size").agg(F.percentile_approx("distance", F.array(F.lit(0.5), F.lit(HIGH)), 10000).alias("q"), F.count("*").alias("n"))
        off = rows.join(F.broadcast(mid), "size").groupBy("size", "q", "n").agg(F.percentile_approx(F.abs(F.col("distance") - F.col("q")[0]), 0.5, 10000).alias("mad"))
        return {r["size"]: (r["n"], r["q"][1] + r["mad"] * (1 + FEW / r["n"])) for r in off.collect()}

    each = over(there)
    own = {k: limit for k, (n, limit) in each.items() if n >= LEAST}
    if not own and each:
        own = {0: over(there.withColumn("size", F.lit(0)))[0][1]}
    return {k: own[max(x for x in own if x <= k)] for k in range(min(own, default=CLASSES), CLASSES)}


def _rejected(limit: dict[int, float]) -> F.Column:
    if not limit:
        return F.lit(False)
    cases = F.create_map([F.lit(x) for kv in sorted(limit.items()) for x in kv])
    return F.coalesce(F.col("distance") > cases[F.col("size")], F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, pred, distance and rejected of every row of docs."""
    found = cut(classify(docs, train(docs)))
    return found.select("doc_id", "pred", "distance", _rejected(limits(found)).alias("rejected"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with their columns as they are."""
    model = train(docs)
    limit = limits(classify(docs, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for i, j, c in _pieces(batch.column("text").cast(pa.string())):
                _, dist, n = model.nearest(c)
                far = np.array([limit.get(x, np.inf) for x in size_class(n).tolist()])
                ok[i:j] = (n == 0) | (np.round(dist, 6) <= far)
            yield batch.filter(pa.array(ok))
        tidy()

    return docs.mapInArrow(run, docs.schema)
