"""Benchmark decontamination by latent semantic retrieval with subsequence and answer checks.

1. Over all documents, cut into passages of 64 words, the document frequencies of the benchmark's words.
2. Every passage of the corpus has a cosine with the nearest benchmark passage, of TF-IDF vectors of the benchmark's words
   (items of over 64 words are cut into passages of equal length, 64 words at most). From ``NEAR`` on it weighs 1, and
   (cosine / NEAR) ** FADE below. All words of all passages are counted: in how many passages each is, and what these weigh.
   The space has, besides the benchmark's words, those that weigh most and are in three passages at least; ``EXTRA`` bounds
   its memory.
3. A distributed randomised SVD of the TF-IDF matrix of the benchmark's passages and of all the corpus's, its rows normalised.
   The corpus's passages have these weights, and all together as much as the benchmark's. (With equal weights the largest
   directions are the corpus's own frequent words, in which a benchmark passage is hardly visible.) Its rank is ``RANK`` or two thirds of the benchmark's passages, whichever is less, so it keeps what
   passages have in common and merges words that stand for each other. In each round over the rows a partition adds its
   x (x . Omega), whose range is Q; then its x (x . Q), ``POWERS`` times in all; the right singular vectors are those of
   the Nystrom approximation from the last round, whose range is what one more round would start from.
4. Every window of 32 words (items of 32 words or fewer) or 64 words (longer items), each overlapping the next by
   half, is projected and compared with every benchmark passage by cosine in the latent space. ``COSINE`` or more makes
   a candidate, if ``WITHIN`` of the window's weight lies in the space. Items of up to 16, 8 and 4 words are compared with
   windows of so many words too, as they are a small part of 32. Wherever the pair of adjoining words that weighs most in
   an item occurs, there is a candidate as well, so that an exact copy is found whatever its neighbours are; it is a
   leak by ``VERBATIM`` alone. (So is an item of a single word, wherever it occurs.)
5. A candidate's surroundings, twice the window or the item, whichever is longer, are compared with the whole item by
   longest common subsequence of words. It is a leak if the subsequence covers ``VERBATIM`` of the item, or
   ``PARAPHRASE`` of it and the answer check holds: the item's last words (a fifth, four at least) occur in order, but
   for a quarter of them.

Items go through in lots of about ``LOT`` passages, each with a space of its own. So what a worker or the driver holds is
bounded however large the benchmark is: a table of at most 64 * LOT + EXTRA words by RANK floats, 107 MB, and three times
as much on the driver while it solves (a lot holds one item at least, which may be longer). Words in over ``COMMON`` of the
passages (and over 20 passages) have no weight; an item all of whose words are that common keeps them. Null or wordless
texts and items have no leaks. Several rows of one doc_id count as one document with the best find of them; rows with a
null doc_id give rows with a null doc_id. Items that repeat are each reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut, fold_arrow, gather_arrow, map_arrow, tidy

PASSAGE, BLOCK, RANK, OVERSAMPLE, POWERS, LOT = 64, 16, 96, 16, 3, 4096
NEAR, EXTRA, EXTRA_LEAST, WITHIN, FADE = 0.3, 1 << 14, 3, 0.05, 8
COSINE, VERBATIM, PARAPHRASE, ANSWER = 0.5, 0.75, 0.55, 0.75
COMMON, COMMON_LEAST = 0.05, 20
_SIZE, _CELLS, _WORDS, _UNIT, OFTEN = 1 << 19, 512, 1 << 20, 1 << 30, 1 << 8
_MATRIX = "n binary, row binary, factor binary"


@dataclass
class Items:
    """Benchmark items: ids, words as hashes, and the sorted vocabulary of them all."""

    ids: list
    words: list[np.ndarray]
    vocab: np.ndarray

    def index(self) -> K.HashIndex:
        return index_of(self.vocab)

    def passages(self) -> list[tuple[int, int, int]]:
        """(item, begin, end) of each passage."""
        return [(k, a, b) for k, h in enumerate(self.words) for a, b in zip(cuts(len(h)), cuts(len(h))[1:])]


def index_of(vocab: np.ndarray) -> K.HashIndex:
    index = K.HashIndex()
    index.add(vocab)
    return index


def cuts(n: int) -> list[int]:
    """Where the passages of an item of n words begin and end."""
    parts = -(-n // PASSAGE)
    return [n * i // max(parts, 1) for i in range(parts + 1)]


def passages(benchmark: DataFrame) -> DataFrame:
    """item_id, text and lot of the items with a text."""
    there = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = there.agg(F.sum(F.ceil((F.length("text") + 1) / (6 * PASSAGE)))).first()[0] or 0  # about so many passages
    h = F.xxhash64("item_id", "text")
    lots = -(-n // LOT) or 1
    return there.withColumn("lot", F.pmod(h, F.lit(lots)).cast("int"))


def read_items(rows: DataFrame) -> Iterator[Items]:
    """Each lot; one is on the driver at a time."""
    for (lot,) in rows.select("lot").distinct().orderBy("lot").collect():
        part = rows.filter(F.col("lot") == lot).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        ids, own = [], []
        names = part.column("item_id").to_pylist()
        for i, j, w in K.each_chunk(part.column("text").combine_chunks()):
            for k in range(j - i):
                h = w.full[w.ptr[k] : w.ptr[k + 1]]
                if len(h):
                    ids.append(names[i + k])
                    own.append(h)
        if ids:
            yield Items(ids, own, np.unique(np.concatenate(own)))


def _tokens(w: K.Words, index: K.HashIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of the vocabulary: vocabulary row, position in all words, position in its text."""
    row = index.find(w.full)
    at = np.flatnonzero(row >= 0)
    doc = np.searchsorted(w.ptr, at, side="right") - 1
    return row[at], at, at - w.ptr[doc]


def frequencies(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many passages each word of the vocabulary is, and how many passages there are; the items included."""
    size = len(items.vocab)

    def start() -> list:
        return [items.index(), np.zeros(size, np.int64), 0]

    def step(state: list, batch: pa.RecordBatch) -> None:
        for _, _, w in K.each_chunk(batch.column("text")):
            per = -(-np.diff(w.ptr) // PASSAGE)
            state[2] += int(per.sum())
            row, at, inside = _tokens(w, state[0])
            doc = np.searchsorted(w.ptr, at, side="right") - 1
            base = np.cumsum(per) - per
            key = np.unique((base[doc] + inside // PASSAGE) * size + row)
            state[1] += np.bincount(key % size, minlength=size)

    def end(state: list) -> Iterator[dict]:
        yield {"word": np.append(np.arange(size), -1), "n": np.append(state[1], state[2])}

    rows = fold_arrow(docs.select(F.col("text").cast("string")), start, step, end, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(size), len(items.ids)
    for word, n in rows:
        if word < 0:
            total += n
        else:
            df[word] = n
    for h in items.words:
        df[np.unique(np.searchsorted(items.vocab, h))] += 1
    return df, total


class Nearness:
    """Exact TF-IDF cosines of passages with the nearest benchmark passage."""

    def __init__(self, items: Items, weight: np.ndarray):
        mine = items.passages()
        self.size, self.weight = len(mine), weight
        terms = [np.unique(np.searchsorted(items.vocab, items.words[k][a:b]), return_counts=True) for k, a, b in mine]
        norm = np.array([np.sqrt(max(float(((n * weight[r]) ** 2).sum()), 1e-9)) for r, n in terms])
        word, passage = np.concatenate([r for r, _ in terms]), np.repeat(np.arange(self.size), [len(r) for r, _ in terms])
        value = np.concatenate([n for _, n in terms]) * weight[word] ** 2 / norm[passage]
        order = np.argsort(word, kind="stable")
        self.passage, self.value = passage[order].astype(np.int64), value[order]
        self.ptr = np.searchsorted(word[order], np.arange(len(weight) + 1))
        #: Bytes of text to take at a time, as there is a number for each passage of the text and of the benchmark.
        self.bytes = max(1 << 14, min(_SIZE, (1 << 28) // self.size))

    def cosines(self, which: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
        """Of ``size`` passages, from the passage and the vocabulary row of each word that weighs something."""
        pair, n = np.unique(which * len(self.weight) + row, return_counts=True)
        return self.counted(pair // len(self.weight), pair % len(self.weight), n, size)

    def counted(self, which: np.ndarray, row: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
        """The same, from how often each word is in each passage."""
        square = np.bincount(which, (n * self.weight[row]) ** 2, minlength=size)
        often = self.ptr[row + 1] - self.ptr[row]
        post = K.gather(self.ptr, row)
        key = np.repeat(which, often) * self.size + self.passage[post]
        dot = np.bincount(key, self.value[post] * np.repeat(n, often), minlength=size * self.size).reshape(-1, self.size).max(1)
        return dot / np.sqrt(np.maximum(square, 1e-9))

    def shares(self, which: np.ndarray, row: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
        """What passages weigh in the space."""
        return np.minimum(self.counted(which, row, n, size) / NEAR, 1.0) ** FADE if len(row) else np.zeros(size)


def _placed(w: K.Words, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages of each text, the first of each, and the passage of each of some words."""
    per = -(-np.diff(w.ptr) // PASSAGE)
    base = np.cumsum(per) - per
    return per, base, base[np.searchsorted(w.ptr, at, side="right") - 1] + inside // PASSAGE


def near_passages(docs: DataFrame, items: Items, weight: np.ndarray) -> DataFrame:
    """words (hashes, as bytes) of the corpus passages near a benchmark passage, by exact TF-IDF cosine. For small comparisons;
    prepare() goes by all passages."""
    nearness = Nearness(items, weight)
    state: list = []

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        if not state:
            state.append(items.index())
        for _, _, w in K.each_chunk(batch.column("text"), nearness.bytes):
            row, at, inside = _tokens(w, state[0])
            on = weight[row] > 0
            row, at, inside = row[on], at[on], inside[on]
            if not len(row):
                continue
            per, base, which = _placed(w, at, inside)
            near = np.flatnonzero(nearness.cosines(which, row, int(per.sum())) >= NEAR)
            owner = np.repeat(np.arange(len(per)), per)[near]
            begin = w.ptr[owner] + (near - base[owner]) * PASSAGE
            end = np.minimum(begin + PASSAGE, w.ptr[owner + 1])
            yield {"words": [w.full[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist())]}

    return map_arrow(docs.select(F.col("text").cast("string")), run, "words binary")


def beside(docs: DataFrame, items: Items, weight: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The words that the space has besides the benchmark's: of all words of all passages, the ``EXTRA`` whose passages weigh
    most together (then those in most passages). Also in how many passages each is, and what all passages weigh."""
    nearness = Nearness(items, weight)

    def start() -> list:
        return [items.index(), K.HashIndex(), [], np.zeros(0, np.int64), np.zeros(0, np.int64), 0]

    def step(state: list, batch: pa.RecordBatch) -> Iterator[dict]:
        own, index = state[:2]
        for _, _, w in K.each_chunk(batch.column("text"), nearness.bytes):
            if index.n > _WORDS:
                yield from end(state)
                own, index = state[:2]
            if not len(w.full):
                continue
            per, _, which = _placed(w, np.arange(len(w.full)), np.arange(len(w.full)) - np.repeat(w.ptr[:-1], np.diff(w.ptr)))
            size = int(per.sum())
            row = own.find(w.full)
            on = (row >= 0) & (weight[row] > 0)
            pair, n = np.unique(which[on] * len(weight) + row[on], return_counts=True)
            share = np.round(nearness.shares(pair // len(weight), pair % len(weight), n, size) * _UNIT).astype(np.int64)  # sums of integers are repeatable
            state[5] += int(share.sum())
            h, which = w.full[row < 0], which[row < 0]
            code = index.find(h)
            new = np.unique(h[code < 0])
            if len(new):
                index.add(new)
                state[2].append(new)
                code = index.find(h)
                if index.n > len(state[3]):
                    state[3], state[4] = (np.append(x, np.zeros(index.n, np.int64)) for x in state[3:5])
            pair = np.sort(code.astype(np.int64) * size + which)  # faster than np.unique
            pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
            code, which = pair // size, pair % size
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, int)
            state[3][code[first]] += np.diff(np.append(first, len(code)))
            state[4][code[first]] += np.add.reduceat(share[which], first) if len(first) else 0

    def end(state: list) -> Iterator[dict]:
        words = np.concatenate([*state[2], np.zeros(0, np.uint64)]).view(np.int64)
        yield {"word": words, "n": state[3][: len(words)], "mass": state[4][: len(words)]}
        yield {"word": pa.array([None], pa.int64()), "n": [0], "mass": [state[5]]}
        state[:] = start()

    counted = gather_arrow(docs.select(F.col("text").cast("string")), start, step, end, "word long, n long, mass long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))
    most = max(COMMON * total, COMMON_LEAST)
    best = counted.filter(F.col("word").isNull() | F.col("n").between(EXTRA_LEAST, most)).orderBy(F.expr("word IS NOT NULL"), F.desc("mass"), F.desc("n"), "word").limit(EXTRA + 1)
    t = best.toArrow()
    if not t.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0), 0.0
    word, n, mass = (t.column(c).combine_chunks() for c in ("word", "n", "mass"))
    return word[1:].to_numpy().view(np.uint64), n[1:].to_numpy().astype(np.float64), mass[0].as_py() / _UNIT


def all_passages(docs: DataFrame, items: Items, weight: np.ndarray, space: Space) -> DataFrame:
    """The corpus's rows of the matrix, as matrix() gives them; a passage that weighs nothing has none."""
    nearness = Nearness(items, weight)
    state: list = []

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        if not state:
            state.append(index_of(space.vocab))
        for _, _, w in K.each_chunk(batch.column("text"), nearness.bytes):
            row, at, inside = _tokens(w, state[0])
            on = space.weight[row] > 0
            row, at, inside = row[on], at[on], inside[on]
            per, _, which = _placed(w, at, inside)
            yield from _block(which, row, int(per.sum()), space, nearness)

    return map_arrow(docs.select(F.col("text").cast("string")), run, _MATRIX)


def _block(which: np.ndarray, row: np.ndarray, n: int, space: Space, nearness: Nearness | None = None) -> Iterator[dict]:
    """One row of matrix(), of n passages, from the passage and the row of each word that weighs something."""
    size = len(space.vocab)
    key = np.sort(which.astype(np.int64) * size + row)
    if not len(key):
        return
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    times = np.diff(np.append(first, len(key)))
    owner, word = key[first] // size, key[first] % size
    factor = 1 / np.maximum(np.bincount(owner, (times * space.weight[word]) ** 2, minlength=n), 1e-9)
    if nearness:
        mine = word < len(nearness.weight)
        factor *= nearness.shares(owner[mine], word[mine], times[mine], n)
    count = np.bincount(key // size, minlength=n)
    there = (count > 0) & (factor > 0)
    row = (key % size)[np.repeat(there, count)].astype(np.int32)
    if len(row):
        yield {"n": [count[there].astype(np.int32).tobytes()], "row": [row.tobytes()], "factor": [factor[there].astype(np.float32).tobytes()]}


def matrix(near: DataFrame, space: Space) -> DataFrame:
    """Passages (words: hashes, as bytes) as rows of the TF-IDF matrix, some hundred at a time: how many words of the space
    each has, their rows, and the square of what a row is multiplied by, 1 / norm and the root of the passage's weight."""
    state: list = []

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        if not state:
            state.append(index_of(space.vocab))
        flat, n = _flat(batch.column("words"))
        end = np.cumsum(n)
        for i in range(0, len(n), 1024):
            j = min(i + 1024, len(n))
            yield from _block(*_weighing(state[0], space, flat[end[i] - n[i] : end[j - 1]], n[i:j]), j - i, space)

    return map_arrow(near, run, _MATRIX)


def _weighing(index: K.HashIndex, space: Space, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage and row of the words that weigh something."""
    row = index.find(flat)
    on = (row >= 0) & (space.weight[row] > 0)
    return np.repeat(np.arange(len(n)), n)[on], row[on]


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a column of passages, and how many each has."""
    texts = [x.as_buffer() for x in words]
    return np.frombuffer(b"".join(texts), np.uint64), np.array([len(x) // 8 for x in texts], np.int64)


def extra_words(near: DataFrame, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of passages that the benchmark lacks, and in how many of these passages each is."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        flat, n = _flat(batch.column("words"))
        new = vocab[np.minimum(np.searchsorted(vocab, flat), len(vocab) - 1)] != flat
        if new.any():
            word, code = np.unique(flat[new], return_inverse=True)
            once = np.unique(np.repeat(np.arange(len(n)), n)[new] * len(word) + code)
            yield {"word": word.view(np.int64), "n": np.bincount(once % len(word), minlength=len(word))}

    counted = map_arrow(near, run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= EXTRA_LEAST)
    rows = counted.orderBy(F.desc("n"), "word").limit(EXTRA).collect()
    return np.array([r["word"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.float64)


def products(rows: DataFrame, items: Items, space: Space, right: np.ndarray, scale: float) -> np.ndarray:
    """Sum of x (x . right) over the rows x of the corpus's matrix, times scale, and of the benchmark's."""
    size, width = right.shape
    weighted = (right * space.weight[:, None]).astype(np.float32)
    # the words that most passages have go through dense products, the others one by one
    often = np.argsort(np.where(space.weight > 0, space.weight, np.inf), kind="stable")[:OFTEN]
    column = np.full(size, -1, np.int32)
    column[often] = np.arange(len(often))
    weighted_often = weighted[often]

    def add(z: np.ndarray, n: np.ndarray, row: np.ndarray, factor: np.ndarray) -> None:
        owner, place = np.repeat(np.arange(len(n)), n), column[row]
        much = place >= 0
        dense = np.bincount(owner[much] * len(often) + place[much], minlength=len(n) * len(often)).astype(np.float32).reshape(len(n), -1)
        y = dense @ weighted_often
        owner, row = owner[~much], row[~much]
        if len(owner):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            y[owner[first]] += _segment_sums(weighted, row, first)
        y *= factor[:, None]
        if len(owner):
            key = np.sort(row.astype(np.int64) * len(n) + owner)
            row, owner = key // len(n), key % len(n)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            z[row[first]] += _segment_sums(y, owner, first)
        z[often] += dense.T @ y

    def start() -> list:
        return [np.zeros((size, width), np.float32)]

    def step(state: list, batch: pa.RecordBatch) -> None:
        for n, row, factor in zip(*(batch.column(c) for c in ("n", "row", "factor"))):
            add(state[0], np.frombuffer(n.as_buffer(), np.int32), np.frombuffer(row.as_buffer(), np.int32), np.frombuffer(factor.as_buffer(), np.float32))

    def parts(state: list) -> Iterator[dict]:
        at = [i for i in range(0, size, _CELLS) if state[0][i : i + _CELLS].any()]
        for k in range(0, len(at), 16):
            yield {"part": at[k : k + 16], "z": [state[0][i : i + _CELLS].tobytes() for i in at[k : k + 16]]}

    def merge(state: dict, batch: pa.RecordBatch) -> None:
        for part, z in zip(batch.column("part").to_pylist(), batch.column("z").to_pylist()):
            state[part] = state.get(part, 0) + np.frombuffer(z, np.float32)

    def merged(state: dict) -> Iterator[dict]:
        for part, z in state.items():
            yield {"part": [part], "z": [z.tobytes()]}

    out = np.zeros((size, width), np.float32)
    few = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)  # as each task sends a table of its own
    partial = fold_arrow(few, start, step, parts, "part int, z binary")
    for part, z in fold_arrow(partial.repartition("part"), dict, merge, merged, "part int, z binary").collect():
        out[part : part + _CELLS] = np.frombuffer(bytes(z), np.float32).reshape(-1, width)
    out *= np.float32(scale)
    mine, index = items.passages(), index_of(space.vocab)
    for i in range(0, len(mine), 1024):
        part = [items.words[k][a:b] for k, a, b in mine[i : i + 1024]]
        for block in _block(*_weighing(index, space, np.concatenate(part), np.array([len(x) for x in part])), len(part), space):
            add(out, *(np.frombuffer(block[c][0], t) for c, t in (("n", np.int32), ("row", np.int32), ("factor", np.float32))))
    return out * space.weight[:, None].astype(np.float32)


@dataclass
class Space:
    """Words (the benchmark's first), their weights, and the right singular vectors, a row for each word."""

    vocab: np.ndarray
    weight: np.ndarray
    basis: np.ndarray | None = None


def latent(near: DataFrame, n_near: float, items: Items, space: Space) -> np.ndarray:
    """Right singular vectors of the TF-IDF matrix of the benchmark's passages and of others, which weigh n_near together:
    passages as words, or rows of their matrix."""
    rows = cut(near if "row" in near.columns else matrix(near, space))
    n = len(items.passages())
    rank = min(RANK, max(1, 2 * n // 3))
    scale = n / n_near if n_near else 0.0
    omega = np.random.default_rng(5).normal(size=(len(space.vocab), min(len(space.vocab), rank + OVERSAMPLE))).astype(np.float32)
    q = omega
    for k in range(POWERS):
        y = products(rows, items, space, q, scale).astype(np.float64)
        if k < POWERS - 1:
            q, r = np.linalg.qr(y)
            q = np.ascontiguousarray(q[:, np.abs(np.diag(r)) > 1e-5 * max(float(np.abs(r).max()), 1e-30)]).astype(np.float32)
    return nystrom(q, y, rank)


def nystrom(q: np.ndarray, y: np.ndarray, rank: int) -> np.ndarray:
    """The leading eigenvectors of a, from y = a . q: those of y (q' . y)^-1 y', which has the range of y."""
    c = q.astype(np.float64).T @ y
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    on = values > 1e-6 * max(float(values.max(initial=0.0)), 1e-30)
    left, size, _ = np.linalg.svd(y @ (vectors[:, on] / np.sqrt(values[on])), full_matrices=False)
    return np.ascontiguousarray(left[:, :rank][:, size[:rank] ** 2 > 1e-9], np.float32)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit vectors over a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = masks.get(x)
        if m is not None:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def check(item: np.ndarray, region: np.ndarray) -> tuple[float, bool]:
    """The share of the item that occurs in order, and whether its answer does."""
    answer = item[-max(4, len(item) // 5) :]
    return lcs(item, region) / len(item), lcs(answer, region) >= ANSWER * len(answer)


def is_leak(share: float, answer: bool) -> bool:
    return share >= VERBATIM or (share >= PARAPHRASE and answer)


def _segment_sums(table: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of table[rows[first[i]:first[i+1]]]; the segments are short, so all k-th rows are added at once."""
    size = np.diff(np.append(first, len(rows)))
    order = np.argsort(-size, kind="stable")
    at, left = first[order], size[order]
    acc = table[rows[at]]
    for k in range(1, int(left[0])):
        n = int(np.searchsorted(-left, -k, side="left"))
        acc[:n] += table[rows[at[:n] + k]]
    out = np.empty_like(acc)
    out[order] = acc
    return out


class Search:
    """What a worker needs to look for some items: projected words and passages."""

    def __init__(self, items: Items, space: Space):
        self.items, self.space = items, space
        self.index, self.candidates = None, 0
        rows = [np.searchsorted(items.vocab, h) for h in items.words]
        self.square = (space.weight**2).astype(np.float32)
        self.live = space.weight > 0
        self.table = (space.basis * space.weight[:, None]).astype(np.float32)
        mine = items.passages()
        m = np.array([self.table[rows[k][a:b]].sum(0) for k, a, b in mine], np.float32).reshape(len(mine), self.table.shape[1])
        m /= np.maximum(np.linalg.norm(m, axis=1), 1e-9)[:, None]
        self.first = {k: m[i] for i, (k, a, _) in enumerate(mine) if a == 0}
        #: By words in a block: blocks in a window, passages, and their vectors.
        self.groups: dict[int, list] = {}
        for step, blocks, least, most in ((BLOCK, 4, 2 * BLOCK, 1 << 62), (BLOCK, 2, 0, 2 * BLOCK), (8, 2, 0, 16), (4, 2, 0, 8), (2, 2, 0, 4)):
            at = np.array([i for i, (k, _, _) in enumerate(mine) if least < len(items.words[k]) <= most], int)
            if len(at):
                self.groups.setdefault(step, []).append((blocks, [mine[i] for i in at], m[at]))
        # of each item, the pair of adjoining words that weighs most, or its only word
        pairs = []
        for k, r in enumerate(rows):
            o = int((space.weight[r[:-1]] + space.weight[r[1:]]).argmax()) if len(r) > 1 else 0
            pairs.append((int(r[o]) * (len(self.live) + 1) + (int(r[o + 1]) if len(r) > 1 else len(self.live)), k, o))
        self.pairs = sorted(pairs)
        self.pair = np.array([x for x, _, _ in self.pairs], np.int64)
        #: Rows of the words that begin a pair, and of those that are one.
        self.begins, self.alone = np.zeros((2, len(self.live) + 1), bool)
        first, second = np.divmod(self.pair, len(self.live) + 1)
        self.begins[first], self.alone[first[second == len(self.live)]] = True, True

    def _copies(self, w: K.Words, row: np.ndarray, at: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, where it would begin in the text) wherever an item's pair of words occurs."""
        size = len(self.live) + 1
        follows = np.flatnonzero(self.begins[row[:-1]] & (at[1:] == at[:-1] + 1) & (inside[1:] > 0))
        alone = np.flatnonzero(self.alone[row])
        for i, key in ((follows, row[follows].astype(np.int64) * size + row[follows + 1]), (alone, row[alone].astype(np.int64) * size + size - 1)):
            lo, hi = np.searchsorted(self.pair, key), np.searchsorted(self.pair, key, side="right")
            for x in np.flatnonzero(hi > lo).tolist():
                d = int(np.searchsorted(w.ptr, at[i[x]], side="right")) - 1
                for _, k, o in self.pairs[lo[x] : hi[x]]:
                    yield d, k, int(inside[i[x]]) - o

    def _cosine(self, k: int, words: np.ndarray) -> float:
        """Of the item's first passage, with as many of these words."""
        row = self.index.find(words[: cuts(len(self.items.words[k]))[1]])
        x = self.table[row[row >= 0]].sum(0)
        return float(x @ self.first[k]) / max(float(np.linalg.norm(x)), 1e-9)

    def find(self, w: K.Words) -> dict[tuple[int, int], tuple[float, float, bool]]:
        """(text, item) to cosine, share and answer, of the best window that is a leak."""
        self.index = self.index or index_of(self.space.vocab)
        row, at, inside = _tokens(w, self.index)
        n = np.diff(w.ptr)
        out: dict[tuple[int, int], tuple[float, float, bool]] = {}
        done = set()
        copies = list(self._copies(w, row, at, inside)) if len(row) else []
        on = self.live[row]
        row, at, inside = row[on], at[on], inside[on]

        def compare(d: int, k: int, lo: int, hi: int) -> tuple[float, bool]:
            return check(self.items.words[k], w.full[w.ptr[d] + max(0, lo) : w.ptr[d] + min(int(n[d]), hi)])

        for step, groups in sorted(self.groups.items()) if len(row) else ():
            per = -(-n // step) + 3  # three empty blocks behind each text, so that windows never reach the next
            base = np.cumsum(per) - per
            own = np.repeat(base, n)[at] + inside // step
            owner = np.repeat(np.arange(len(n)), per)
            squares = np.bincount(own, self.square[row], minlength=int(per.sum())).astype(np.float32)
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sums = np.zeros((len(squares), self.table.shape[1]), np.float32)
            sums[own[first]] = _segment_sums(self.table, row, first)
            last = len(squares) - 1
            for blocks, which, m in groups:
                some = np.zeros(len(squares) + blocks, bool)  # a place for each start, those before the first text at the end
                for k in range(blocks):
                    some[own[first] - k] = True
                start = np.flatnonzero(some[: len(squares)])
                start = start[owner[start] == owner[np.minimum(start + blocks - 1, last)]]
                if blocks == 4:
                    start = start[(start - base[owner[start]]) & 1 == 0]
                for part in np.array_split(start, -(-len(start) // 8192) or 1):
                    x, full = sums[part].copy(), squares[part].copy()
                    for k in range(1, blocks):
                        x += sums[np.minimum(part + k, last)]
                        full += squares[np.minimum(part + k, last)]
                    inner = np.einsum("ij,ij->i", x, x)
                    there = inner >= WITHIN * full
                    part, x = part[there], x[there] / np.sqrt(np.maximum(inner[there], 1e-9))[:, None]
                    cos = x @ m.T
                    for r, c in np.argwhere(cos >= COSINE).tolist():
                        (k, offset, _), d = which[c], int(owner[part[r]])
                        a = int(part[r] - base[d]) * step
                        size = len(self.items.words[k])
                        if size > PASSAGE:
                            near = (d, k, (a - offset) // max(BLOCK, size // 8))
                            if near in done:
                                continue
                            done.add(near)
                            room = max(PASSAGE, size // 2)
                            share, answer = compare(d, k, a - offset - room, a - offset + size + room)
                        else:
                            share, answer = compare(d, k, a - blocks * step // 2, a + blocks * step * 3 // 2)
                        self.candidates += 1
                        if is_leak(share, answer):
                            new = (share, round(min(1.0, float(cos[r, c])), 3), answer)
                            if (d, k) not in out or new > out[d, k]:
                                out[d, k] = new
        for d, k, a in copies:
            size = len(self.items.words[k])
            if (d, k) not in out:
                share, answer = compare(d, k, a - size // 2, a + size + size // 2)
                if share >= VERBATIM:
                    words = w.full[w.ptr[d] + max(0, a) : w.ptr[d] + min(int(n[d]), a + size)]
                    out[d, k] = (share, round(min(1.0, self._cosine(k, words)), 3), answer)
        return {key: (c, s, a) for key, (s, c, a) in out.items()}


def prepare(docs: DataFrame, items: Items) -> Search:
    df, total = frequencies(docs, items)
    weight = np.log((1 + total) / (1 + df)) + 0.01
    common = (df > COMMON * total) & (df > COMMON_LEAST)
    for h in items.words:  # an item of common words only keeps them
        row = np.searchsorted(items.vocab, h)
        if common[row].all():
            common[row] = False
    weight = np.where(common, 0.0, weight)
    extra, n, mass = beside(docs, items, weight, total)
    space = Space(np.concatenate([items.vocab, extra]), np.concatenate([weight, np.log((1 + total) / (1 + n)) + 0.01]))
    space.basis = latent(all_passages(docs, items, weight, space), mass, items, space)
    return Search(items, space)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share and answer of every document and item that it leaks."""
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer boolean"
    found = None
    for items in read_items(passages(benchmark)):
        search = prepare(docs, items)

        def run(batch: pa.RecordBatch, search: Search = search) -> Iterator[dict]:
            ids = batch.column("doc_id").to_pylist()
            for i, _, w in K.each_chunk(batch.column("text"), _SIZE):
                hits = search.find(w)
                if hits:
                    yield {
                        "doc_id": pa.array([ids[i + d] for d, _ in hits], pa.int64()), "item_id": pa.array([search.items.ids[k] for _, k in hits], pa.int64()),
                        "cosine": [c for c, _, _ in hits.values()], "lcs_share": [round(s, 6) for _, s, _ in hits.values()], "answer": [a for _, _, a in hits.values()],
                    }

        part = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("lcs_share", "cosine", "answer")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.lcs_share", "b.answer")


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item, with their columns as they are."""
    out = docs
    for items in read_items(passages(benchmark)):
        search = prepare(docs, items)

        def run(batches: Iterator[pa.RecordBatch], search: Search = search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = np.ones(batch.num_rows, bool)
                for i, _, w in K.each_chunk(batch.column("text").cast(pa.string()), _SIZE):
                    ok[[i + d for d, _ in search.find(w)]] = False
                yield batch.filter(pa.array(ok))
            tidy()

        out = out.mapInArrow(run, docs.schema)
    return out
