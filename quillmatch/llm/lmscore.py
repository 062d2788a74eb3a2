"""Cross-entropy difference: two matched bigram models over all words score every document.

The background model counts the words and bigrams of all documents, the target model those of the documents labelled of
quality 1; no word is left out or merged with others, so the counts grow with the corpus. Both are smoothed alike, with
``PRIOR`` counts of the unigram distribution, and the background's counts are scaled to the target's number of tokens,
so that a difference between the models comes from the texts and not from their sizes. A unigram distribution has one
more cell than there are distinct words, and more than ``WORDS`` always.

Counts are keyed by 61-bit hashes and go by ranges of them, as many as there are shuffle partitions, to sorted files in
the shared folder, which scoring maps; a folder that isn't mounted is copied once a worker. What occurs once isn't
written: every text that is scored was counted, so a bigram or word that isn't there is the text's own.

A document's score is the mean over its tokens of target loss minus background loss (natural log): below 0, it is more
like the target than like the corpus. A null or wordless text has no tokens and a null score. Rows of a repeated doc_id
count and score as they come. Contradicting labels of one doc_id count as quality 1. Without target documents both
models are the background's and all scores 0.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import filesystem, fold_arrow, map_arrow, result_path, tidy

WORDS, PRIOR = 4096, 100.0
#: Target doc_ids up to this number go to the workers as a sorted array; more are joined.
SHIP_IDS = 4_000_000
FLUSH, _SIZE = 2_000_000, 1 << 22
#: The last three bits of a key: what it counts, and (in what mappers send) whether in target documents.
BIGRAM, WORD, LAST, TARGET = (np.uint64(x) for x in (0, 2, 4, 1))
_HASH, _START = np.uint64(~7 & (1 << 64) - 1), np.uint64(0x5851F42D4C957F2D)


def marked(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """docs with doc_id, text and perhaps target, and the sorted target ids where they are few enough to ship."""
    ids = labels.filter("doc_id IS NOT NULL AND quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if ids.count() <= SHIP_IDS:
        return docs, np.sort(ids.toArrow().column("doc_id").to_numpy())
    return docs.join(ids.withColumn("target", F.lit(True)), "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False))), None


def targets(batch: pa.RecordBatch, ids: np.ndarray | None) -> np.ndarray:
    """Which rows are target documents."""
    if ids is None:
        return batch.column("target").to_numpy(zero_copy_only=False)
    there, own = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False), batch.column("doc_id").fill_null(0).to_numpy()
    return there & (ids[np.minimum(np.searchsorted(ids, own), len(ids) - 1)] == own) if len(ids) else np.zeros(len(own), bool)


def bigrams(w: K.Words) -> np.ndarray:
    """Key of each word with the one before it, or with the start of its text."""
    prev = np.empty_like(w.full)
    prev[1:] = w.full[:-1]
    prev[w.ptr[:-1][np.diff(w.ptr) > 0]] = _START
    return K.mix(prev * np.uint64(0x9E3779B97F4A7C15) + w.full) & _HASH | BIGRAM


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of n."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n[order], first)


def count(rows: DataFrame, target_ids: np.ndarray | None, path: str) -> Model:
    """Counts all words and bigrams of rows into files of sorted keys at path."""
    spark = rows.sparkSession
    bits = max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    shift = np.uint64(64 - bits)

    def send(parts: list) -> Iterator[pa.RecordBatch]:
        key, n = _summed(*(np.concatenate(x) for x in zip(*parts)))
        at = np.append(np.flatnonzero(np.append(True, key[1:] >> shift != key[:-1] >> shift)), len(key))
        for i in range(0, len(at) - 1, 64):
            own = [slice(a, b) for a, b in zip(at[i : i + 64], at[i + 1 : i + 65])]
            columns = [[int(key[s.start] >> shift) for s in own], [key[s].tobytes() for s in own], [n[s].tobytes() for s in own]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            is_target = targets(batch, target_ids)
            for i, j, w in K.each_chunk(batch.column("text"), _SIZE):
                if not len(w.full):
                    continue
                mark = np.repeat(is_target[i:j], np.diff(w.ptr)).astype(np.uint64)
                last = w.ptr[1:][np.diff(w.ptr) > 0] - 1
                word = w.full & _HASH | mark
                parts.append(np.unique(np.concatenate([bigrams(w) | mark, word | WORD, word[last] | LAST]), return_counts=True))
                held += len(parts[-1][0])
                if held > FLUSH:
                    yield from send(parts)
                    parts, held = [], 0
        if parts:
            yield from send(parts)
        tidy()

    def step(state: dict, batch: pa.RecordBatch) -> None:
        for bucket, key, n in zip(batch.column("bucket").to_pylist(), batch.column("key"), batch.column("n")):
            state[bucket].append((np.frombuffer(key.as_buffer(), np.uint64).copy(), np.frombuffer(n.as_buffer(), np.int64).astype(np.uint32)))

    def end(state: dict) -> Iterator[dict]:
        where, inner = filesystem(path)
        where.create_dir(inner, recursive=True)
        for bucket in sorted(state):
            key, n = (np.concatenate(x) for x in zip(*state.pop(bucket)))
            key, n = _summed(key, n.astype(np.int64))
            in_target = np.where(key & TARGET, n, 0)
            first = np.flatnonzero(np.append(True, key[1:] >> TARGET != key[:-1] >> TARGET))
            key, n, in_target = key[first] & ~TARGET, np.add.reduceat(n, first), np.add.reduceat(in_target, first)
            kind = key & np.uint64(6)
            word, last = kind == WORD, kind == LAST
            kept = (n > 1) | last
            for name, values in (("key", key[kept]), ("n", np.stack([n[kept], in_target[kept]], 1))):
                if name == "n" and int(values.max(initial=0)) < 1 << 32:
                    values = values.astype(np.uint32)
                temporary = f"{inner}/.{uuid.uuid4().hex}"
                with where.open_output_stream(temporary) as out:
                    np.save(out, values)
                where.move(temporary, f"{inner}/{bucket}.{name}.npy")
            yield {"bucket": [bucket], "words": [int(word.sum())], "n": [int(n[word].sum())], "target": [int(in_target[word].sum())], "texts": [int(n[last].sum())], "target_texts": [int(in_target[last].sum())]}

    sent = rows.mapInArrow(run, "bucket int, key binary, n binary").repartition(1 << bits, "bucket")
    made = fold_arrow(sent, lambda: defaultdict(list), step, end, "bucket int, words long, n long, target long, texts long, target_texts long").collect()
    return Model(path, bits, frozenset(r["bucket"] for r in made), *(sum(r[c] for r in made) for c in ("words", "n", "target", "texts", "target_texts")))


_open: dict[str, tuple[str, dict[int, tuple[np.ndarray, np.ndarray]]]] = {}


@dataclass
class Model:
    """Files of counts, and the numbers of distinct words, tokens and texts with words: of all and of the target."""

    path: str
    bits: int
    buckets: frozenset
    words: int
    n: int
    target: int
    texts: int
    target_texts: int

    def bucket(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of a range of keys, mapped."""
        if self.path not in _open:
            _open.clear()
            where, inner = filesystem(self.path)
            if not isinstance(where, fs.LocalFileSystem):
                own = tempfile.mkdtemp(prefix="quillmatch-")
                fs.copy_files(inner, own, source_filesystem=where, destination_filesystem=fs.LocalFileSystem())
                inner = own
            _open[self.path] = inner, {}
        inner, there = _open[self.path]
        if b not in there:
            there[b] = tuple(np.load(f"{inner}/{b}.{name}.npy", mmap_mode="r") for name in ("key", "n"))
        return there[b]

    def find(self, key: np.ndarray) -> np.ndarray:
        """For sorted keys, how often each occurs in all documents and in target documents; -1 where it isn't written."""
        out = np.full((len(key), 2), -1, np.int64)
        at = np.searchsorted(key >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(at)).tolist():
            own = key[at[b] : at[b + 1]]
            keys, n = self.bucket(b) if b in self.buckets else (key[:0], out[:0])
            if len(keys):
                row = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[row] == own
                out[at[b] : at[b + 1]][hit] = n[row[hit]]
        return out

    def difference(self, w: K.Words, is_target: np.ndarray) -> np.ndarray:
        """Target loss minus background loss of each word."""
        alone = np.stack([np.ones(len(w.full)), np.repeat(is_target, np.diff(w.ptr))], 1)

        def counts(key: np.ndarray, at: np.ndarray, otherwise: np.ndarray | float) -> np.ndarray:
            found = self.find(key)[at].astype(np.float64)
            return np.where(found < 0, otherwise, found)

        both = counts(*np.unique(bigrams(w), return_inverse=True), alone)
        words, at = np.unique(w.full & _HASH, return_inverse=True)
        uni = counts(words | WORD, at, alone)
        going_on = uni - counts(words | LAST, at, 0.0)
        before = np.empty_like(going_on)
        before[1:] = going_on[:-1]
        before[w.ptr[:-1][np.diff(w.ptr) > 0]] = self.texts, self.target_texts
        total = float(self.target or self.n)
        for x in (both, uni, before):
            if not self.target:
                x[:, 1] = x[:, 0]
            x[:, 0] *= total / max(self.n, 1)
        width = max(self.words, WORDS) + 1
        p = (both + PRIOR * (uni + 1) / (total + width)) / (before + PRIOR)
        return np.log(p[:, 0] / p[:, 1])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words and ce_diff of every row of docs."""
    rows, target_ids = marked(docs, labels)
    model = count(rows, target_ids, result_path(docs.sparkSession, "bigrams"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        is_target = targets(batch, target_ids)
        for i, j, w in K.each_chunk(batch.column("text"), _SIZE):
            n = np.diff(w.ptr)
            sums = np.concatenate([[0.0], np.cumsum(model.difference(w, is_target[i:j]))])
            mean = np.diff(sums[w.ptr]) / np.maximum(n, 1)
            yield {"doc_id": batch.column("doc_id").slice(i, j - i), "n_words": pa.array(n), "ce_diff": pa.array(np.round(mean, 6), mask=n == 0)}

    return map_arrow(rows, run, "doc_id long, n_words int, ce_diff double")
