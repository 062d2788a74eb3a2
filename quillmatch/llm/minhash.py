"""MinHash near-duplicates: universal hash minima, banding, signature verification, alternating star components.

A document's shingles are its runs of three words (fewer words: all of them at once; see ``kernel``). Its
signature has 128 minima of multiply-shift universal hashes; 32 bands of 4 minima give the keys under which
documents meet. Two that meet are near duplicates if half of their minima agree or more. Within a key all members
are compared (each is reached from the others by a search over the verified relation, so a group of like documents
costs one pass however large it is); keys with the same members are compared once. Groups are the connected
components of the verified pairs, by alternating large-star and small-star steps with a checkpoint after each.

A key that more than ``HOT`` nodes share goes in parts of about so many: each part with three leaders of the key, which
link what is like them across parts; then what isn't in the key's largest component yet is compared with all its nodes,
in blocks. The links are those of comparing all, and no task holds more than two parts.

Documents with one signature are one node until the end, so thousands of exact copies cost no comparisons.
A text that is null or has no words has no signature and no duplicates. Rows of one doc_id are one document, whatever
their texts, and link what each of them is like. Rows without doc_id are documents by their text; they link others and are
deduplicated too, but have no name under which ``groups`` could list them. There are no ties: the smallest doc_id is a
group's own, and rows that repeat are ordered by all their columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import cut, map_arrow

MINIMA, BANDS, SHINGLE, AGREE = 128, 32, 3, 0.5
#: Ids up to this number are broadcast; more are joined by shuffles.
BROADCAST_IDS = 2_000_000
#: Nodes of a key beyond which it goes in parts.
HOT = 4096
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2)
_STEP = 1 << 15


def minima(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """For each text with shingles, the minima of its shingles' hashes: (a * x + b) mod 2**64 >> 32, x of 32 bits."""
    x = h >> np.uint64(32)
    out = np.empty((len(ptr) - 1, MINIMA), np.uint32)
    i = 0
    while i < len(ptr) - 1:  # texts that fit a buffer in cache; a longer one alone, in parts
        j = max(i + 1, int(np.searchsorted(ptr, ptr[i] + _STEP, side="right")) - 1)
        own = x[ptr[i] : ptr[j]]
        if j == i + 1 and len(own) > _STEP:
            best = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
            for p in range(0, len(own), _STEP):
                part = own[p : p + _STEP]
                best = np.minimum(best, [((part * a + b) >> np.uint64(32)).min() for a, b in zip(_A, _B)])
            out[i] = best
        else:
            t, at = np.empty_like(own), (ptr[i:j] - ptr[i]).astype(np.int64)
            high = t.view(np.uint32)[1::2]
            for k in range(MINIMA):
                np.multiply(own, _A[k], out=t)
                np.add(t, _B[k], out=t)
                out[i:j, k] = np.minimum.reduceat(high, at)
        i = j
    return out


def named(docs: DataFrame) -> tuple[Column, Column]:
    """Two longs that name a row's document: its doc_id and 0, or 0 and a hash of its text where it has none."""
    text = F.xxhash64(F.col("text").cast("string"))
    none = F.col("doc_id").isNull()
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.when(none, F.when(text == 0, 1).otherwise(text)).otherwise(0)


def signatures(docs: DataFrame) -> DataFrame:
    """id and own (see ``named``), node (hash of the signature), sig (128 minima, 16 bits of each) and bands (keys) of rows with words."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for i, j, w in K.each_chunk(batch.column("text")):
            h, ptr = K.shingles(w, SHINGLE)
            some = np.flatnonzero(np.diff(ptr) > 0)
            if not len(some):
                continue
            m = minima(h, np.append(ptr[some], len(h)))
            keys = np.zeros((len(m), BANDS), np.uint64)
            for k in range(MINIMA // BANDS):
                keys = K.mix(keys * np.uint64(0x9E3779B97F4A7C15) + m.reshape(len(m), BANDS, -1)[:, :, k])
            keys += np.arange(BANDS, dtype=np.uint64)
            keys = K.mix(keys)
            node = keys.copy()
            for k in range(1, BANDS):
                node[:, 0] = K.mix(node[:, 0] * np.uint64(0x9E3779B97F4A7C15) + keys[:, k])
            sig = K.mix(m.astype(np.uint64)).astype(np.uint16)
            yield {
                "id": batch.column("id").slice(i, j - i).take(pa.array(some)),
                "own": batch.column("own").slice(i, j - i).take(pa.array(some)),
                "node": pa.array(node[:, 0].view(np.int64)),
                "sig": pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * MINIMA), len(m), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary()),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel())),
            }

    ident, own = named(docs)
    rows = docs.select(ident.alias("id"), own.alias("own"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    return map_arrow(rows, run, "id long, own long, node long, sig binary, bands array<long>")


def tie(sig: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, row) that span the components of "half of the minima agree" among the rows of sig."""
    pairs, left = [], np.arange(len(sig))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            like = np.concatenate([(sig[left[p : p + 8192]] == sig[at]).mean(1) >= AGREE for p in range(0, len(left), 8192)])
            pairs += [(at, x) for x in left[like]]
            front += left[like].tolist()
            left = left[~like]
    return pairs


def verified(sigs: DataFrame) -> DataFrame:
    """Edges (u, v), u < v, that span the verified pairs of nodes."""
    nodes = cut(sigs.groupBy("node").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands")))  # one signature has the same bands everywhere
    met = nodes.select(F.explode("bands").alias("key"), "node")
    size = F.count("*").alias("n")
    hot = cut(met.groupBy("key").agg(size).filter(F.col("n") > HOT))
    if not hot.count():
        return spanning(_cold(met), nodes)
    hot_keys = F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot
    first = spanning(_cold(met.join(hot_keys.select("key"), "key", "left_anti")), nodes)
    return first.unionByName(_hot(met.join(hot_keys, "key"), nodes, first)).distinct()


def _cold(met: DataFrame) -> DataFrame:
    """meeting and node: members of the keys that several nodes share, those of equal keys once."""
    meet = (
        met.groupBy("key").agg(F.collect_set("node").alias("members"))  # HOT at most
        .filter(F.size("members") > 1).select(F.array_sort("members").alias("members"))
        .groupBy(F.xxhash64("members").alias("meeting")).agg(F.first("members").alias("members"))
    )
    return meet.select("meeting", F.explode("members").alias("node"))


def _hot(met: DataFrame, nodes: DataFrame, first: DataFrame) -> DataFrame:
    """Edges among the nodes of hot keys (key, node, n), given the edges that others have found."""
    h = F.xxhash64("node")
    leaders = F.array_distinct(F.array(F.min("node"), F.max("node"), F.min_by("node", h)))
    keys = met.groupBy("key").agg(F.first("n").alias("n"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h)).alias("y"), leaders.alias("leaders"))
    keys = cut(keys.groupBy("n", "x", "y").agg(F.min(F.struct("key", "leaders")).alias("k")).select("k.key", "k.leaders", F.ceil(F.col("n") / HOT).cast("int").alias("parts")))
    few = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    part = lambda of: F.pmod(F.xxhash64("node", F.lit(7)), F.col(of)).cast("int")
    own = cut(met.select("key", "node").join(few.select("key", "parts"), "key"))
    lead = keys.select("key", F.explode("leaders").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = own.select("key", "node", part("parts").alias("part")).unionByName(lead.select("key", "node", "part")).distinct()
    inner = cut(spanning(rows.select(F.xxhash64("key", "part").alias("meeting"), "node"), nodes))
    roots = components(first.unionByName(inner))
    label = F.coalesce("root", "node").alias("label")
    labelled = cut(own.join(roots, "node", "left").select("key", "node", "parts", label))
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    left = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("labels")).filter("labels > 1")
    left = cut(left.select("key", F.col("top.label").alias("most"), F.ceil((F.col("all") - F.col("top.n")) / HOT).cast("int").alias("blocks")))
    if not left.count():
        return inner
    # every node outside a key's largest component against all nodes of the key, in blocks
    there = labelled.join(F.broadcast(left) if left.count() <= BROADCAST_IDS else left, "key")
    rest = there.filter("label <> most").select("key", "node", "label", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"))
    every = there.select("key", "node", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part("parts").alias("part"), F.lit(False).alias("asks"))
    both = rest.unionByName(every).select(F.xxhash64("key", "block", "part").alias("meeting"), "node", "label", "asks")
    return inner.unionByName(across(both, nodes))


def across(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from nodes that ask to nodes of their meeting with another label, one to each such label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking: list[tuple] = []
        now = None
        for b in batches:
            g, n, label = (b.column(c).to_numpy() for c in ("meeting", "node", "label"))
            asks = b.column("asks").to_numpy(zero_copy_only=False)
            s = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(len(g), MINIMA)
            at = np.flatnonzero(np.append(True, g[1:] != g[:-1])).tolist() if len(g) else []
            for x, y in zip(at, [*at[1:], len(g)]):
                if g[x] != now:
                    now, asking = g[x], []
                asking += [(n[k], label[k], s[k].copy()) for k in range(x, y) if asks[k]]  # they come first
                other = np.arange(x, y)[~asks[x:y]]
                u, v = [], []
                for node, own, sig in asking if len(other) else ():
                    hit = other[(label[other] != own) & ((s[other] == sig).mean(1) >= AGREE)]
                    if len(hit):
                        _, one = np.unique(label[hit], return_index=True)
                        u += [node] * len(one)
                        v += n[hit[one]].tolist()
                if u:
                    u, v = np.array(u, np.int64), np.array(v, np.int64)
                    yield pa.record_batch({"u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v))})

    joined = rows.join(nodes.select("node", "sig"), "node").select("meeting", "node", "label", "asks", "sig")
    return joined.repartition("meeting").sortWithinPartitions("meeting", F.desc("asks"), "node").mapInArrow(run, "u long, v long").distinct()


def spanning(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges (u, v), u < v, that span the verified pairs of nodes with a meeting in common."""
    sorted_rows = rows.join(nodes.select("node", "sig"), "node").select("meeting", "node", "sig").repartition("meeting").sortWithinPartitions("meeting", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close(g: np.ndarray, n: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
            size = np.diff(np.append(at, len(g)))
            two = at[size == 2]
            two = two[(s[two] == s[two + 1]).mean(1) >= AGREE] if len(two) else two
            u, v = [n[two]], [n[two + 1]]
            for a, k in zip(at[size > 2], size[size > 2]):
                pairs = np.array(tie(s[a : a + k]), np.int64).reshape(-1, 2) + a
                u.append(n[pairs[:, 0]])
                v.append(n[pairs[:, 1]])
            x, y = np.concatenate(u), np.concatenate(v)
            yield pa.record_batch({"u": pa.array(np.minimum(x, y)), "v": pa.array(np.maximum(x, y))})

        for b in batches:
            g, n = b.column("meeting").to_numpy(), b.column("node").to_numpy()
            if not len(g):
                continue
            s = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(len(g), MINIMA)
            cutoff = int(np.searchsorted(g, g[-1]))  # the last meeting may go on in the next batch
            if cutoff:
                kept.append((g[:cutoff], n[:cutoff], s[:cutoff]))
                yield from close(*(np.concatenate(x) for x in zip(*kept)))
                kept = []
            kept.append((g[cutoff:], n[cutoff:], s[cutoff:]))
            if len(kept) > 1 and kept[0][0][0] != g[-1]:
                done = [k for k in kept if k[0][0] != g[-1]]
                yield from close(*(np.concatenate(x) for x in zip(*done)))
                kept = [k for k in kept if k[0][0] == g[-1]]
        if kept:
            yield from close(*(np.concatenate(x) for x in zip(*kept)))

    return sorted_rows.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node of the edges (u, v)."""
    now = cut(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).filter("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = cut(small)
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots


def placed(docs: DataFrame) -> DataFrame:
    """id, own and root of every document with words: those of one root are near duplicates, or linked by such."""
    sigs = cut(signatures(docs))
    documents = sigs.groupBy("id", "own").agg(F.min("node").alias("node"), F.max("node").alias("top"))
    several = documents.filter("node <> top").select("id", "own", F.col("node").alias("u"))  # one document of several texts
    same = sigs.join(several, ["id", "own"]).filter("node <> u").select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v"))
    roots = components(verified(sigs).unionByName(same))
    return documents.join(roots, "node", "left").select("id", "own", F.coalesce("root", "node").alias("root"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id and rep_id (the smallest doc_id of its group) of every document that has a near duplicate."""
    there = placed(docs).filter("own = 0").select(F.col("id").alias("doc_id"), "root")
    sizes = there.groupBy("root").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("n")).filter("n > 1")
    return there.join(sizes, "root").select("doc_id", "rep_id")


def _small(df: DataFrame) -> tuple[DataFrame, int]:
    """A written copy of a table of ids, with a broadcast hint if it is small enough, and its number of rows."""
    kept = cut(df)
    n = kept.count()
    return (F.broadcast(kept) if n <= BROADCAST_IDS else kept), n


def _fresh(docs: DataFrame, n: int) -> list[str]:
    """Names that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    return [c for c in (f"_{k}" for k in range(n + len(taken))) if c not in taken][:n]


def _ordered(docs: DataFrame) -> list[Column]:
    """The columns by which rows can be put in order."""
    def can(t: T.DataType) -> bool:
        return can(t.elementType) if isinstance(t, T.ArrayType) else all(can(f.dataType) for f in t.fields) if isinstance(t, T.StructType) else not isinstance(t, (T.MapType, T.VariantType))

    return [F.col(f"`{f.name}`") for f in docs.schema if can(f.dataType)]


def dedup(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: the one of the smallest doc_id, or where none has one, of the smallest hash
    of its text. Of several rows of one kept document and text the first in the order of all columns stays; rows without
    words, or without text, stay as they are."""
    ident, own, rank = _fresh(docs, 3)
    there = cut(placed(docs))
    rep = F.min(F.struct(F.col("own") != 0, "id", "own")).alias("r")
    reps = there.groupBy("root").agg(rep, F.count("*").alias("n")).filter("n > 1").select("root", F.col("r.id").alias("rep"), F.col("r.own").alias("rep_own"))
    gone, _ = _small(there.join(reps, "root").filter("id <> rep OR own <> rep_own").select(F.col("id").alias(ident), F.col("own").alias(own)))
    a, b = named(docs)
    kept = docs.withColumn(ident, a).withColumn(own, b)
    repeated = kept.filter("text IS NOT NULL").groupBy(ident, own).agg(F.count("*").alias("n")).filter("n > 1").select(ident, own)
    repeated, again = _small(repeated)
    kept = kept.join(gone, [ident, own], "left_anti")
    if not again:
        return kept.select(docs.columns)
    w = Window.partitionBy(ident, own, "text").orderBy(*_ordered(docs))
    once = kept.join(repeated, [ident, own], "left_semi").withColumn(rank, F.row_number().over(w)).filter((F.col(rank) == 1) | F.col("text").isNull())
    return kept.join(repeated, [ident, own], "left_anti").select(docs.columns).unionByName(once.select(docs.columns))
