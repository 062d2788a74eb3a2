"""Source texts as normalised tokens, and k-grams of them, by one ordered regular expression in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..arrow import small_batches
from ..functions import tokenbytes as B
from ..functions.names import canonical

ALIASES = {"i8": "byte", "u8": "ubyte", "i16": "short", "u16": "ushort", "shortarray": "vecshort", "arrayvec": "vec"}
KGRAM = 5
_ALIAS_BYTES = {k.encode(): v.encode() for k, v in ALIASES.items()}
#: Most hashes that are sent to all workers; beyond, texts meet them by a join.
KNOWN = 1 << 20
#: Most repeated keys that are sent to all executors, and terms that a worker gathers before it hands them on.
REPEATED, GATHERED = 1 << 20, 1 << 18
_OPERATORS = r"::|\?\.|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%="
_RAW = {"rust": r'|\bb?r"[^"]*"|\bb?r#"(?s:.*?)"#'}
_TICKS = {"kotlin": r"|`[^`]*`?"}


def pattern(lang: str = "", any_sign: str = r"\S") -> str:
    """Comments, raw strings, quoted names, strings, numbers, names, operators, signs - the first that fits."""
    life = r"'[_A-Za-z][0-9A-Za-z_]*(?!')|" if lang == "rust" else ""
    strings = r'"[^"\\]*+(?:\\[^\n][^"\\]*+)*+"?|' + life + r"'[^'\\]*+(?:\\[^\n][^'\\]*+)*+'?"
    return r"//[^\n]*|/\*(?s:.*?)(?:\*/|\z)" + _RAW.get(lang, "") + _TICKS.get(lang, "") + "|" + strings + r"|[0-9][A-Za-z0-9_.]*|[_A-Za-z][0-9A-Za-z_]*|" + _OPERATORS + "|" + any_sign


def tokens(text: Column, lang: str = "", non_ascii: str = "bytes") -> Column:
    """The tokens of a text: strings as "str", numbers after "num:", names canonical, path signs as "." and arrows as
    "arrow". Each byte outside ASCII is a token of its own, or none with ``non_ascii="drop"``. Null for null."""
    return F.filter(F.transform(raw_tokens(text, lang, non_ascii), lambda t: normal(t, lang)), lambda t: t != "")


def raw_tokens(text: Column, lang: str = "", non_ascii: str = "bytes") -> Column:
    """The tokens of a text as they stand, in order."""
    if non_ascii == "bytes":
        text, sign = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), r"\S"
    else:
        sign = "[!-~]"
    return F.regexp_extract_all(text, F.lit(f"({pattern(lang, sign)})"), 1)


def normal(t: Column, lang: str = "") -> Column:
    """A token as it counts; empty for what doesn't. Cases are told by the first sign, without patterns."""
    first = F.substring(t, 1, 1)
    quoted = first.isin('"', "'")
    if lang == "rust":
        quoted = (quoted & ~t.rlike(r"^'[_A-Za-z][0-9A-Za-z_]*$")) | t.rlike(r'^b?r#*"')
    ident = canonical(F.replace(t, F.lit("`"), F.lit("")) if lang == "kotlin" else t)
    aliased = ident
    for name, alias in ALIASES.items():
        aliased = F.when(ident == name, alias).otherwise(aliased)
    is_name = first.between("A", "Z") | first.between("a", "z") | first.isin("_", "`")
    skipped = ((first == "/") & (t.startswith("//") | t.startswith("/*"))) | t.isin(";", "@", "#")
    cases = F.when(is_name & ~quoted, F.when(ident.isin(*ALIASES), aliased).otherwise(ident)).when(quoted, "str").when(first == "'", "").when(first.between("0", "9"), F.concat(F.lit("num:"), t))
    return cases.when(skipped, "").when(t.isin("::", "?."), ".").when(t.isin("->", "=>"), "arrow").otherwise(t)


def _runs(tokens: Column, k: int, run: Callable[[Column], Column], kind: str) -> Column:
    n = F.size(tokens)
    grams = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), run)
    return F.when(n == 0, F.array().cast(f"array<{kind}>")).otherwise(F.array_distinct(grams))


def kgrams(tokens: Column, k: int = KGRAM) -> Column:
    """Distinct runs of k tokens, as text; of fewer tokens, one run of them all; of none, none."""
    return _runs(tokens, k, lambda i: F.array_join(F.slice(tokens, i + 1, k), "\u0001"), "string")


def kgram_hashes(tokens: Column, k: int = KGRAM) -> Column:
    """The same runs as 64-bit hashes, which take a quarter of the bytes of a shuffle and no text. ``tokens`` is a column
    that exists: an expression would be worked out anew at every run."""
    return _runs(tokens, k, lambda i: F.xxhash64(*(F.get(tokens, i + j) for j in range(k))), "bigint")


def exploded(units: DataFrame, terms: Column, *keys: str, lang: str | None = None) -> DataFrame:
    """keys, term and its count n in each unit; with ``lang``, of raw tokens, which become terms after they are taken
    apart, in generated code, and not within an array."""
    rows = units.select(*keys, F.explode(terms).alias("term"))
    if lang is not None:
        rows = rows.select(*keys, normal(F.col("term"), lang).alias("term")).filter("term <> ''")
    return rows.groupBy(*keys, "term").agg(F.count("*").alias("n"))


def kgram_rows(units: DataFrame, key: str, known: np.ndarray | None = None) -> DataFrame:
    """key and g of units (key, text): the hash of each run of KGRAM tokens that a text has, none of fewer tokens; with
    ``known`` (sorted, as signed numbers), of those hashes alone. The runs are of ``tokens``, from bytes."""
    small_batches(units.sparkSession)
    seen = None
    if known is not None:
        known = known.astype(np.int64)
        seen = np.zeros(1 << 20, bool)
        seen[known & (len(seen) - 1)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, t in B.each_chunk(b.column(1), _ALIAS_BYTES):
                text, g = B.kgrams(t, KGRAM)
                g = g.view(np.int64)
                if known is not None:
                    maybe = np.flatnonzero(seen[g & (len(seen) - 1)])
                    hit = maybe[known[np.minimum(np.searchsorted(known, g[maybe]), len(known) - 1)] == g[maybe]] if len(known) else maybe[:0]
                    text, g = text[hit], g[hit]
                order = np.lexsort((g, text))
                text, g = text[order], g[order]
                new = np.ones(len(g), bool)
                new[1:] = (text[1:] != text[:-1]) | (g[1:] != g[:-1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text[new] + i)), pa.array(g[new])], names=[key, "g"])

    return units.select(key, "text").mapInArrow(run, T.StructType([units.schema[key], T.StructField("g", T.LongType())]))


def known_kgrams(rows: DataFrame, most: int | None = None) -> np.ndarray | None:
    """The distinct g of rows, sorted; None if they are more than ``most``."""
    most = KNOWN if most is None else most
    found = rows.select("g").distinct().limit(most + 1).toArrow().column("g").to_numpy()
    return np.sort(found) if len(found) <= most else None


def frequencies(units: DataFrame, key: str) -> DataFrame:
    """term, n and docs of units (key, text): how often a term occurs, and in the texts of how many keys. Terms are
    counted where the texts are; only texts of a key that others have too are counted by key and term."""
    again = units.select(key).filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").select(key)
    repeated = again.count()
    if repeated > REPEATED:
        return _by_key(units, key)
    if not repeated:
        return _total(_counted(units, key))
    again = F.broadcast(again)
    return _total(_counted(units.join(again, key, "left_anti"), key).unionByName(_by_key(units.join(again, key, "left_semi"), key)))


def _total(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _by_key(units: DataFrame, key: str) -> DataFrame:
    return exploded(units, raw_tokens(F.col("text")), key, lang="").groupBy("term").agg(F.sum("n").alias("n"), F.count(key).alias("docs"))


def _counted(units: DataFrame, key: str) -> DataFrame:
    """term, n and docs, several rows a term; every text is of a key of its own or of none."""
    small_batches(units.sparkSession)

    def merged(parts: list[tuple]) -> tuple:
        h, first, of = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        add = lambda k: np.bincount(of, np.concatenate([p[k] for p in parts]), len(h)).astype(np.int64)
        return h, add(1), add(2), np.concatenate([p[3] for p in parts])[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []

        def out() -> pa.RecordBatch:
            _, n, docs, terms = merged(parts)
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(n), pa.array(docs)], names=["term", "n", "docs"])

        for b in batches:
            valid = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for i, j, t in B.each_chunk(b.column(1), _ALIAS_BYTES):
                h, first, of = np.unique(t.hash, return_index=True, return_inverse=True)
                each = np.unique(t.text() * len(h) + of)  # a term and a text that has it
                docs = np.bincount(each % len(h), valid[i:j][each // len(h)], len(h)).astype(np.int64) if len(h) else np.zeros(0, np.int64)
                parts.append((h, np.bincount(of, minlength=len(h)), docs, np.array([t.term(k, _ALIAS_BYTES) for k in first.tolist()], object)))
            if sum(len(p[0]) for p in parts) > GATHERED:
                parts = [merged(parts)]
                if len(parts[0][0]) > GATHERED // 2:
                    yield out()
                    parts = []
        if parts:
            yield out()

    return units.select(key, "text").mapInArrow(run, "term string, n long, docs long")
