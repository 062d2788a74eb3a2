"""Markers, comments and counts in texts and lines, as Column functions and line operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKERS = tuple("todo fixme stub placeholder unimplemented notimplementederror notimplemented".split())
STOPWORDS = ("and", "for", "the", "this", "that", "with")
NUMPY_NEEDLES = ("import numpy", "np.", "numpy.", "import mlx", "mx.", "mlx.", ".astype(", ".item()", ".tolist()", "asarray(")
TODO = r"//[ \t]*TODO([(][^)]*[)])?: *(.+)"


def has_markers(c: Column) -> Column:
    """A marker as a word of its own, whatever its case, or "not (yet) implemented"."""
    return F.lower(c).rlike(rf"(?<![a-z0-9_])({'|'.join(MARKERS)})(?![a-z0-9_])|not (yet )?implemented")


def comment_has_markers(c: Column) -> Column:
    """The comment begins with a marker, after its signs."""
    return F.lower(c).rlike(rf"^\s*(//+|#+|/\*+|\*+)?[!/*\s]*({'|'.join(MARKERS)})(?![a-z0-9_])")


def occurrences(c: Column, needle: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def doc_words(c: Column) -> Column:
    """ASCII words of a text, in lower case, of three characters or more, without six stop words."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)"), 1), F.lower), lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))


def lines(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, pos (from 1) and line of every line; what follows the last line end is a line only if it isn't empty."""
    parts = F.split(F.regexp_replace(F.col(text), r"\n$", ""), "\n")
    return files.filter(F.coalesce(F.length(text), F.lit(0)) > 0).select(key, F.posexplode(parts).alias("p", "line")).select(key, (F.col("p") + 1).alias("pos"), F.regexp_replace("line", r"\r$", "").alias("line"))


def line_stats(rows: DataFrame, key: str = "path") -> DataFrame:
    """By key: blank, comment and code lines. A line within a block comment, or that begins one, is a comment line.

    The state is a running sum of blocks opened and closed, so one window over each file's lines does it."""
    trimmed = F.trim("line")
    opens = (trimmed.startswith("/*") & ~F.contains(F.substring(trimmed, 3, 1 << 30), F.lit("*/"))).cast("int")
    closes = (F.contains(trimmed, F.lit("*/")) & ~trimmed.startswith("/*")).cast("int")
    w = Window.partitionBy(key).orderBy("pos")
    state = rows.select(key, "pos", trimmed.alias("t"), opens.alias("o"), closes.alias("c"))
    before = F.coalesce(F.last(F.when(F.col("o") == 1, 1).when(F.col("c") == 1, 0), True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kind = F.when(F.col("t") == "", "blank").when((before == 1) | F.col("t").startswith("//") | F.col("t").startswith("/*"), "comment").otherwise("code")
    return state.withColumn("kind", kind).groupBy(key).agg(
        F.count("*").alias("total_lines"), F.count_if(F.col("kind") == "blank").alias("blank_lines"), F.count_if(F.col("kind") == "comment").alias("comment_lines"), F.count_if(F.col("kind") == "code").alias("code_lines")
    )


def todos(rows: DataFrame, key: str = "path") -> DataFrame:
    """key, pos, tag ("untagged" without one), message and the first line number that the message names."""
    hit = rows.filter(F.col("line").rlike(TODO))
    tag = F.regexp_replace(F.regexp_extract("line", TODO, 1), r"[()]", "")
    message = F.trim(F.regexp_extract("line", TODO, 2))
    named = F.regexp_extract(message, r"(?i)\bline\s+(\d+)", 1)
    return hit.select(key, "pos", F.when(tag == "", "untagged").otherwise(tag).alias("tag"), message.alias("message"), F.when(named != "", named.cast("int")).alias("source_line"))


def todo_context(rows: DataFrame, key: str = "path", around: int = 3) -> DataFrame:
    """key, pos and context of each TODO: the lines around it, the line itself marked."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(-around, around)
    near = rows.withColumn("near", F.collect_list(F.struct("pos", "line")).over(w)).filter(F.col("line").rlike(TODO))
    shown = F.transform("near", lambda x: F.concat(F.when(x["pos"] == F.col("pos"), ">>> ").otherwise("    "), F.lpad(x["pos"].cast("string"), 4, " "), F.lit(": "), x["line"]))
    return near.select(key, "pos", F.array_join(shown, "\n").alias("context"))


def provenance(rows: DataFrame, key: str = "path") -> DataFrame:
    """key and origin: the first provenance header in a file's first 50 lines, test headers with "tests:" before it."""
    mark = r"(?i)port-lint:[ ]*(tests|source) +([^ ]+)"
    plain = F.trim(F.regexp_extract("line", r"Transliterated from:\s*(.+)", 1))
    kind, path = F.lower(F.regexp_extract("line", mark, 1)), F.regexp_replace(F.regexp_extract("line", mark, 2), "^codex-rs/", "")
    origin = F.when(plain != "", F.regexp_replace(plain, "^codex-rs/", "")).when(path != "", F.concat(F.when(kind == "tests", "tests:").otherwise(""), path))
    found = rows.filter(F.col("pos") <= 50).select(key, "pos", origin.alias("origin")).filter("origin IS NOT NULL")
    return found.groupBy(key).agg(F.min_by("origin", "pos").alias("origin"))


_BOILERPLATE = (r"//[^\n]*", r"(?s)/\*.*?\*/", r"(?m)^\s*#(pragma|include|ifndef|define|endif)[^\n]*", r"(?m)^\s*(package|import|use|using)\b[^\n]*", r"(?m)^\s*(namespace|mod)\b[^{\n]*\{?", r"[{};\s]")


def stripped(c: Column) -> Column:
    """A file without comments, preprocessor lines, imports, namespaces, braces and white space."""
    for pattern in _BOILERPLATE:
        c = F.regexp_replace(c, pattern, "")
    return c


def is_stub_file(c: Column) -> Column:
    return F.length(stripped(c)) < 100


def lacks_guard(path: Column, text: Column) -> Column:
    """A path with .hpp or .h anywhere whose text has neither pragma once nor an include guard."""
    return F.contains(path, F.lit(".h")) & ~F.contains(text, F.lit("#pragma once")) & ~F.contains(text, F.lit("#ifndef"))


def only_wires_modules(c: Column) -> Column:
    """All lines that remain without comments declare modules, re-export or are attributes."""
    kept = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", ""), "\n"), F.trim), lambda x: x != "")
    return F.forall(kept, lambda x: x.rlike(r"^(#!?\[|(pub(\([a-z]+\))?\s+)?(mod|use|extern crate)\b)"))


def has_macro_rules(text: Column) -> Column:
    return F.contains(text, F.lit("macro_rules!"))


def script_todos(text: Column) -> Column:
    """What follows "TODO" and a colon or blank, to the line's end, in any case of letters, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?i)TODO[:\s](.*)"), 1)


def is_script_stub(text: Column, stub_bodies: Column, lines: Column) -> Column:
    """A TypeScript unit with stub bodies, or one of 50 lines or fewer that speaks of work to do."""
    return stub_bodies | ((lines <= 50) & text.rlike(r"(?i)TODO|FIXME|placeholder|not implemented|not yet implemented"))
