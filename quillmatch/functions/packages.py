"""The package or module that a file belongs to, from its path or its text, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import stem


def _dirs(path: Column, *passed: str) -> Column:
    parts = F.split(path, "/")
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: ~d.isin("", ".", *passed))


def _with_stem(dirs: Column, path: Column, *roots: str) -> Column:
    name = stem(path)
    return F.when(name.isin("", *roots), dirs).otherwise(F.array_append(dirs, name))


def rust_module(path: Column) -> Column:
    """Directories but "src" and "lib", and the stem unless it is "mod" or "lib", as an array."""
    return _with_stem(_dirs(path, "src", "lib"), path, "mod", "lib")


def python_module(path: Column) -> Column:
    """Directories but "src" and "lib", and the stem unless it is "__init__"."""
    return _with_stem(_dirs(path, "src", "lib"), path, "__init__")


def kotlin_package(text: Column) -> Column:
    """The parts of the package header; none without one. Back ticks go; comments before the header don't matter."""
    bare = F.regexp_replace(text, r"(?s)/\*.*?\*/|//[^\n]*", " ")
    name = F.regexp_replace(F.regexp_extract(bare, r"(?m)^\s*package\s+([\w.`]+)", 1), "`", "")
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.split(name, r"\."))


def cpp_namespace(text: Column, path: Column) -> Column:
    """The first namespace and the first ones nested straight in it (also "a::b"); without any, directories but "src" and
    "include", and the stem."""
    bare = F.regexp_replace(text, r'(?s)/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"', " ")
    first = F.regexp_extract(bare, r"(?s)\b(?<!using )namespace\s+([\w:]+)\s*\{((?:\s*namespace\s+[\w:]+\s*\{)*)", 0)
    parts = F.flatten(F.transform(F.regexp_extract_all(first, F.lit(r"namespace\s+([\w:]+)"), 1), lambda n: F.split(n, "::")))
    return F.when(first != "", parts).otherwise(_with_stem(_dirs(path, "src", "include"), path))


def package_of(path: Column, text: Column) -> Column:
    """The package's parts by the language of the path; none for a language without packages."""
    ends = lambda *found: path.rlike(rf"\.({'|'.join(found)})$")
    return F.when(ends("rs"), rust_module(path)).when(ends("kts?"), kotlin_package(text)).when(ends("[ch]pp", "cc", "h"), cpp_namespace(text, path)).when(ends("py"), python_module(path)).otherwise(F.array().cast("array<string>"))
