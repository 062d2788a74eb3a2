"""Names, paths and module paths as Column functions: all built-ins, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPECIAL_PASCAL = {"refcell": "RefCell"}
HEADER_EXTENSIONS = ("h", "hh", "hpp", "hxx")
PLATFORM_SUFFIXES = ("common_native", "concurrent", "common", "native", "darwin", "apple")
LANGUAGE_OF = {"rs": "rust", "kt": "kotlin", "kts": "kotlin", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "h": "cpp", "py": "python", "ts": "typescript", "tsx": "typescript"}


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def canonical(c: Column) -> Column:
    """Lower case (ASCII letters only) without underscores: the strict form of an identifier or file name."""
    return F.translate(c, UPPER + "_", LOWER)


def synonymous(c: Column, synonyms: dict[str, str], ignored: set[str] = frozenset()) -> Column:
    """The canonical form, mapped by synonyms; an ignored name becomes empty."""
    base = canonical(c)
    if synonyms:
        base = F.coalesce(F.create_map([F.lit(x) for kv in synonyms.items() for x in kv])[base], base)
    return F.when(base.isin(*ignored), "").otherwise(base) if ignored else base


def package_normal(c: Column) -> Column:
    return F.translate(c, UPPER + "_-", LOWER)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r".\.([^.]*)$", 1)


def qualified(path: Column) -> Column:
    """The last directory that isn't "." or "src", a dot, and the stem."""
    dirs = F.filter(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda d: ~d.isin("", ".", "src"))
    return F.when(F.size(dirs) > 0, F.concat(F.element_at(dirs, -1), F.lit("."), stem(path))).otherwise(stem(path))


def matches_path(path: Column, part: Column) -> Column:
    """Whether a path contains a part, both without extension, case and underscores."""
    bare = lambda c: canonical(F.regexp_replace(c, r"(?<=[^/])\.[^./]*$", ""))
    return F.contains(bare(path), bare(part))


def parent_of(name: Column) -> Column:
    """What stands before the last dot; empty without one."""
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise("")


def kebab(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, "(?<=[^_-])([A-Z])", "-$1"), UPPER + "_", LOWER + "-")


def _upper_first(part: Column) -> Column:
    return F.concat(F.translate(F.substring(part, 1, 1), LOWER, UPPER), F.substring(part, 2, 1 << 30))


def pascal(c: Column) -> Column:
    plain = F.array_join(F.transform(F.split(c, "_"), _upper_first), "")
    return reduce(lambda acc, kv: F.when(canonical(c) == kv[0], kv[1]).otherwise(acc), SPECIAL_PASCAL.items(), plain)


def camel(c: Column) -> Column:
    """snake_case to camelCase: a raw-identifier mark and leading underscores go, the first part begins in lower case."""
    bare = F.regexp_replace(F.regexp_replace(c, "^r#", ""), "^_+", "")
    parts = F.filter(F.split(bare, "_"), lambda p: p != "")
    lowered = F.transform(parts, lambda p, i: F.when(i == 0, F.concat(ascii_lower(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))).otherwise(_upper_first(p)))
    return F.when(F.size(parts) == 0, c).otherwise(F.array_join(lowered, ""))


def snake(c: Column) -> Column:
    return ascii_lower(F.regexp_replace(c, "(?<=.)([A-Z])", "_$1"))


def dotted(c: Column) -> Column:
    return F.replace(c, F.lit("::"), F.lit("."))


def annotation_path(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "\\", "/"), r"^(\./)+", "")


def match_key(path: Column) -> Column:
    """The annotation path with each part in package form, the file name without its extension."""
    # signs of paths stay as they are, so the whole path is worked on at once, without an array of its parts
    return package_normal(F.regexp_replace(annotation_path(path), r"(?<=[^/\n\r\u0085\u2028\u2029])\.[^./]*$", ""))


def match_keys(path: Column) -> Column:
    """Keys under which a provenance path can be met: whole, without a leading src/, and after its first /src/."""
    p = annotation_path(path)
    bare = F.when(p.startswith("src/"), F.substring(p, 5, 1 << 30))
    inner = F.when(F.instr(p, "/src/") > 0, F.substring(p, F.instr(p, "/src/") + 5, F.length(p)))
    return F.array_distinct(F.filter(F.array(match_key(p), match_key(bare), match_key(inner)), lambda k: k.isNotNull()))


def base_key(path: Column) -> Column:
    return F.substring_index(match_key(path), "/", -1)


def is_test_origin(c: Column) -> Column:
    return c.startswith("tests:")


def origin_path(c: Column) -> Column:
    return F.when(is_test_origin(c), F.substring(c, 7, 1 << 30)).otherwise(c)


def import_path(c: Column) -> Column:
    return F.regexp_replace(c, r"::|\.", "/")


def is_header(path: Column) -> Column:
    return extension(path).isin(*HEADER_EXTENSIONS)


def language(path: Column) -> Column:
    return F.create_map([F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])[extension(path)]


def unit_key(path: Column) -> Column:
    """The logical unit of a file: its directory and stem without a platform suffix."""
    directory = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    return F.concat(directory, F.regexp_replace(stem(path), rf"\.({'|'.join(PLATFORM_SUFFIXES)})$", ""))


def package_similarity(a: Column, b: Column) -> Column:
    """Of two part lists, the share of the shorter one's parts, from the end, that are equal or contain each other."""
    x, y = F.reverse(F.transform(a, package_normal)), F.reverse(F.transform(b, package_normal))
    n = F.least(F.size(x), F.size(y))
    same = F.slice(F.zip_with(x, y, lambda p, q: F.coalesce((p == q) | F.contains(p, q) | F.contains(q, p), F.lit(False))), 1, F.greatest(n, F.lit(1)))
    miss = F.array_position(same, F.lit(False))
    return F.when(n <= 0, 0.0).otherwise(F.when(miss == 0, n).otherwise(miss - 1).cast("double") / n)


def glob(path: Column, pattern: str) -> Column:
    """A shell pattern: on the file name, or on the whole path (where * stops at a slash) if it has a slash."""
    deep = "/" in pattern
    table = {"*": "[^/]*" if deep else ".*", "?": "[^/]" if deep else "."}
    regex = "".join(table.get(c, c if c.isalnum() or c in "_[]-" else "\\" + c) for c in pattern)
    return (path if deep else file_name(path)).rlike(f"^{regex}$")


def activity_score(minutes: Column) -> Column:
    """100 up to 15 idle minutes, 0 from 60 on, straight between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.lit(60.0) - minutes) / 45.0 * 100.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)


_BUILTINS = """
AbstractCollection AbstractList AbstractMap AbstractSet Annotation Any Appendable ArithmeticException Array ArrayList
AssertionError AutoCloseable Boolean BooleanArray Byte ByteArray Cell Char CharArray Class Cloneable Closeable Collection Companion
Comparable Comparator ConcurrentModificationException Data Deprecated Double DoubleArray Enum Error Exception ExperimentalStdlibApi
ExperimentalUnsignedTypes Float FloatArray From Function Function0 Function1 Function2 Function3 HashMap HashSet IllegalArgumentException
IllegalStateException IndexOutOfBoundsException Int IntArray InterruptedException Iterable Iterator JvmField JvmInline JvmName JvmOverloads
JvmStatic KClass Lazy LinkedHashMap LinkedHashSet List Long LongArray Map MatchResult MutableCollection MutableIterable MutableIterator
MutableList MutableMap MutableSet NoSuchElementException Nothing NullPointerException Number NumberFormatException OptIn Ordering Pair
PublishedApi Regex Result RuntimeException Self Sequence Serializable Set Short ShortArray String StringBuilder Suppress TInput TKey TLeft
TOutput TResult TRight TValue Thread Throwable To Triple UByte UByteArray UInt UIntArray ULong ULongArray UShort UShortArray Unit
UnsupportedOperationException Val Volatile
"""
BUILTINS = tuple(_BUILTINS.split())


def is_builtin(c: Column) -> Column:
    """A type that needs no import: a known one, or one named like a type parameter."""
    return c.isin(*BUILTINS) | c.rlike("^[A-Z][A-Z0-9_]?$") | c.rlike("^[A-Z][0-9_]{0,2}$")


def _alnum(c: Column) -> Column:
    return ascii_lower(F.regexp_replace(c, "[^0-9A-Za-z]", ""))


def expected_target(path: Column, lang: str, has_children: Column | None = None) -> Column:
    """Where the port of a source file belongs: a leading src or include dropped, directories and stem in the style of the
    target language. With ``has_children``, a Rust module that is also a directory goes into it."""
    parts = F.split(path, "/")
    dirs = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: ~d.isin("", "."))
    dirs = F.when((F.size(dirs) > 0) & F.get(dirs, F.lit(0)).isin("src", "include"), F.slice(dirs, 2, 1 << 30)).otherwise(dirs)
    name, s = file_name(path), stem(path)
    if lang == "kotlin":
        dirs, name = F.transform(dirs, _alnum), F.concat(pascal(s), F.lit(".kt"))
        if has_children is not None:
            dirs = F.when(has_children & (extension(path) == "rs") & ~s.isin("mod", "lib"), F.array_append(dirs, _alnum(s))).otherwise(dirs)
    elif lang == "typescript":
        dirs, name = F.transform(dirs, kebab), F.concat(kebab(s), F.lit(".ts"))
    elif lang == "cpp":
        name = F.concat(s, F.lit(".cpp"))
    elif lang == "python":
        name = F.concat(ascii_lower(s), F.lit(".py"))
    return F.array_join(F.array_append(F.filter(dirs, lambda d: d != ""), name), "/")


def expected_target_name(path: Column, lang: str) -> Column:
    return F.replace(F.regexp_replace(expected_target(path, lang), r"\.[^./]*$", ""), F.lit("/"), F.lit("."))


def expected_function(name: Column, source: str, target: str) -> Column:
    return camel(name) if (source, target) == ("rust", "kotlin") else name


def provenance_header(path: Column) -> Column:
    """The header line that names a source file, as a port should carry it."""
    return F.concat(F.lit("// port-lint: source "), F.regexp_replace(annotation_path(path), "^src/", ""))
