"""Symbols: candidates, parity, duplicates, re-exports, import suggestions and compiler fix-ups, all as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N

OPERATORS = {
    "add": "plus", "sub": "minus", "mul": "times", "div": "div", "rem": "rem", "neg": "unaryMinus", "hash": "hashCode", "eq": "equals", "ne": "notEquals", "cmp": "compareTo",
    "partial_cmp": "compareTo", "into_iter": "iterator", "next": "next", "try_from": "tryFrom", "from": "from", "into": "into", "index_mut": "set", "index": "get", "deref_mut": "setValue", "deref": "getValue",
}
METHOD, FUNCTION = "IMPL_METHOD", "FUNCTION"


def candidates(symbols: DataFrame) -> DataFrame:
    """symbols exploded into candidate names, with confidence, reason and the order in which they are tried."""
    name, parent, kind = F.col("name"), F.coalesce("parent", F.lit("")), F.col("kind")
    camel, has = N.camel(name), parent != ""
    mapped = F.create_map([F.lit(x) for kv in OPERATORS.items() for x in kv])[name]
    bare, raw = F.regexp_replace(name, "^_+", ""), F.regexp_replace(name, "^r#", "")
    method = kind == METHOD
    at = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    rules = [
        (F.lit(True), name, 1.0, "exact"), (name.startswith("_") & (bare != ""), bare, 0.97, "strip_leading_underscore"), (kind.isin(FUNCTION, METHOD) & (camel != name), camel, 0.95, "camelCase"),
        (has, at(parent, ".", name), 0.9, "qualified"), (has & (camel != name), at(parent, ".", camel), 0.85, "qualified+camelCase"),
        (has, at(parent, ".Companion.", name), 0.8, "companion"), (has & (camel != name), at(parent, ".Companion.", camel), 0.75, "companion+camelCase"),
        (has & (name == "new"), at(parent, ".invoke"), 0.7, "new→invoke"), (has & (name == "new"), parent, 0.65, "new→constructor"),
        (name.startswith("r#"), raw, 0.95, "raw_ident"), (has & name.startswith("r#"), at(parent, ".", raw), 0.9, "qualified+raw_ident"),
        (has & method & (name == "fmt"), at(parent, ".toString"), 0.8, "fmt→toString"), (has & method & (name == "drop"), at(parent, ".close"), 0.8, "drop→close"),
        (has & method & mapped.isNotNull(), at(parent, ".", mapped), 0.85, at(name, "→", mapped)), (has & method & mapped.isNotNull(), mapped, 0.6, at(name, "→", mapped, " (unqualified)")),
        (method, name, 0.5, "method_name_only"), (method & (camel != name), camel, 0.45, "method_camelCase_only"),
    ]
    row = lambda i, r: F.when(r[0], F.struct(r[1].alias("candidate"), F.lit(r[2]).alias("confidence"), (F.lit(r[3]) if isinstance(r[3], str) else r[3]).alias("reason"), F.lit(i).alias("ord")))
    all_ = F.filter(F.array(*(row(i, r) for i, r in enumerate(rules))), lambda x: x.isNotNull())
    return symbols.withColumn("c", F.explode(all_)).select(*symbols.columns, "c.*")


def _index(symbols: DataFrame, name: str) -> DataFrame:
    """The symbol that a name stands for: one that is no stub, then the first."""
    pick = F.min(F.struct(F.col("is_stub").cast("int").alias("stub"), "id")).getField("id")
    return symbols.groupBy(F.col(name).alias("candidate")).agg(pick.alias("target_id"))


def parity(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """id, target_id, confidence and reason of each source symbol: the best candidate that a target symbol has, by
    qualified name before plain name, the earlier candidate on ties; nulls where none is found."""
    c = candidates(src).select("id", "candidate", "confidence", "reason", "ord")
    hits = c.join(_index(tgt, "qualified"), "candidate").withColumn("way", F.lit(0)).unionByName(c.join(_index(tgt, "name"), "candidate").withColumn("way", F.lit(1)))
    best = hits.groupBy("id").agg(F.min(F.struct((-F.col("confidence")).alias("x"), "ord", "way", "target_id", "reason")).alias("b"))
    return src.select("id").join(best, "id", "left").select("id", "b.target_id", F.coalesce(-F.col("b.x"), F.lit(0.0)).alias("confidence"), F.coalesce("b.reason", F.lit("")).alias("reason"))


def coverage(src: DataFrame, matches: DataFrame) -> DataFrame:
    """matched and total by test and kind, with subtotals (null kind) and the total (null both)."""
    j = src.join(matches, "id")
    return j.rollup("is_test", "kind").agg(F.count("target_id").alias("matched"), F.count("*").alias("total"))


def extra(tgt: DataFrame, matches: DataFrame) -> DataFrame:
    return tgt.join(matches.select(F.col("target_id").alias("id")).distinct(), "id", "left_anti")


def duplicates(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("name").agg(F.count_distinct("file").alias("files"), F.count("*").alias("n")).filter("files > 1")


def namespace_mismatch(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """name, source and target package where they differ; of equal names the last counts. Each colon becomes a dot."""
    last = lambda d, n: d.groupBy("name").agg(F.max_by("package", "id").alias(n))
    j = last(src, "source_package").join(last(tgt, "target_package"), "name")
    return j.filter(F.translate("source_package", ":", ".") != F.translate("target_package", ":", "."))


def missing(src: DataFrame, tgt: DataFrame) -> DataFrame:
    key = N.canonical(F.col("name"))
    return src.withColumn("k", key).join(tgt.select(key.alias("k")).distinct(), "k", "left_anti").drop("k")


def reexports(lines: DataFrame) -> DataFrame:
    """file, item and alias of single-line "pub use" lines: braces opened, globs and self left out."""
    body = F.regexp_extract(F.trim("line"), r"^pub use ([^;]+);", 1)
    inner = F.regexp_extract(body, r"^(.*?)(?:::)?\{(.*)\}$", 2)
    items = F.when(inner != "", F.split(inner, ",")).otherwise(F.array(body))
    rows = lines.withColumn("body", body).filter("body <> ''").select("file", F.explode(items).alias("spec"))
    parts = F.split(F.trim("spec"), r"\s+as\s+")
    name = F.element_at(F.split(parts[0], "::"), -1)
    return rows.select("file", name.alias("item"), F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(2))).otherwise(name).alias("alias")).filter(~F.col("item").isin("*", "self", ""))


def reexport_chains(symbols: DataFrame, exports: DataFrame) -> DataFrame:
    """id and the files, in order, that export a symbol from elsewhere."""
    e = exports.select(F.col("alias").alias("name"), F.col("file").alias("via"))
    return symbols.join(e, "name").filter("via <> file").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("via")), ",").alias("via"))


def unresolved(files: DataFrame) -> DataFrame:
    """file and ref: types that a file (file, package, imports, defined, referenced) uses and that are neither imported,
    defined there or in its package, nor built in. Anti-joins, so no file's sets meet another's."""
    refs = files.select("file", "package", F.explode("referenced").alias("ref")).distinct()
    imported = files.select("file", F.explode(F.transform("imports", lambda i: F.element_at(F.split(i, r"\."), -1))).alias("ref"))
    same = files.select("package", F.explode("defined").alias("ref"))
    return refs.join(imported, ["file", "ref"], "left_anti").join(same, ["package", "ref"], "left_anti").filter(~N.is_builtin(F.col("ref"))).select("file", "package", "ref")


def suggestions(files: DataFrame) -> DataFrame:
    """file, ref, the number of packages that define it, and the import to add (null if none or several do)."""
    registry = files.select(F.explode("defined").alias("ref"), "package").distinct().groupBy("ref").agg(F.count("*").alias("packages"), F.min("package").alias("only"))
    j = unresolved(files).join(registry, "ref", "left")
    return j.select("file", "ref", F.coalesce("packages", F.lit(0)).alias("packages"), F.when(F.col("packages") == 1, F.concat("only", F.lit("."), "ref")).alias("suggestion"))


ERROR = r"^e: (?:file://)?(.+?):(\d+):(\d+).*Unresolved reference:? '([^']+)'"


def compiler_errors(lines: DataFrame) -> DataFrame:
    g = lambda k: F.regexp_extract("line", ERROR, k)
    return lines.filter(F.col("line").rlike(ERROR)).select(g(1).alias("file"), g(2).cast("int").alias("row"), g(3).cast("int").alias("col"), g(4).alias("ref"))


def fixups(errors: DataFrame, files: DataFrame) -> DataFrame:
    """file, ref, n, status and import of each unresolved reference. Of several packages that define it, one that the
    file imports from already is preferred, then one with the same parent; else it is ambiguous."""
    n = errors.groupBy("file", "ref").agg(F.count("*").alias("n"))
    registry = files.select(F.explode("defined").alias("ref"), F.col("package").alias("home")).distinct()
    used = files.select("file", F.explode(F.transform("imports", N.parent_of)).alias("home")).distinct().withColumn("used", F.lit(True))
    here = files.select("file", "package")
    c = n.join(here, "file", "left").join(registry, "ref", "left").filter("home IS NULL OR package IS NULL OR home <> package").join(used, ["file", "home"], "left")
    score = F.when(F.col("home").isNull(), 9).when(F.coalesce("used", F.lit(False)), 0).when(N.parent_of(F.col("home")) == N.parent_of(F.coalesce("package", F.lit(""))), 1).otherwise(2)
    w = Window.partitionBy("file", "ref")
    s = c.withColumn("score", score).withColumn("best", F.min("score").over(w)).filter("score = best")
    g = s.groupBy("file", "ref").agg(F.max("n").alias("n"), F.count("home").alias("homes"), F.min("home").alias("home"))
    return g.select("file", "ref", "n", F.when(F.col("homes") == 0, "unfixable").when(F.col("homes") > 1, "ambiguous").otherwise("fixable").alias("status"), F.when(F.col("homes") == 1, F.concat("home", F.lit("."), "ref")).alias("import"))


def lookup(files: DataFrame, name: str) -> DataFrame:
    """file and how often it defines, declares ahead, and otherwise refers to a class; files with none are left out."""
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), 0)).cast("long")
    defined = count(rf"\b(?:class|struct)\s+{name}\b[^;{{]*\{{")
    ahead = count(rf"\b(?:class|struct)\s+{name}\s*;")
    return files.select("path", defined.alias("definitions"), ahead.alias("forwards"), (count(rf"\b{name}\b") - defined - ahead).alias("refs")).filter("definitions + forwards + refs > 0")
