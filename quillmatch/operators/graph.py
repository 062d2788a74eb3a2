"""Imports resolved to units, and what follows from the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..partitions import by_key
from .matching import within

#: Most distinct items that are sent to all executors; beyond, imports meet them by a join.
ITEMS = 1 << 20


def resolve(imports: DataFrame, units: DataFrame) -> DataFrame:
    """importer and target: the unit whose stem equals the imported item, in normal form; of several, the first by
    stem and key. Wildcards and braces resolve to nothing."""
    index = units.groupBy(N.canonical(F.col("stem")).alias("norm")).agg(F.min(F.struct("stem", "key")).getField("key").alias("target"))
    plain = imports.filter(~F.coalesce(F.col("wildcard"), F.lit(False)) & ~F.contains("item", F.lit("{")))
    return plain.select("importer", N.canonical(F.col("item")).alias("norm")).join(index, "norm").select("importer", "target")


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct edges without loops."""
    return resolved.filter("importer <> target").distinct()


def degrees(units: DataFrame, imports: DataFrame, links: DataFrame) -> DataFrame:
    """key, dependencies (all imports of it, resolved or not) and dependents (distinct units that import it)."""
    out = imports.groupBy(F.col("importer").alias("key")).agg(F.count("*").alias("dependencies"))
    into = links.groupBy(F.col("target").alias("key")).agg(F.count("*").alias("dependents"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return units.select("key").join(out, "key", "left").join(into, "key", "left").select("key", z("dependencies"), z("dependents"))


def id_links(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """importer and target of the distinct imports that pairs (importer, item) of ids of units (id, key, stem) are: ids, each
    unit's its own, so that no text of a name goes with an import. Imports of what is no unit are left out; the target is
    null if the item resolves to none. All of an importer's rows are in one partition, of a bounded size."""
    named = units.filter("key IS NOT NULL").select("id", "stem")
    wanted = pairs.select(F.col("item").alias("id")).distinct()
    items = units.select("id", "stem").join(wanted, "id", "left_semi")
    index = by_key(named.select(N.canonical(F.col("stem")).alias("norm"), "stem", F.col("id").alias("key")), "norm", rows=units.count())
    found = resolve(items.select(F.col("id").alias("importer"), F.col("stem").alias("item"), F.lit(False).alias("wildcard")), index)
    known = items.select(F.col("id").alias("item")).join(found.select(F.col("importer").alias("item"), "target"), "item", "left")
    known = F.broadcast(known) if wanted.count() <= ITEMS else known
    apart = by_key(pairs, "importer").distinct()
    return apart.join(named.select(F.col("id").alias("importer")).hint("merge"), "importer").join(known, "item").select("importer", "target")


def id_degrees(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """units (id, key, stem) with what degrees() gives for the imports that pairs of ids are."""
    links = id_links(units, pairs)
    out = links.groupBy(F.col("importer").alias("id")).agg(F.count("*").alias("dependencies"))
    into = edges(links).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("dependents"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return units.join(out, "id", "left").join(into, "id", "left").select(*units.columns, z("dependencies"), z("dependents"))


def status(dependents: Column) -> Column:
    return F.when(dependents >= 5, "CORE").when(dependents == 0, "leaf").otherwise("")


def top_importers(links: DataFrame, most: int = 5) -> DataFrame:
    w = Window.partitionBy("target").orderBy("importer")
    return links.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("target", "importer", "rank")


def id_top_importers(units: DataFrame, pairs: DataFrame, most: int = 5) -> DataFrame:
    """top_importers() of the imports that pairs of ids of units (id, key, stem) are."""
    names = units.select(F.col("id").alias("importer"), F.col("key").alias("name")).hint("merge")
    named = edges(id_links(units, pairs)).join(names, "importer").select("target", F.col("name").alias("importer"))
    top = top_importers(by_key(named, "target", rows=pairs.count()), most)
    return top.join(units.select(F.col("id").alias("target"), F.col("key").alias("name")), "target").select(F.col("name").alias("target"), "importer", "rank")


def contains_edges(imports: DataFrame, units: DataFrame) -> DataFrame:
    """Edges where a normalised import contains a unit's stem, by an equi-join on the import's parts."""
    a = imports.select(F.col("importer"), N.canonical(F.regexp_replace("item", r"[./:-]", "")).alias("norm")).distinct()
    b = units.select(F.col("key").alias("sid"), N.canonical(F.regexp_replace("stem", "[.-]", "")).alias("short")).filter("short <> ''")
    held = within(a.select(F.col("norm").alias("lid"), F.col("norm").alias("long")).distinct(), b)
    return a.join(held, F.col("norm") == F.col("lid")).select("importer", F.col("sid").alias("target")).filter("importer <> target").distinct()


def logical_units(paths: DataFrame) -> DataFrame:
    """unit, the paths it is made of, and the one that stands for it: a header, else the first."""
    u = paths.select("path", N.unit_key(F.col("path")).alias("unit"), N.is_header(F.col("path")).alias("header"))
    return u.groupBy("unit").agg(F.array_sort(F.collect_list("path")).alias("paths"), F.min(F.struct((~F.col("header")).alias("h"), "path")).getField("path").alias("main"))


def distinct_names(units: DataFrame) -> DataFrame:
    """Units in order within their stem (headers first, then shorter keys), a repeated qualified name made whole."""
    w = Window.partitionBy("stem").orderBy(F.desc("header"), F.length("key"), "key")
    again = Window.partitionBy("qualified").orderBy(F.desc("header"), F.length("key"), "key")
    full = F.replace("key", F.lit("/"), F.lit("."))
    return units.select("key", "stem", F.row_number().over(w).alias("rank"), F.when(F.row_number().over(again) > 1, full).otherwise(F.col("qualified")).alias("qualified"))


def import_rows(files: DataFrame) -> DataFrame:
    """importer, module_path, item and wildcard of the imports that the lines (path, line) of a file make, by language."""
    lang = N.language(F.col("path"))
    line = F.trim("line")
    rust = F.regexp_extract(line, r"^(?:pub(?:\([a-z]+\))?\s+)?use\s+(.+?);", 1)
    kotlin = F.regexp_extract(line, r"^import\s+([\w.*`]+)", 1)
    cpp = F.regexp_replace(F.replace(F.regexp_extract(line, r'^#\s*include\s*["<]([^">]+)[">]', 1), F.lit("/"), F.lit("::")), r"\.(hpp|h)$", "")
    from_ = F.regexp_extract(line, r"^from\s+([\w.]+)\s+import\s+", 1)
    names = F.when(from_ != "", F.transform(F.split(F.regexp_replace(F.regexp_extract(line, r"import\s+(.+)$", 1), r"[()]", ""), r"\s*,\s*"), lambda n: F.concat(from_, F.lit("."), F.regexp_replace(F.trim(n), r"\s+as\s+.*$", ""))))
    plain = F.transform(F.split(F.regexp_extract(line, r"^import\s+(.+)$", 1), r"\s*,\s*"), lambda n: F.regexp_replace(F.trim(n), r"\s+as\s+.*$", ""))
    script = F.coalesce(F.nullif(F.regexp_extract(line, r"""^(?:import|export)\b.*?from +["']([^"']+)["']""", 1), F.lit("")), F.lit(""))
    all_ = F.when(lang == "rust", F.array(rust)).when(lang == "kotlin", F.array(kotlin)).when(lang == "cpp", F.array(cpp)).when(lang == "python", F.coalesce(names, plain)).otherwise(F.array(script))
    raw = files.select(F.col("path").alias("importer"), F.explode(all_).alias("raw")).filter("raw <> ''")
    clean = F.regexp_replace(F.col("raw"), r"\s+as\s+\w+$", "")
    item = F.regexp_extract(clean, r"([^:./]+|\{.*\})$", 1)
    return raw.select("importer", clean.alias("module_path"), item.alias("item"), (item == "*").alias("wildcard"))


def python_imports(files: DataFrame) -> DataFrame:
    """The same of whole Python texts (path, text): statements may go on over lines, in brackets or after a backslash."""
    text = F.regexp_replace(F.col("text"), r"\\\r?\n", " ")
    found = F.regexp_extract_all(text, F.lit(r"(?m)(?:^|;)[ \t]*((?:from[ \t]+[\w.]+[ \t]+import\b[ \t]*(?:\([^)]*\)|[^\n;#]*))|(?:import[ \t]+[^\n;#]*))"), 1)
    said = files.select(F.col("path").alias("importer"), F.explode(found).alias("said"))
    module = F.regexp_extract("said", r"^from\s+([\w.]+)", 1)
    listed = F.regexp_replace(F.regexp_replace(F.regexp_replace("said", r"#[^\n]*", " "), r"(?s)^(?:from\s+[\w.]+\s+)?import\b", ""), r"[()]", " ")
    names = F.filter(F.transform(F.split(listed, ","), lambda n: F.regexp_replace(F.trim(F.regexp_replace(n, r"\s+", " ")), " as .*$", "")), lambda n: n != "")
    rows = said.select("importer", module.alias("module"), F.explode(names).alias("name"))
    from_ = F.col("module") != ""
    star = from_ & (F.col("name") == "*")
    path = F.when(star, F.col("module")).when(from_, F.concat("module", F.lit("."), "name")).otherwise(F.col("name"))
    return rows.select("importer", path.alias("module_path"), F.when(from_, F.col("name")).otherwise(F.regexp_extract("name", r"([^.]*)$", 1)).alias("item"), star.alias("wildcard"))
