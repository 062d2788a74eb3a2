"""Whole comparisons: two corpora, two files, symbol parity, imports, compiler fix-ups. A text is parsed once per table that
is made of it; matching is the only step that goes in rounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..functions import names as N
from ..functions import text as X
from ..operators import graph as G
from ..operators import matching as J
from ..operators import reports as R
from ..operators import similarity as M
from ..operators import symbols as P
from ..operators import tokens as K
from ..operators import trees as T
from ..sources import code as C


@dataclass
class Corpus:
    """The tables of one side, each written once and read by several steps."""

    files: DataFrame  # unit, lang, text, path
    symbols: DataFrame
    origins: DataFrame
    stats: DataFrame
    imports: DataFrame

    @classmethod
    def of(cls, files: DataFrame) -> Corpus:
        """files has path, lang and text."""
        named = files.select(F.col("path").alias("unit"), "path", "lang", "text")
        rows, python = X.lines(files), N.language(F.col("path")) == "python"
        return cls(named, cut(C.symbols(named)), cut(X.provenance(rows)), cut(X.line_stats(rows)), cut(G.import_rows(rows.filter(~python)).unionByName(G.python_imports(files.filter(python)))))

    def functions(self) -> DataFrame:
        fns = self.symbols.filter(F.col("kind").isin("FUNCTION", "IMPL_METHOD") & F.col("has_body"))
        return fns.join(self.files.select("unit", "lang"), "unit").withColumn("fn", F.concat("unit", F.lit("#"), F.col("id").cast("string")))

    def units(self) -> DataFrame:
        p = F.col("unit")
        return self.files.select(p.alias("key"), p.alias("path"), N.stem(p).alias("stem"), N.qualified(p).alias("qualified"), F.filter(F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0))), lambda d: ~d.isin("", ".", "src")).alias("package"), N.is_header(p).alias("header"))


def matches(src: Corpus, tgt: Corpus, strict: bool = False) -> DataFrame:
    """src, tgt, score and matched_by: by header first; then, unless ``strict``, what is left by name above 0.4."""
    targets = tgt.units().join(tgt.origins.withColumnRenamed("path", "key"), "key", "left")
    first = J.greedy(J.header_scores(src.units(), targets, strict)).withColumn("matched_by", F.lit("header"))
    if strict:
        return first
    rest_s, rest_t = J.unmatched(src.units(), first, "src"), J.unmatched(targets, first, "tgt")
    second = J.greedy(J.name_scores(rest_s, rest_t)).withColumn("matched_by", F.lit("name"))
    return cut(first.unionByName(second))


def numbered_pairs(pairs: DataFrame) -> DataFrame:
    """src, tgt and pair, a number of its own for each; written, so that numbers stay."""
    return cut(pairs.select("src", "tgt").distinct().withColumn("pair", F.monotonically_increasing_id()))


def function_scores(src: Corpus, tgt: Corpus, numbered: DataFrame) -> DataFrame:
    """src, tgt, matched and score of numbered pairs: functions of the same canonical name, one to one, by body and
    parameter similarity."""
    s = src.functions().select(F.col("unit").alias("src"), F.col("fn").alias("a"), N.canonical(F.col("name")).alias("name"), F.col("id").cast("int").alias("src_fn"), F.col("is_stub").alias("src_stub"))
    t = tgt.functions().select(F.col("unit").alias("tgt"), F.col("fn").alias("b"), N.canonical(F.col("name")).alias("name"), F.col("id").cast("int").alias("tgt_fn"), F.col("is_stub").alias("tgt_stub"))
    c = cut(numbered.join(s, "src").join(t, ["tgt", "name"]))
    bodies = src.functions().unionByName(tgt.functions()).select(F.col("fn").alias("unit"), "lang", F.concat_ws("\n", "args", "body").alias("text"))
    hist = T.histogram(C.parse_nodes(bodies))
    ids = C.identifiers(bodies).groupBy("unit", N.canonical(F.col("term")).alias("term")).agg(F.sum("n").alias("n"))
    ab = c.select("a", "b").distinct()
    hist, ids = cut(hist), cut(ids)
    h = M.paired(ab, hist, weight=M.node_weight(F.col("term"))).select("a", "b", F.col("cosine").alias("hist"))
    i = M.paired(ab, ids).select("a", "b", "cosine", (F.col("jaccard") == 1.0).alias("same"))
    has = ids.select(F.col("unit").alias("a")).distinct().withColumn("has_ids", F.lit(True))
    empty = F.coalesce("has_ids", F.lit(False))
    sim = h.join(i, ["a", "b"]).join(has, "a", "left").select("a", "b", M.body_score(F.col("cosine"), F.col("hist"), ~empty & F.col("same")).alias("sim"))
    sim = cut(sim)
    scored = J.function_score(c.join(sim, ["a", "b"]).select("pair", "name", "src_fn", "tgt_fn", "sim", "src_stub", "tgt_stub"), numbered.join(s, "src").select("pair", "src_fn"))
    both = numbered.join(scored, "pair", "left")
    n_tgt = tgt.functions().groupBy(F.col("unit").alias("tgt")).agg(F.count("*").alias("n_tgt"))
    none = F.when(F.coalesce("n_tgt", F.lit(0)) == 0, 1.0).otherwise(0.0)  # neither side has functions, or the source alone has none
    return both.join(n_tgt, "tgt", "left").select("src", "tgt", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("score", none).alias("score"))


def deep(src_files: DataFrame, tgt_files: DataFrame, strict: bool = False) -> DataFrame:
    """A row for each matched pair: scores, coverage, counts, dependents, contamination, status and priority."""
    src, tgt = Corpus.of(src_files), Corpus.of(tgt_files)
    found = matches(src, tgt, strict)
    links = G.edges(G.resolve(src.imports, src.units()))
    deg = cut(G.degrees(src.units(), src.imports, links).select(F.col("key").alias("src"), "dependents"))
    numbered = numbered_pairs(found)
    fn = cut(function_scores(src, tgt, numbered))

    def named(side: Corpus, key: str) -> DataFrame:
        return numbered.join(side.functions().select(F.col("unit").alias(key), "name", "is_test", F.col("id").alias("pos")), key).select("pair", "name", "is_test", "pos")

    cov = cut(J.name_coverage(named(src, "src"), named(tgt, "tgt")))
    dirty = C.contamination(tgt.files.filter("lang = 'kotlin'")).select(F.col("unit").alias("tgt"), "reasons")
    todo = X.todos(X.lines(tgt_files)).groupBy(F.col("path").alias("tgt")).agg(F.count("*").alias("todos"))
    lint = C.unused_parameters(tgt.files).groupBy(F.col("unit").alias("tgt")).agg(F.count("*").alias("lint"))
    code = lambda c, k, n: c.stats.select(F.col("path").alias(k), F.col("code_lines").alias(n))
    j = found.join(numbered, ["src", "tgt"]).join(fn.select("src", "tgt", F.col("score").alias("similarity")), ["src", "tgt"], "left").join(deg, "src", "left").join(cov, "pair", "left").join(dirty, "tgt", "left").join(todo, "tgt", "left").join(lint, "tgt", "left")
    j = j.join(code(src, "src", "src_code"), "src", "left").join(code(tgt, "tgt", "tgt_code"), "tgt", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    sim = F.when(F.coalesce("reasons", F.lit("")) != "", 0.0).otherwise(F.coalesce("similarity", F.lit(-1.0)))
    stub = J.ratio_stub(z("src_code"), z("tgt_code"))
    lacking = z("total") - z("matched")
    return (
        j.drop("pair").withColumn("similarity", sim).withColumn("stub", stub)
        .select("src", "tgt", "matched_by", "score", "similarity", "stub", z("dependents").alias("dependents"), z("total").alias("functions"), z("matched").alias("matched"), z("todos").alias("todos"), z("lint").alias("lint"), F.coalesce("reasons", F.lit("")).alias("reasons"), z("src_code").alias("src_code"), z("tgt_code").alias("tgt_code"),
                R.issue(F.col("stub"), F.col("similarity"), lacking, F.lit(0), F.lit(0), z("lint"), z("todos")).alias("issue"), R.priority(z("dependents"), F.greatest(lacking, F.lit(0)), z("total"), F.col("similarity")).alias("priority"))
        .orderBy(F.desc("priority"), "src")
    )


def two_files(spark: SparkSession, a: tuple[str, str, str], b: tuple[str, str, str]) -> DataFrame:
    """One row of all similarities of two texts, each (name, lang, text)."""
    files = spark.createDataFrame([("a", a[1], a[2] if a[1] != "rust" else C.strip_test_blocks(a[2])), ("b", b[1], b[2])], "unit string, lang string, text string")
    pair = spark.createDataFrame([("a", "b")], "a string, b string")
    nodes = cut(C.parse_nodes(files))
    size = T.measures(nodes)
    hist = M.paired(pair, T.histogram(nodes), weight=M.node_weight(F.col("term"))).select("a", "b", F.col("cosine").alias("hist"), F.col("multiset_jaccard").alias("jaccard"))
    edit = T.edit_distances(pair, T.sequences(nodes)).select("a", "b", F.col("similarity").alias("edit"))
    ids = C.identifiers(files).groupBy("unit", N.canonical(F.col("term")).alias("term")).agg(F.sum("n").alias("n"))
    names = M.paired(pair, ids).select("a", "b", F.col("cosine").alias("id_cosine"), F.col("jaccard").alias("id_jaccard"))
    toks = files.select("unit", F.when(F.col("lang") == "rust", K.tokens(F.col("text"), "rust")).when(F.col("lang") == "kotlin", K.tokens(F.col("text"), "kotlin")).otherwise(K.tokens(F.col("text"))).alias("t"))
    tok = M.paired(pair, K.exploded(toks, F.col("t"), "unit")).select("a", "b", F.col("cosine").alias("token_cosine"), F.col("jaccard").alias("token_jaccard"))
    gram = M.paired(pair, toks.select("unit", F.explode(K.kgram_hashes(F.col("t"))).alias("term"), F.lit(1).alias("n"))).select("a", "b", F.col("jaccard").alias("kgram_jaccard"))
    notes = C.comments(files)
    doc = M.paired(pair, K.exploded(notes, X.doc_words(F.col("doc_text")), "unit")).select("a", "b", F.col("cosine").alias("doc_cosine"))
    side = lambda d, k, *cols: d.select(F.col("unit").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in cols))
    j = pair
    for part in (hist, edit, names, tok, gram, doc):
        j = j.join(part, ["a", "b"])
    for k in ("a", "b"):
        j = j.join(side(size, k, "size", "depth"), k).join(side(notes, k, "doc_lines"), k)
    c = F.col
    struct = M.structure(c("size_a"), c("size_b"), c("depth_a"), c("depth_b"))
    r = lambda x, n: F.round(x, 6).alias(n)
    return j.select(
        "size_a", "size_b", "depth_a", "depth_b", r(c("hist"), "histogram_cosine"), r(struct, "structure"), r(c("jaccard"), "jaccard"), r(c("edit"), "edit"), r(M.report(c("hist"), struct, c("jaccard"), c("edit")), "combined"),
        r(c("id_cosine"), "id_cosine"), r(M.with_content(c("id_cosine"), c("id_jaccard"), c("hist"), c("jaccard"), struct, F.lit(False), F.lit(False)), "with_content"), r(M.transliteration(c("token_cosine"), c("token_jaccard"), c("kgram_jaccard")), "transliteration"),
        r(M.doc_weighted(c("doc_cosine"), c("doc_lines_a"), c("doc_lines_b")), "doc_weighted"),
    )


def symbol_parity(src_files: DataFrame, tgt_files: DataFrame) -> DataFrame:
    """Source symbols with the target symbol found for each, over files (path, lang, text)."""
    s = C.symbols(src_files.select(F.col("path").alias("unit"), "lang", "text")).withColumn("id", F.xxhash64("unit", "id"))
    t = C.symbols(tgt_files.select(F.col("path").alias("unit"), "lang", "text")).withColumn("id", F.xxhash64("unit", "id"))
    s, t = cut(s), cut(t)
    m = P.parity(s, t)
    return s.select("id", "unit", "kind", "name", "parent", "is_test").join(m, "id").join(t.select(F.col("id").alias("target_id"), F.col("unit").alias("target"), F.col("qualified").alias("target_name")), "target_id", "left").drop("target_id")


def kotlin_types(files: DataFrame) -> DataFrame:
    """file, package, imports, defined and referenced type names of Kotlin files (path, text)."""
    t = F.col("text")
    every = lambda p, g=1: F.regexp_extract_all(t, F.lit(p), g)
    body = F.regexp_replace(F.regexp_replace(t, r"(?s)/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"", " "), r"(?m)^\s*(import|package)\b[^\n]*", " ")
    return files.select(
        F.col("path").alias("file"), F.regexp_extract(t, r"(?m)^\s*package\s+([\w.]+)", 1).alias("package"), F.array_distinct(every(r"(?m)^\s*import\s+([\w.]+)")).alias("imports"),
        F.array_distinct(every(r"\b(?:class|interface|object|typealias)\s+([A-Z]\w*)")).alias("defined"), F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?<![.\w])([A-Z]\w*)"), 1)).alias("referenced"),
    )
