"""Queries on names, texts, tokens and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import tensor as L
from ..functions import text as X
from ..operators import similarity as M
from ..operators import tokens as K
from .registry import query, spread, table, values

AZ, az = N.UPPER, N.LOWER
_CANON = f"translate(%s, '{AZ}_', '{az}')"


def _names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_v"), F.col("p_size").cast("string")).alias("snake"))


_SNAKE = "SELECT p_partkey, replace(p_name, ' ', '_') || '_v' || p_size AS snake FROM part"
_PASCAL = "array_to_string(list_transform(string_split(%s, '_'), p -> upper(p[1:1]) || p[2:]), '')"


@query(f"WITH n AS ({_SNAKE}) SELECT p_partkey, {_CANON % 'snake'} AS strict, translate(snake || '-X', '{AZ}_-', '{az}') AS package_form FROM n")
def canonicalize_names(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("p_partkey", N.canonical(F.col("snake")).alias("strict"), N.package_normal(F.concat("snake", F.lit("-X"))).alias("package_form"))


@query(f"WITH n AS ({_SNAKE}) SELECT p_partkey, CASE WHEN snake = 'refcell' THEN 'RefCell' ELSE {_PASCAL % 'snake'} END AS pascal FROM n")
def pascal_names(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("p_partkey", N.pascal(F.col("snake")).alias("pascal"))


@query(f"WITH n AS ({_SNAKE}), p AS (SELECT p_partkey, {_PASCAL % 'snake'} AS pascal FROM n) SELECT p_partkey, lower(regexp_replace(pascal, '([^_-])([A-Z])', '\\1-\\2', 'g')) AS kebab, lower(regexp_replace(pascal, '(.)([A-Z])', '\\1_\\2', 'g')) AS snake_again FROM p")
def kebab_names(spark: SparkSession, sf: str) -> DataFrame:
    p = _names(spark, sf).select("p_partkey", N.pascal(F.col("snake")).alias("pascal"))
    return p.select("p_partkey", N.kebab(F.col("pascal")).alias("kebab"), N.snake(F.col("pascal")).alias("snake_again"))


@query(f"WITH n AS ({_SNAKE}), q AS (SELECT p_partkey, {_PASCAL % 'snake'} AS p FROM n) SELECT p_partkey, lower(p[1:1]) || p[2:] AS camel FROM q")
def camel_names(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("p_partkey", N.camel(F.concat(F.lit("__"), F.col("snake"))).alias("camel"))


_PATH = "regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1)"


def _paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]*/([^?#]*)", 1).alias("path"), F.split(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1), r"\.").alias("labels"))


@query(f"""
WITH p AS (SELECT page_id, 'src/' || rtrim({_PATH}, '/') AS path FROM pages),
s AS (SELECT page_id, string_split(path, '/') AS parts FROM p),
d AS (SELECT page_id, list_filter(parts[1:len(parts)-1], x -> x NOT IN ('', '.', 'src')) AS dirs, parts[-1] AS file FROM s)
SELECT page_id, CASE WHEN len(dirs) > 0 THEN dirs[-1] || '.' ELSE '' END || regexp_replace(file, '(.)\\.[^.]*$', '\\1') AS qualified,
  lower(regexp_replace(file, '(.)\\.[^.]*$', '\\1')) AS unit FROM d""")
def qualified_names(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("src/"), F.rtrim("path", F.lit("/")))
    return _paths(spark, sf).select("page_id", N.qualified(path).alias("qualified"), N.ascii_lower(N.stem(path)).alias("unit"))


@query("""
WITH p AS (SELECT page_id, list_reverse(list_transform(string_split(regexp_extract(url, '^[a-z]+://([^/]*)', 1), '.'), x -> replace(replace(lower(x), '_', ''), '-', ''))) AS a FROM pages),
q AS (SELECT page_id, a, lead(a) OVER (ORDER BY page_id) AS b FROM p),
m AS (SELECT page_id, least(len(a), len(b)) AS n, list_transform(range(1, least(len(a), len(b)) + 1), i -> a[i] = b[i] OR contains(a[i], b[i]) OR contains(b[i], a[i])) AS same FROM q WHERE b IS NOT NULL)
SELECT page_id, round(CASE WHEN n = 0 THEN 0.0 ELSE (coalesce(nullif(list_position(same, false), 0), n + 1) - 1) / n END, 6) AS similarity FROM m""")
def package_similarity(spark: SparkSession, sf: str) -> DataFrame:
    p = _paths(spark, sf).select("page_id", "labels")
    # page_id numbers pages densely, so the next page is an equi-join, not a global window
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("labels").alias("other"))
    return p.join(nxt, "page_id").select("page_id", F.round(N.package_similarity(F.col("labels"), F.col("other")), 6).alias("similarity"))


_HEADERS = [(1, "core/src/codex.rs"), (2, "./src/My-Mod/file_name.rs"), (3, "a\\src\\b\\C_d.kt"), (4, "plain.rs"), (5, "src/lib.rs"), (6, "x/src/y/src/z.rs"), (7, "")]


@query(f"""
WITH t AS (SELECT id, regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '') AS p FROM {values(_HEADERS, 'id, path')}),
v AS (SELECT id, 1 AS o, p AS x FROM t UNION ALL SELECT id, 2, substr(p, 5) FROM t WHERE starts_with(p, 'src/') UNION ALL SELECT id, 3, substr(p, strpos(p, '/src/') + 5) FROM t WHERE strpos(p, '/src/') > 0)
SELECT DISTINCT id, translate(regexp_replace(x, '([^/])\\.[^./]*$', '\\1'), '{AZ}_-', '{az}') AS key FROM v""")
def match_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(_HEADERS, "id int, path string")
    return rows.select("id", F.explode(N.match_keys(F.col("path"))).alias("key"))


@query("SELECT user_id, round(greatest(0.0, least(100.0, (60.0 - m) / 45.0 * 100.0)), 6) AS activity FROM (SELECT user_id, ((SELECT epoch_us(max(ts)) FROM events) - epoch_us(max(ts))) / 6e7 AS m FROM events GROUP BY user_id)")
def activity_score(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    now = e.agg(F.max("ts").alias("now"))
    micros = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))
    return last.crossJoin(F.broadcast(now)).select("user_id", F.round(N.activity_score(micros / 6e7), 6).alias("activity"))


# line and text scanners

_LINES = "SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents WHERE length(text) > 0)"


@query(f"SELECT doc_id, count(*) AS total_lines, count(*) FILTER (trim(line) = '') AS blank_lines, 0::BIGINT AS comment_lines, count(*) FILTER (trim(line) <> '') AS code_lines FROM ({_LINES}) GROUP BY doc_id")
def line_stats(spark: SparkSession, sf: str) -> DataFrame:
    return X.line_stats(X.lines(table(spark, sf, "documents"), "doc_id"), "doc_id")


def _todo_lines(spark, sf):
    e = table(spark, sf, "events")
    line = F.concat(F.when(F.col("event_id") % 3 == 0, "// TODO: ").when(F.col("event_id") % 3 == 1, F.concat(F.lit("// TODO("), "event_type", F.lit("): Line "))).otherwise("# TODO: "), (F.col("event_id") % 90).cast("string"))
    return e.select(F.col("user_id").alias("path"), F.col("event_id").alias("pos"), line.alias("line"))


_TODOS = """SELECT user_id AS path, event_id AS pos, CASE event_id % 3 WHEN 0 THEN '// TODO: ' WHEN 1 THEN '// TODO(' || event_type || '): Line ' ELSE '# TODO: ' END || (event_id % 90) AS line FROM events"""
_TODO = "//[ \\t]*TODO([(][^)]*[)])?: *(.+)"


@query(f"""SELECT path, pos, coalesce(nullif(translate(regexp_extract(line, '{_TODO}', 1), '()', ''), ''), 'untagged') AS tag, trim(regexp_extract(line, '{_TODO}', 2)) AS message,
try_cast(nullif(regexp_extract(regexp_extract(line, '{_TODO}', 2), '(?i)\\bline\\s+(\\d+)', 1), '') AS INTEGER) AS source_line FROM ({_TODOS}) WHERE regexp_matches(line, '{_TODO}')""")
def todo_scan(spark: SparkSession, sf: str) -> DataFrame:
    return X.todos(_todo_lines(spark, sf))


@query(f"SELECT coalesce(nullif(translate(regexp_extract(line, '{_TODO}', 1), '()', ''), ''), 'untagged') AS tag, count(*) AS n FROM ({_TODOS}) WHERE regexp_matches(line, '{_TODO}') GROUP BY 1")
def todo_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    return X.todos(_todo_lines(spark, sf)).groupBy("tag").agg(F.count("*").alias("n"))


_CONTEXT = [("a", k + 1, t) for k, t in enumerate(["x", "// TODO: one", "y", "// TODO(b): two", "z", "", "w", "v", "# TODO: no"])]


@query(f"""WITH t AS (SELECT * FROM {values(_CONTEXT, 'path, pos, line')}) SELECT path, pos,
(SELECT string_agg(CASE WHEN u.pos = t.pos THEN '>>> ' ELSE '    ' END || lpad(u.pos::VARCHAR, 4, ' ') || ': ' || u.line, chr(10) ORDER BY u.pos) FROM t u WHERE u.path = t.path AND u.pos BETWEEN t.pos - 3 AND t.pos + 3) AS context FROM t WHERE regexp_matches(line, '{_TODO}')""")
def todo_context(spark: SparkSession, sf: str) -> DataFrame:
    return X.todo_context(spark.createDataFrame(_CONTEXT, "path string, pos int, line string"))


_HEADER_LINES = [
    ("a.kt", 1, "// port-lint: source core/src/codex.rs"), ("b.kt", 2, "// PORT-LINT: SOURCE codex-rs/x/y.rs"), ("c.kt", 50, "// port-lint: tests t/z.rs"),
    ("d.kt", 51, "// port-lint: source late.rs"), ("e.kt", 3, "// Transliterated from: m/n.hpp "), ("e.kt", 4, "// port-lint: source second.rs"), ("f.kt", 1, "/* port-lint: source block.rs */"), ("g.kt", 1, "nothing"),
]


@query(f"""WITH t AS (SELECT * FROM {values(_HEADER_LINES, 'path, pos, line')}), h AS (SELECT path, pos,
coalesce(nullif(regexp_replace(trim(regexp_extract(line, 'Transliterated from:\\s*(.+)', 1)), '^codex-rs/', ''), ''),
  CASE WHEN regexp_matches(line, '(?i)port-lint:[ ]*(tests|source) +([^ ]+)') THEN CASE WHEN lower(regexp_extract(line, '(?i)port-lint:[ ]*(tests|source)', 1)) = 'tests' THEN 'tests:' ELSE '' END || regexp_replace(regexp_extract(line, '(?i)port-lint:[ ]*(tests|source) +([^ ]+)', 2), '^codex-rs/', '') END) AS origin FROM t WHERE pos <= 50)
SELECT path, arg_min(origin, pos) AS origin FROM h WHERE origin IS NOT NULL GROUP BY path""")
def header_extract(spark: SparkSession, sf: str) -> DataFrame:
    return X.provenance(spark.createDataFrame(_HEADER_LINES, "path string, pos int, line string"))


_MARKS = "|".join(X.MARKERS)


@query(f"SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_])({_MARKS})($|[^a-z0-9_])|not (yet )?implemented') AS marked FROM documents")
def stub_markers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.has_markers(F.col("text")).alias("marked"))


_COMMENTS = [(1, "// TODO later"), (2, "//todos"), (3, "/* FIXME: x */"), (4, " * stub"), (5, "# Placeholder."), (6, "// we do not stub"), (7, "/// unimplemented!"), (8, "//"), (9, "todo_list")]


@query(f"SELECT id, regexp_matches(lower(line), '^\\s*(//+|#+|/\\*+|\\*+)?[!/*\\s]*({_MARKS})($|[^a-z0-9_])') AS marked FROM {values(_COMMENTS, 'id, line')}")
def comment_stub_markers(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(_COMMENTS, "id int, line string").select("id", X.comment_has_markers(F.col("line")).alias("marked"))


_FILES = [
    ("a.hpp", "#pragma once\nnamespace x {\n}\n"), ("b.hpp", "int f(int a) { return a; }\n" * 12), ("c.html", "no guard here"), ("d.h", "#ifndef D\n#define D\n#endif\n"),
    ("e.cpp", "// only a comment\nimport foo;\n"), ("f.cpp", "x" * 99), ("g.cpp", "x" * 100), ("m.rs", "// wiring\npub mod a;\nuse b::c;\n#[cfg(x)]\nmod d;\n"), ("n.rs", "mod a;\nfn main() {}\n"),
]


def _strip_sql(c: str) -> str:
    for p in X._BOILERPLATE:
        c = f"regexp_replace({c}, '{p}', '', 'g')"
    return c


@query(f"SELECT path, length({_strip_sql('text')}) AS left_chars, length({_strip_sql('text')}) < 100 AS stub FROM {values(_FILES, 'path, text')}")
def stub_files(spark: SparkSession, sf: str) -> DataFrame:
    f = spark.createDataFrame(_FILES, "path string, text string")
    return f.select("path", F.length(X.stripped(F.col("text"))).alias("left_chars"), X.is_stub_file(F.col("text")).alias("stub"))


@query(f"SELECT path, contains(path, '.h') AND NOT contains(text, '#pragma once') AND NOT contains(text, '#ifndef') AS missing_guard FROM {values(_FILES, 'path, text')}")
def missing_guard(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(_FILES, "path string, text string").select("path", X.lacks_guard(F.col("path"), F.col("text")).alias("missing_guard"))


@query(f"""SELECT path, NOT list_contains(list_transform(list_filter(list_transform(string_split(regexp_replace(text, '//[^\\n]*', '', 'g'), chr(10)), x -> trim(x)), x -> x <> ''),
x -> regexp_matches(x, '^(#!?\\[|(pub(\\([a-z]+\\))?\\s+)?(mod|use|extern crate)\\b)')), false) AS wiring FROM {values(_FILES, 'path, text')}""")
def module_wiring(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(_FILES, "path string, text string").select("path", X.only_wires_modules(F.col("text")).alias("wiring"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'th', ''))) // 2 AS th, (length(text) - length(replace(text, '. ', ''))) // 2 AS stops FROM documents")
def needle_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.occurrences(F.col("text"), "th").alias("th"), X.occurrences(F.col("text"), ". ").alias("stops"))


# tokens

_RAW = '''regexp_extract_all(text, '//[^\\n]*|/\\*(?s:.*?)(?:\\*/|$)|"[^"\\\\]*(?:\\\\.[^"\\\\]*)*"?|''[^''\\\\]*(?:\\\\.[^''\\\\]*)*''?|[0-9][A-Za-z0-9_.]*|[_A-Za-z][0-9A-Za-z_]*|::|\\?\\.|->|=>|==|!=|<=|>=|&&|\\|\\||\\+=|-=|\\*=|/=|%=|[^\\t\\n\\x0B\\f\\r ]')'''
# each byte outside ASCII is a token of its own, written as the Latin-1 letter of its number
_TOKENS = f"""flatten(list_transform({_RAW}, t -> CASE WHEN regexp_matches(t, '^[^\\x00-\\x7F]') THEN list_transform(regexp_extract_all(hex(encode(t)), '..'), h -> chr(('0x' || h)::INTEGER)) ELSE [t] END))"""
_ALIASED = "CASE " + " ".join(f"WHEN c = '{k}' THEN '{v}'" for k, v in K.ALIASES.items()) + " ELSE c END"
_NORMAL = f"""list_filter(list_transform({_TOKENS}, t -> CASE WHEN starts_with(t, '//') OR starts_with(t, '/*') OR t IN (';', '@', '#') THEN '' WHEN t[1:1] IN ('"', '''') THEN 'str'
WHEN regexp_matches(t, '^[0-9]') THEN 'num:' || t WHEN regexp_matches(t, '^[A-Za-z_]') THEN translate(t, '{AZ}_', '{az}') WHEN t IN ('::', '?.') THEN '.' WHEN t IN ('->', '=>') THEN 'arrow' ELSE t END), t -> t <> '')"""
_ALIAS_LIST = "list_transform(%s, c -> " + _ALIASED + ")"
_TURN_TOKENS = f"turns AS (SELECT conv_id * 1000 + turn AS unit, {_ALIAS_LIST % _NORMAL} AS toks FROM conversations)"
_TURN_PAIRS = "pairs AS (SELECT conv_id * 1000 + turn AS a, conv_id * 1000 + turn + 1 AS b FROM conversations x WHERE EXISTS (SELECT 1 FROM conversations y WHERE y.conv_id = x.conv_id AND y.turn = x.turn + 1))"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "conversations").select("conv_id", "turn", "text")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("unit"), "text")


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn and the next of its conversation."""
    units = table(spark, sf, "conversations").select("conv_id", "turn")
    after = units.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return units.join(after, ["conv_id", "turn"], "left_semi").select((F.col("conv_id") * 1000 + F.col("turn")).alias("a"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("b"))


def _pair_sql(counts: str, tag: str = "") -> str:
    """CTEs that end in pm{tag}(a, b, cosine, jaccard, multiset_jaccard) over counts(unit, term, n)."""
    return f"""sz{tag} AS (SELECT unit, count(*) AS t, sum(n) AS s, sqrt(sum(n * n)) AS q FROM {counts} GROUP BY unit),
mt{tag} AS (SELECT a, b, sum(x.n * y.n) AS dot, count(*) AS c, sum(least(x.n, y.n)) AS o FROM pairs JOIN {counts} x ON x.unit = a JOIN {counts} y ON y.unit = b AND y.term = x.term GROUP BY a, b),
pm{tag} AS (SELECT p.a, p.b, CASE WHEN x.q IS NULL OR y.q IS NULL THEN 0.0 ELSE coalesce(dot, 0) / (x.q * y.q) END AS cosine,
 CASE WHEN x.t IS NULL AND y.t IS NULL THEN 1.0 ELSE coalesce(c, 0)::DOUBLE / (coalesce(x.t, 0) + coalesce(y.t, 0) - coalesce(c, 0)) END AS jaccard,
 CASE WHEN x.s IS NULL AND y.s IS NULL THEN 1.0 ELSE coalesce(o, 0)::DOUBLE / (coalesce(x.s, 0) + coalesce(y.s, 0) - coalesce(o, 0)) END AS multiset_jaccard
 FROM pairs p LEFT JOIN mt{tag} m ON m.a = p.a AND m.b = p.b LEFT JOIN sz{tag} x ON x.unit = p.a LEFT JOIN sz{tag} y ON y.unit = p.b)"""


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in cols else c for c in df.columns))


@query(f"""WITH {_TURN_TOKENS}, {_TURN_PAIRS}, tc AS (SELECT unit, term, count(*) AS n FROM (SELECT unit, unnest(toks) AS term FROM turns) GROUP BY ALL),
gc AS (SELECT DISTINCT unit, array_to_string(toks[i:i+4], chr(1)) AS term, 1 AS n FROM (SELECT unit, toks, unnest(range(1, greatest(len(toks) - 4, 1) + 1)) AS i FROM turns WHERE len(toks) > 0)),
{_pair_sql('tc')}, {_pair_sql('gc', 'g')}
SELECT a, b, round(p.cosine, 6) AS token_cosine, round(p.jaccard, 6) AS token_jaccard, round(g.jaccard, 6) AS kgram_jaccard, round(0.55 * p.cosine + 0.25 * p.jaccard + 0.2 * g.jaccard, 6) AS score FROM pm p JOIN pmg g USING (a, b)""")
def translit_turn_similarity(spark: SparkSession, sf: str) -> DataFrame:
    units = turns(spark, sf).select("unit", K.tokens(F.col("text")).alias("toks"))
    pairs = turn_pairs(spark, sf)
    tok = M.paired(pairs, K.exploded(units, F.col("toks"), "unit"))
    grams = M.paired(pairs, units.select("unit", F.explode(K.kgram_hashes(F.col("toks"))).alias("term"), F.lit(1).alias("n")))
    both = tok.select("a", "b", "cosine", "jaccard").join(grams.select("a", "b", F.col("jaccard").alias("kgram")), ["a", "b"])
    r = lambda c: F.round(c, 6)
    return both.select("a", "b", r("cosine").alias("token_cosine"), r("jaccard").alias("token_jaccard"), r("kgram").alias("kgram_jaccard"), r(M.transliteration(F.col("cosine"), F.col("jaccard"), F.col("kgram"))).alias("score"))


@query(f"WITH t AS (SELECT unnest({_ALIAS_LIST % _NORMAL}) AS term, doc_id FROM documents) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY term ORDER BY n DESC, term LIMIT 100")
def token_freq_top(spark: SparkSession, sf: str) -> DataFrame:
    return K.frequencies(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id").orderBy(F.desc("n"), "term").limit(100)


@query(f"""WITH g AS (SELECT doc_id AS id, toks FROM (SELECT doc_id, {_ALIAS_LIST % _NORMAL} AS toks FROM documents) WHERE len(toks) >= 5),
h AS (SELECT item_id AS id, toks FROM (SELECT item_id, {_ALIAS_LIST % _NORMAL} AS toks FROM benchmark) WHERE len(toks) >= 5),
dg AS (SELECT DISTINCT id AS doc_id, array_to_string(toks[i:i+4], chr(1)) AS g FROM (SELECT id, toks, unnest(range(1, len(toks) - 3)) AS i FROM g)),
bg AS (SELECT DISTINCT id AS item_id, array_to_string(toks[i:i+4], chr(1)) AS g FROM (SELECT id, toks, unnest(range(1, len(toks) - 3)) AS i FROM h)),
s AS (SELECT item_id, count(*) AS total FROM bg GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, round(count(*)::DOUBLE / any_value(total), 6) AS share FROM dg JOIN bg USING (g) JOIN s USING (item_id) GROUP BY doc_id, item_id""")
def kgram_contamination(spark: SparkSession, sf: str) -> DataFrame:
    texts = lambda name, key: spread(table(spark, sf, name).select(key, "text"))
    items = K.kgram_rows(texts("benchmark", "item_id"), "item_id").distinct()
    total = items.groupBy("item_id").agg(F.count("*").alias("total"))
    docs = K.kgram_rows(texts("documents", "doc_id"), "doc_id", K.known_kgrams(items)).distinct()
    return docs.join(items, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared")).join(total, "item_id").select("doc_id", "item_id", "shared", F.round(F.col("shared") / F.col("total"), 6).alias("share"))


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_DOCW = f"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), w -> lower(w)), w -> length(w) >= 3 AND w NOT IN ({_STOP}))"


@query(f"""WITH {_TURN_PAIRS}, wc AS (SELECT unit, term, count(*) AS n FROM (SELECT conv_id * 1000 + turn AS unit, unnest({_DOCW}) AS term FROM conversations) GROUP BY ALL), {_pair_sql('wc')}
SELECT a, b, round(cosine, 6) AS doc_cosine, round(jaccard, 6) AS doc_jaccard FROM pm""")
def doc_word_similarity(spark: SparkSession, sf: str) -> DataFrame:
    counts = K.exploded(turns(spark, sf), X.doc_words(F.col("text")), "unit")
    return M.paired(turn_pairs(spark, sf), counts).select("a", "b", F.round("cosine", 6).alias("doc_cosine"), F.round("jaccard", 6).alias("doc_jaccard"))


_RAWID = "list_filter(regexp_extract_all(text, '[_A-Za-z][0-9A-Za-z_]*'), w -> length(w) > 1 AND w NOT IN ('it', 'this'))"


@query(f"""WITH {_TURN_PAIRS}, raw AS (SELECT conv_id * 1000 + turn AS unit, unnest({_RAWID}) AS term FROM conversations),
rc AS (SELECT unit, term, count(*) AS n FROM raw GROUP BY ALL), cc AS (SELECT unit, {_CANON % 'term'} AS term, count(*) AS n FROM raw GROUP BY ALL), {_pair_sql('rc')}, {_pair_sql('cc', 'c')}
SELECT a, b, round(p.cosine, 6) AS raw_cosine, round(c.cosine, 6) AS canonical_cosine, round(c.jaccard, 6) AS canonical_jaccard FROM pm p JOIN pmc c USING (a, b)""")
def identifier_similarity(spark: SparkSession, sf: str) -> DataFrame:
    words = F.filter(F.regexp_extract_all("text", F.lit("([_A-Za-z][0-9A-Za-z_]*)"), 1), lambda w: (F.length(w) > 1) & ~w.isin("it", "this"))
    raw = K.exploded(turns(spark, sf), words, "unit")
    canon = raw.groupBy("unit", N.canonical(F.col("term")).alias("term")).agg(F.sum("n").alias("n"))
    pairs = turn_pairs(spark, sf)
    a = M.paired(pairs, raw).select("a", "b", F.round("cosine", 6).alias("raw_cosine"))
    return a.join(M.paired(pairs, canon).select("a", "b", F.round("cosine", 6).alias("canonical_cosine"), F.round("jaccard", 6).alias("canonical_jaccard")), ["a", "b"])


# vectors

_VEC = "SELECT vec_id, label, list_transform(embedding, x -> x::DOUBLE) AS v FROM embeddings"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query(f"WITH e AS ({_VEC}) SELECT a.vec_id, round(CASE WHEN sqrt(list_dot_product(a.v, a.v)) < 1e-8 OR sqrt(list_dot_product(b.v, b.v)) < 1e-8 THEN 0 ELSE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) END, 6) AS cosine, round(sqrt(list_dot_product(a.v, a.v)), 6) AS norm FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def tensor_cosine(spark: SparkSession, sf: str) -> DataFrame:
    e = _vectors(spark, sf)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(L.cosine(F.col("v"), F.col("w")), 6).alias("cosine"), F.round(L.norm(F.col("v")), 6).alias("norm"))


@query(f"WITH e AS ({_VEC}), m AS (SELECT vec_id, list_transform(v, x -> exp(x - list_max(v))) AS e FROM e) SELECT vec_id, round(list_max(e) / list_sum(e), 6) AS top, round(e[1] / list_sum(e), 6) AS first FROM m")
def tensor_softmax(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("vec_id", L.softmax(F.col("v")).alias("s")).select("vec_id", F.round(F.array_max("s"), 6).alias("top"), F.round(F.col("s")[0], 6).alias("first"))


@query(f"WITH e AS ({_VEC}) SELECT vec_id, round(list_sum(list_transform(v, x -> 1 / (1 + exp(-x)))), 6) AS sigmoid, round(list_sum(list_transform(v, x -> (exp(2 * x) - 1) / (exp(2 * x) + 1))), 6) AS tanh, round(list_sum(list_transform(v, x -> greatest(x, 0.0))), 6) AS relu, round(list_sum(list_transform(v, x -> abs(x))), 6) AS absolute FROM e")
def tensor_activations(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    return _vectors(spark, sf).select("vec_id", *(F.round(L.total(f(v)), 6).alias(n) for n, f in (("sigmoid", L.sigmoid), ("tanh", L.tanh), ("relu", L.relu), ("absolute", L.absolute))))


@query(f"""WITH e AS ({_VEC}), x AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e),
s AS (SELECT label, list(t ORDER BY i) AS r FROM (SELECT label, i, sum(x) AS t FROM x GROUP BY label, i) GROUP BY label), m AS (SELECT list(r ORDER BY label) AS rows FROM s)
SELECT vec_id, round(list_sum(list_transform(rows, r -> list_dot_product(r, v))), 6) AS product, round(list_max(list_transform(rows, r -> list_dot_product(r, v))), 6) AS most,
round(list_sum(list_transform(list_zip(v, r), p -> p[1] + p[2] - p[1] * p[2])), 6) AS elementwise FROM e JOIN s USING (label) CROSS JOIN m""")
def tensor_matvec(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix has a row for each label: the sum of its vectors, made of partial sums where they are."""
    e = _vectors(spark, sf)
    sums = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("r"))  # as many as a vector has
    matrix = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "r"))), lambda s: s["r"]).alias("rows"))  # as many as there are labels
    j = e.join(F.broadcast(rows), "label").join(F.broadcast(matrix))
    v, r, product = F.col("v"), F.col("r"), L.matvec(F.col("rows"), F.col("v"))
    return j.select("vec_id", F.round(L.total(product), 6).alias("product"), F.round(F.array_max(product), 6).alias("most"), F.round(L.total(L.sub(L.add(v, r), L.hadamard(v, r))), 6).alias("elementwise"))
