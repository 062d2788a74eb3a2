"""Queries on matching, symbols, reports and the work queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import matching as J
from ..operators import reports as R
from ..operators import similarity as M
from ..operators import symbols as P
from ..operators import tasks as K
from ..partitions import by_key
from ..streaming import tasks as S
from .registry import query, table, values
from .tree_queries import _IMPORTS, degrees, unit_degrees, units

AZ, az = N.UPPER, N.LOWER
_PASCAL = "array_to_string(list_transform(string_split(%s, '_'), p -> upper(p[1:1]) || p[2:]), '')"

# units of two corpora, and their headers

_CORPORA = f"""u AS (SELECT p_partkey, lower(p_type) AS dir, replace(p_name, ' ', '_') || '_' || p_partkey AS stem FROM part),
src AS (SELECT dir || '/' || stem AS key, 'src/' || dir || '/' || stem || '.rs' AS path FROM u),
tgt AS (SELECT dir || '/' || {_PASCAL % 'stem'} || '.kt' AS key, CASE WHEN p_partkey % 2 = 1 THEN NULL WHEN p_partkey % 4 = 0 THEN 'src/' || dir || '/' || stem || '.rs'
 WHEN p_partkey % 6 = 2 THEN 'lib/src/' || dir || '/' || stem || '.rs' ELSE 'old/' || stem || '.rs' END AS origin FROM u WHERE p_partkey % 3 <> 0),
t AS (SELECT key AS tgt, origin FROM tgt WHERE origin IS NOT NULL),
sv AS (SELECT key AS src, translate(regexp_replace(path, '\\.rs$', ''), '{AZ}_-', '{az}') AS k FROM src UNION SELECT key, translate(regexp_replace(substr(path, 5), '\\.rs$', ''), '{AZ}_-', '{az}') FROM src),
tv AS (SELECT tgt, translate(regexp_replace(x, '\\.rs$', ''), '{AZ}_-', '{az}') AS k FROM (SELECT tgt, origin AS x FROM t UNION SELECT tgt, substr(origin, 5) FROM t WHERE starts_with(origin, 'src/') UNION SELECT tgt, substr(origin, strpos(origin, '/src/') + 5) FROM t WHERE strpos(origin, '/src/') > 0)),
scores AS (SELECT src, tgt, max(score) AS score FROM (
 SELECT key AS src, tgt, 1.0::DOUBLE AS score FROM src JOIN t ON path = origin UNION ALL SELECT src, tgt, 0.99 FROM sv JOIN tv USING (k)
 UNION ALL SELECT s.src, v.tgt, 0.85 FROM (SELECT DISTINCT src, string_split(k, '/')[-1] AS b FROM sv) s JOIN (SELECT DISTINCT tgt, string_split(k, '/')[-1] AS b FROM tv) v USING (b)) GROUP BY src, tgt)"""


def corpora(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    # a small file can be one task's, whatever its rows; their paths are worked on where they are spread
    part = by_key(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), "p_partkey")
    u = units(spark, sf, part).select("p_partkey", F.split("key", "/")[0].alias("dir"), "stem")
    path = F.concat(F.lit("src/"), "dir", F.lit("/"), "stem", F.lit(".rs"))
    k = F.col("p_partkey")
    origin = F.when(k % 2 == 1, F.lit(None)).when(k % 4 == 0, path).when(k % 6 == 2, F.concat(F.lit("lib/"), path)).otherwise(F.concat(F.lit("old/"), "stem", F.lit(".rs")))
    tgt = u.filter("p_partkey % 3 <> 0").select(F.concat("dir", F.lit("/"), N.pascal(F.col("stem")), F.lit(".kt")).alias("key"), origin.alias("origin"))
    return u.select(F.concat("dir", F.lit("/"), "stem").alias("key"), path.alias("path")), tgt


@query(f"WITH {_CORPORA} SELECT src, tgt, score FROM scores")
def header_match_scores(spark: SparkSession, sf: str) -> DataFrame:
    return J.header_scores(*corpora(spark, sf))


_GREEDY = """e AS (SELECT src, tgt, score, row_number() OVER (ORDER BY score DESC, length(tgt), tgt, src) AS rk FROM edges),
walk(rk, us, ut, took) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], false
 UNION ALL SELECT e.rk, CASE WHEN f THEN list_append(us, e.src) ELSE us END, CASE WHEN f THEN list_append(ut, e.tgt) ELSE ut END, f FROM (SELECT w.us, w.ut, e.*, NOT (list_contains(w.us, e.src) OR list_contains(w.ut, e.tgt)) AS f FROM walk w JOIN e ON e.rk = w.rk + 1) e),
matches AS (SELECT e.src, e.tgt, e.score FROM walk JOIN e USING (rk) WHERE took)"""

_SMALL_S = [("flow/channels", "channels", "flow.channels", ["flow"]), ("sync/mutex", "mutex", "sync.mutex", ["sync"]), ("ui/logo", "logo", "ui.logo", ["ui", "logo"]), ("x/alpha", "alpha", "x.alpha", ["x"]), ("flow/mutex", "mutex", "flow.mutex", ["flow"]), ("q/z", "z", "q.z", [])]
_SMALL_T = [
    ("flow/Channels.hpp", "Channels", "flow.Channels", ["flow"], True), ("flow/Channels.cpp", "Channels", "flow.Channels", ["flow"], False), ("a/Mutex.kt", "Mutex", "a.Mutex", ["a"], False), ("sync/Mu_tex.kt", "Mu_tex", "sync.Mu_tex", ["sync"], False),
    ("w/RatatuiLogo.kt", "RatatuiLogo", "w.RatatuiLogo", ["w"], False), ("x/Beta.kt", "Beta", "x.Beta", ["x"], False), ("k/UiKit.kt", "UiKit", "k.UiKit", ["k", "ui"], False), ("n/None.kt", "None", "n.None", [], False),
]


def _canon(c: str) -> str:
    return f"translate({c}, '{AZ}_', '{az}')"


def _pkg(c: str) -> str:
    return f"translate({c}, '{AZ}_-', '{az}')"


_NAMES = f"""s AS (SELECT key, stem, q, pk, {_canon('stem')} AS sn, {_canon('q')} AS sq, {_canon("regexp_replace(q, '[.][^.]*$', '')")} AS sp, list_reverse(list_transform(pk, x -> {_pkg('x')})) AS a FROM {values(_SMALL_S, 'key, stem, q, pk')}),
t AS (SELECT key, stem, q, pk, h, {_canon('stem')} AS tn, {_canon('q')} AS tq, {_canon("regexp_replace(q, '[.][^.]*$', '')")} AS tp, list_reverse(list_transform(pk, x -> {_pkg('x')})) AS b FROM {values(_SMALL_T, 'key, stem, q, pk, h')}),
pr AS (SELECT s.key AS src, t.key AS tgt, h, sn, tn, sq, tq, sp, tp, a, b, least(len(a), len(b)) AS n, list_transform(range(1, least(len(a), len(b)) + 1), i -> a[i] = b[i] OR contains(a[i], b[i]) OR contains(b[i], a[i])) AS same FROM s CROSS JOIN t),
ps AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE (coalesce(nullif(list_position(same, false), 0), n + 1) - 1)::DOUBLE / n END AS sim FROM pr),
scored AS (SELECT src, tgt, coalesce(CASE WHEN sq = tq THEN 1.0 WHEN sn = tn AND sp = tp AND sp <> '' THEN 0.95 WHEN sn = tn THEN 0.7 WHEN contains(tn, sn) THEN 0.5 + 0.2 * length(sn) / length(tn) WHEN contains(sn, tn) THEN 0.5 + 0.2 * length(tn) / length(sn)
 WHEN len(a) > 0 AND len(b) > 0 AND sim > 0.5 THEN sim * 0.6 WHEN len(a) > 0 AND contains(tn, a[1]) THEN 0.5 WHEN len(b) > 0 AND contains(sn, b[1]) THEN 0.5 WHEN sp = tp AND sp <> '' THEN 0.4 END::DOUBLE + CASE WHEN h THEN 0.02 ELSE 0.0 END, 0.0) AS score FROM ps)"""


def _small(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(_SMALL_S, "key string, stem string, qualified string, package array<string>"), spark.createDataFrame(_SMALL_T, "key string, stem string, qualified string, package array<string>, header boolean")


@query(f"WITH {_NAMES} SELECT src, tgt, round(score, 6) AS score FROM scored WHERE score > 0.4")
def name_match_scores(spark: SparkSession, sf: str) -> DataFrame:
    return J.name_scores(*_small(spark)).withColumn("score", F.round("score", 6))


@query(f"WITH RECURSIVE {_NAMES}, edges AS (SELECT src, tgt, round(score, 9) AS score FROM scored WHERE score > 0.4), {_GREEDY} SELECT src, tgt, round(score, 6) AS score FROM matches")
def greedy_name_match(spark: SparkSession, sf: str) -> DataFrame:
    edges = J.name_scores(*_small(spark)).withColumn("score", F.round("score", 9))
    return J.greedy(edges).withColumn("score", F.round("score", 6))


_LOOSE_S = [("f", "a/Flow.kt", "a.Flow"), ("s", "a/StateFlow.kt", "a.StateFlow"), ("m", "lib/mod.rs", "lib.mod")]
_LOOSE_T = [("t1", "x/a/Flow.kt", "a.flow"), ("t2", "b/StateFlow.kt", "z.q"), ("t3", "z/Flow.rs", "a.q"), ("t4", "mod.rs", "lib.q"), ("t5", "tests:lib/mod.rs", "u.q"), ("t6", None, "u.q")]


@query(f"""WITH s AS (SELECT key AS src, path, string_split(path, '/')[-1] AS f, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem, {_canon("regexp_replace(q, '[.][^.]*$', '')")} AS sd FROM {values(_LOOSE_S, 'key, path, q')}),
t AS (SELECT key AS tgt, regexp_replace(origin, '^tests:', '') AS o, {_canon("regexp_replace(q, '[.][^.]*$', '')")} AS td FROM {values(_LOOSE_T, 'key, origin, q')} WHERE origin IS NOT NULL),
p AS (SELECT src, tgt, CASE WHEN contains(o, path) THEN 1.0 WHEN (ends_with(o, '/' || f) OR o = f) AND sd = td THEN 0.9 WHEN ends_with(o, '/' || f) OR o = f THEN 0.5 WHEN regexp_matches(o, '/' || stem || '\\.(kt|rs|py|cpp|cc|hpp|h)$') THEN 0.3 ELSE 0.0 END::DOUBLE AS score FROM s CROSS JOIN t)
SELECT src, tgt, score FROM p WHERE score > 0""")
def loose_header_scores(spark: SparkSession, sf: str) -> DataFrame:
    return J.loose_header_scores(spark.createDataFrame(_LOOSE_S, "key string, path string, qualified string"), spark.createDataFrame(_LOOSE_T, "key string, origin string, qualified string"))


_HEADER_MATCHES = f"{_CORPORA}, edges AS (SELECT * FROM scores), {_GREEDY}"


def _header_matches(spark, sf):
    s, t = corpora(spark, sf)
    edges = J.header_scores(s, t)
    return s, t, edges, J.greedy(edges)


@query(f"WITH RECURSIVE {_HEADER_MATCHES} SELECT src, tgt, score FROM matches")
def greedy_header_match(spark: SparkSession, sf: str) -> DataFrame:
    return _header_matches(spark, sf)[3]


_TIES = [("s1", "t1", 0.9), ("s1", "t2", 0.8), ("s2", "t1", 0.85), ("s2", "t2", 0.1), ("s3", "t2", 0.8), ("s4", "t3", 0.5), ("s4", "t44", 0.5), ("s5", "t5", 0.7), ("s5", "t6", 0.6), ("s5", "t7", 0.65), ("s1", "t7", 0.65)]
_TIE_SQL = f"edges AS (SELECT src, tgt, score::DOUBLE AS score FROM {values(_TIES, 'src, tgt, score')}), {_GREEDY}"


@query(f"WITH RECURSIVE {_TIE_SQL} SELECT e.tgt, arg_min(e.src, (-e.score, e.src)) AS src, max(e.score) AS score FROM edges e WHERE e.tgt NOT IN (SELECT tgt FROM matches) AND e.src IN (SELECT src FROM matches) GROUP BY e.tgt")
def pooled_targets(spark: SparkSession, sf: str) -> DataFrame:
    edges = spark.createDataFrame(_TIES, "src string, tgt string, score double")
    return J.pooled(edges, J.greedy(edges))


@query(f"WITH RECURSIVE {_HEADER_MATCHES} SELECT key FROM src WHERE key NOT IN (SELECT src FROM matches)")
def unmatched_src(spark: SparkSession, sf: str) -> DataFrame:
    s, _, _, m = _header_matches(spark, sf)
    return J.unmatched(s, m, "src").select("key")


@query(f"WITH RECURSIVE {_HEADER_MATCHES} SELECT key FROM tgt WHERE key NOT IN (SELECT tgt FROM matches)")
def unmatched_tgt(spark: SparkSession, sf: str) -> DataFrame:
    _, t, _, m = _header_matches(spark, sf)
    return J.unmatched(t, m, "tgt").select("key")


@query("SELECT p_partkey, p_size > 20 AND (p_partkey % 30)::DOUBLE / greatest(p_size, 1) < 0.3 AS stub FROM part")
def ratio_stub(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", J.ratio_stub(F.col("p_size"), F.col("p_partkey") % 30).alias("stub"))


_CANDIDATES = [(1, "f", 1, 1, 0.9, False, False), (1, "f", 1, 2, 0.8, False, False), (1, "f", 2, 1, 0.85, False, False), (1, "f", 2, 2, 0.1, False, False), (1, "g", 3, 3, 0.7, False, True), (2, "h", 1, 1, 0.4, True, True)]
_SOURCES = [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (3, 1)]


@query(f"""WITH s AS (SELECT pair, count(*) AS n FROM {values(_SOURCES, 'pair, f')} GROUP BY 1), m(pair, matched, total) AS (VALUES (1, 3, 1.0), (2, 1, 0.4))
SELECT s.pair, coalesce(matched, 0) AS matched, round(coalesce(total, 0.0) / n, 6) AS score FROM s LEFT JOIN m ON m.pair = s.pair""")
def function_set_score(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.createDataFrame(_CANDIDATES, "pair int, name string, src_fn int, tgt_fn int, sim double, src_stub boolean, tgt_stub boolean")
    return J.function_score(c, spark.createDataFrame(_SOURCES, "pair int, f int")).withColumn("score", F.round("score", 6))


# functions of two versions of a unit, from line items: the order is the unit, the flags and line numbers the names
_FN = """sf AS (SELECT l_orderkey AS pair, 'fn_' || l_returnflag || '_' || (l_linenumber % 4) AS name, l_linestatus = 'O' AS is_test, l_quantity < 10 AS has_stub, l_linenumber AS pos FROM lineitem),
tf AS (SELECT l_orderkey AS pair, 'fn' || l_returnflag || (l_linenumber % 3) AS name, l_linestatus = 'O' AS is_test, l_quantity < 25 AS has_stub, l_linenumber AS pos FROM lineitem)"""


def functions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li, n, m = table(spark, sf, "lineitem"), *((F.col("l_linenumber") % k).cast("string") for k in (4, 3))
    make = lambda d, name, few: d.select(F.col("l_orderkey").alias("pair"), name.alias("name"), (F.col("l_linestatus") == "O").alias("is_test"), (F.col("l_quantity") < few).alias("has_stub"), F.col("l_linenumber").alias("pos"))
    return make(li, F.concat(F.lit("fn_"), "l_returnflag", F.lit("_"), n), 10), make(li, F.concat(F.lit("fn"), "l_returnflag", m), 25)


@query(f"""WITH {_FN}, s AS (SELECT pair, {_canon('name')} AS name, arg_min(is_test, (pos, is_test)) AS is_test FROM sf GROUP BY 1, 2), t AS (SELECT pair, {_canon('name')} AS name, bool_or(is_test) AS tests FROM tf GROUP BY 1, 2)
SELECT s.pair, count(*) AS total, count(*) FILTER (t.name IS NOT NULL AND (NOT s.is_test OR t.tests)) AS matched FROM s LEFT JOIN t ON t.pair = s.pair AND t.name = s.name GROUP BY s.pair""")
def function_name_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return J.name_coverage(*functions(spark, sf))


@query(f"""WITH {_FN}, s AS (SELECT pair, {_canon('name')} AS name, count(*) AS n FROM sf GROUP BY 1, 2), t AS (SELECT pair, {_canon('name')} AS name, count(*) AS n FROM tf GROUP BY 1, 2)
SELECT s.pair, sum(s.n) AS total, sum(least(s.n, coalesce(t.n, 0))) AS matched FROM s LEFT JOIN t ON t.pair = s.pair AND t.name = s.name GROUP BY s.pair""")
def bag_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return J.bag_coverage(*functions(spark, sf))


@query(f"""WITH {_FN}, s AS (SELECT pair, {_canon('name')} AS k, min(name) AS name FROM sf GROUP BY 1, 2), t AS (SELECT DISTINCT pair, {_canon('name')} AS k FROM tf)
SELECT s.pair, count(*) AS total, count(t.k) AS matched, coalesce(string_agg(name, ',' ORDER BY name) FILTER (t.k IS NULL), '') AS missing FROM s LEFT JOIN t ON t.pair = s.pair AND t.k = s.k GROUP BY s.pair""")
def type_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return J.type_coverage(*functions(spark, sf))


@query(f"WITH {_FN} SELECT pair, {_canon('name')} AS name FROM tf WHERE has_stub EXCEPT ALL SELECT pair, {_canon('name')} FROM sf WHERE has_stub")
def stub_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return J.stub_mismatch(*functions(spark, sf))


# symbols

_KINDS = ["FUNCTION", "STRUCT", "ENUM", "TRAIT", "IMPL_METHOD"]
_SYMS = f"""b AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') || '_' || (p_partkey % 50) AS name, {_KINDS}[p_size % 5 + 1] AS kind, p_type[1:1] || lower(p_type[2:]) AS owner, p_size, lower(p_type) || '.rs' AS file FROM part),
ss AS (SELECT id, name, kind, CASE WHEN kind = 'IMPL_METHOD' THEN owner ELSE '' END AS parent, p_size % 7 = 0 AS is_test, file FROM b),
cm AS (SELECT *, {_PASCAL % 'name'} AS pc FROM b WHERE id % 4 <> 0),
ts AS (SELECT id, nm AS name, CASE WHEN kind = 'IMPL_METHOD' THEN owner || '.' || nm ELSE nm END AS qualified, p_size % 11 = 0 AS is_stub, lower(owner) AS package, file FROM (SELECT *, CASE WHEN kind IN ('FUNCTION', 'IMPL_METHOD') THEN lower(pc[1:1]) || pc[2:] ELSE name END AS nm FROM cm)),
sc AS (SELECT id, name, kind, parent, lower(pc[1:1]) || pc[2:] AS camel FROM (SELECT *, {_PASCAL % 'name'} AS pc FROM ss)),
cand AS (SELECT id, name AS c, 1.0 AS x, 'exact' AS r, 0 AS o FROM sc
 UNION ALL SELECT id, camel, 0.95, 'camelCase', 2 FROM sc WHERE kind IN ('FUNCTION', 'IMPL_METHOD') AND camel <> name
 UNION ALL SELECT id, parent || '.' || name, 0.9, 'qualified', 3 FROM sc WHERE parent <> '' UNION ALL SELECT id, parent || '.' || camel, 0.85, 'qualified+camelCase', 4 FROM sc WHERE parent <> '' AND camel <> name
 UNION ALL SELECT id, parent || '.Companion.' || name, 0.8, 'companion', 5 FROM sc WHERE parent <> '' UNION ALL SELECT id, parent || '.Companion.' || camel, 0.75, 'companion+camelCase', 6 FROM sc WHERE parent <> '' AND camel <> name
 UNION ALL SELECT id, name, 0.5, 'method_name_only', 15 FROM sc WHERE kind = 'IMPL_METHOD' UNION ALL SELECT id, camel, 0.45, 'method_camelCase_only', 16 FROM sc WHERE kind = 'IMPL_METHOD' AND camel <> name),
qi AS (SELECT qualified AS c, arg_min(id, (is_stub::INT, id)) AS t FROM ts GROUP BY 1), ni AS (SELECT name AS c, arg_min(id, (is_stub::INT, id)) AS t FROM ts GROUP BY 1),
hit AS (SELECT cand.id, x, o, 0 AS w, t, r FROM cand JOIN qi USING (c) UNION ALL SELECT cand.id, x, o, 1, t, r FROM cand JOIN ni USING (c)),
best AS (SELECT id, t, x, r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, o, w) AS n FROM hit) WHERE n = 1),
m AS (SELECT ss.id, best.t AS target_id, coalesce(x, 0)::DOUBLE AS confidence, coalesce(r, '') AS reason FROM ss LEFT JOIN best ON best.id = ss.id)"""


def symbols(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part")
    owner = F.concat(F.substring("p_type", 1, 1), F.lower(F.substring("p_type", 2, 100)))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), (F.col("p_partkey") % 50).cast("string"))
    b = p.select(F.col("p_partkey").alias("id"), name.alias("name"), F.element_at(F.array(*map(F.lit, _KINDS)), F.col("p_size") % 5 + 1).alias("kind"), owner.alias("owner"), "p_size", F.concat(F.lower("p_type"), F.lit(".rs")).alias("file"))
    src = b.select("id", "name", "kind", F.when(F.col("kind") == "IMPL_METHOD", F.col("owner")).otherwise("").alias("parent"), (F.col("p_size") % 7 == 0).alias("is_test"), "file", F.concat_ws("::", "owner", F.col("kind")).alias("package"))
    t = b.filter("id % 4 <> 0").withColumn("name", F.when(F.col("kind").isin("FUNCTION", "IMPL_METHOD"), N.camel(F.col("name"))).otherwise(F.col("name")))
    tgt = t.select("id", "name", F.when(F.col("kind") == "IMPL_METHOD", F.concat("owner", F.lit("."), "name")).otherwise(F.col("name")).alias("qualified"), (F.col("p_size") % 11 == 0).alias("is_stub"), F.lower("owner").alias("package"), "file")
    return src, tgt


@query(f"WITH {_SYMS} SELECT id, target_id, confidence, reason FROM m")
def symbol_parity(spark: SparkSession, sf: str) -> DataFrame:
    return P.parity(*symbols(spark, sf))


@query(f"WITH {_SYMS} SELECT is_test, kind, count(target_id) AS matched, count(*) AS total FROM ss JOIN m USING (id) GROUP BY ROLLUP (is_test, kind)")
def parity_rollup(spark: SparkSession, sf: str) -> DataFrame:
    s, t = symbols(spark, sf)
    return P.coverage(s, P.parity(s, t))


@query(f"WITH {_SYMS} SELECT id, name FROM ts WHERE id NOT IN (SELECT target_id FROM m WHERE target_id IS NOT NULL)")
def extra_symbols(spark: SparkSession, sf: str) -> DataFrame:
    s, t = symbols(spark, sf)
    return P.extra(t, P.parity(s, t)).select("id", "name")


@query(f"WITH {_SYMS} SELECT name, count(DISTINCT file) AS files, count(*) AS n FROM ts GROUP BY name HAVING count(DISTINCT file) > 1")
def dup_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return P.duplicates(symbols(spark, sf)[1])


@query(f"WITH {_SYMS}, a AS (SELECT name, arg_max(owner || '::' || kind, id) AS source_package FROM b GROUP BY name), z AS (SELECT name, arg_max(package, id) AS target_package FROM ts GROUP BY name) SELECT name, source_package, target_package FROM a JOIN z USING (name) WHERE replace(source_package, ':', '.') <> target_package")
def namespace_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return P.namespace_mismatch(*symbols(spark, sf))


@query(f"WITH {_SYMS} SELECT id, name FROM ss WHERE {_canon('name')} NOT IN (SELECT {_canon('name')} FROM ts)")
def missing_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return P.missing(*symbols(spark, sf)).select("id", "name")


_RULES = [(1, "_x", "FUNCTION", ""), (2, "new", "IMPL_METHOD", "Foo"), (3, "r#type", "STRUCT", ""), (4, "fmt", "IMPL_METHOD", "Foo"), (5, "drop", "IMPL_METHOD", "Foo"), (6, "partial_cmp", "IMPL_METHOD", "Foo"), (7, "Plain", "ENUM", "")]
_RULE_ROWS = [
    (1, "_x", 1.0, "exact"), (1, "x", 0.97, "strip_leading_underscore"), (1, "x", 0.95, "camelCase"), (2, "new", 1.0, "exact"), (2, "Foo.new", 0.9, "qualified"), (2, "Foo.Companion.new", 0.8, "companion"), (2, "Foo.invoke", 0.7, "new→invoke"), (2, "Foo", 0.65, "new→constructor"), (2, "new", 0.5, "method_name_only"),
    (3, "r#type", 1.0, "exact"), (3, "type", 0.95, "raw_ident"), (4, "fmt", 1.0, "exact"), (4, "Foo.fmt", 0.9, "qualified"), (4, "Foo.Companion.fmt", 0.8, "companion"), (4, "Foo.toString", 0.8, "fmt→toString"), (4, "fmt", 0.5, "method_name_only"),
    (5, "drop", 1.0, "exact"), (5, "Foo.drop", 0.9, "qualified"), (5, "Foo.Companion.drop", 0.8, "companion"), (5, "Foo.close", 0.8, "drop→close"), (5, "drop", 0.5, "method_name_only"),
    (6, "partial_cmp", 1.0, "exact"), (6, "partialCmp", 0.95, "camelCase"), (6, "Foo.partial_cmp", 0.9, "qualified"), (6, "Foo.partialCmp", 0.85, "qualified+camelCase"), (6, "Foo.Companion.partial_cmp", 0.8, "companion"), (6, "Foo.Companion.partialCmp", 0.75, "companion+camelCase"),
    (6, "Foo.compareTo", 0.85, "partial_cmp→compareTo"), (6, "compareTo", 0.6, "partial_cmp→compareTo (unqualified)"), (6, "partial_cmp", 0.5, "method_name_only"), (6, "partialCmp", 0.45, "method_camelCase_only"), (7, "Plain", 1.0, "exact"),
]


@query(f"SELECT id, candidate, confidence::DOUBLE AS confidence, reason FROM {values(_RULE_ROWS, 'id, candidate, confidence, reason')}")
def match_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return P.candidates(spark.createDataFrame(_RULES, "id int, name string, kind string, parent string")).select("id", "candidate", "confidence", "reason")


_USES = [("lib.rs", "pub use foo::Bar;"), ("lib.rs", "pub use foo::Baz as Q;"), ("lib.rs", "pub use m::{A, self, B as C};"), ("lib.rs", "pub use g::*;"), ("lib.rs", "pub(crate) use x::Y;"), ("lib.rs", "use p::R;"), ("mod.rs", "  pub use n::Solo;")]


@query("SELECT * FROM (VALUES ('lib.rs', 'Bar', 'Bar'), ('lib.rs', 'Baz', 'Q'), ('lib.rs', 'A', 'A'), ('lib.rs', 'B', 'C'), ('mod.rs', 'Solo', 'Solo')) AS t(file, item, alias)")
def reexports(spark: SparkSession, sf: str) -> DataFrame:
    return P.reexports(spark.createDataFrame(_USES, "file string, line string"))


_KT = [
    ("a.kt", "p.a", ["p.b.Other"], ["Mine"], ["Mine", "Other", "Helper", "String", "T", "T1", "Ghost", "Twice", "Near"]), ("b.kt", "p.b", [], ["Other", "Twice", "Only"], ["Only", "Int"]),
    ("c.kt", "p.c", [], ["Twice", "Helper"], ["Twice", "Other"]), ("d.kt", "p.a", [], ["Near"], ["Helper"]),
]
_KT_SCHEMA = "file string, package string, imports array<string>, defined array<string>, referenced array<string>"
_BUILT = ", ".join(f"'{b}'" for b in N.BUILTINS)
_KTS = f"""f AS (SELECT * FROM {values(_KT, 'file, package, imports, defined, referenced')}), reg AS (SELECT DISTINCT unnest(defined) AS ref, package FROM f),
un AS (SELECT DISTINCT file, package, ref FROM (SELECT file, package, unnest(referenced) AS ref FROM f) r WHERE NOT EXISTS (SELECT 1 FROM (SELECT file, unnest(imports) AS i FROM f) i WHERE i.file = r.file AND string_split(i, '.')[-1] = r.ref)
 AND NOT EXISTS (SELECT 1 FROM reg WHERE reg.package = r.package AND reg.ref = r.ref) AND ref NOT IN ({_BUILT}) AND NOT regexp_matches(ref, '^[A-Z][A-Z0-9_]?$') AND NOT regexp_matches(ref, '^[A-Z][0-9_]{{0,2}}$'))"""


def kotlin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_KT, _KT_SCHEMA)


@query(f"WITH {_KTS}, g AS (SELECT ref, count(*) AS n, min(package) AS sole FROM reg GROUP BY ref) SELECT file, un.ref, coalesce(n, 0) AS packages, CASE WHEN n = 1 THEN sole || '.' || un.ref END AS suggestion FROM un LEFT JOIN g ON g.ref = un.ref")
def import_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return P.suggestions(kotlin(spark))


@query(f"WITH {_KTS} SELECT ref, count(*) AS packages FROM reg GROUP BY ref HAVING count(*) > 1")
def ambiguous_types(spark: SparkSession, sf: str) -> DataFrame:
    return kotlin(spark).select(F.explode("defined").alias("ref"), "package").distinct().groupBy("ref").agg(F.count("*").alias("packages")).filter("packages > 1")


@query(f"WITH {_KTS} SELECT ref, count(*) AS files FROM un WHERE ref NOT IN (SELECT ref FROM reg) GROUP BY ref ORDER BY files DESC, ref")
def undefined_types(spark: SparkSession, sf: str) -> DataFrame:
    return P.suggestions(kotlin(spark)).filter("packages = 0").groupBy("ref").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "ref")


_LOG = ["e: file:///abs/a.kt:3:5 Unresolved reference: 'Helper'", "e: a.kt:7:1 Unresolved reference 'Helper'.", "e: a.kt:9:2 Unresolved reference 'Twice'", "w: a.kt:1:1 unused", "e: a.kt:1:1 Type mismatch", "e: d.kt:4:4 Unresolved reference 'Ghost'", "e: a.kt:2:2 Unresolved reference 'Only'"]
_ERRORS = f"e AS (SELECT regexp_extract(line, '^e: (?:file://)?(.+?):(\\d+):(\\d+)', 1) AS file, regexp_extract(line, ':(\\d+):(\\d+)', 1)::INT AS row, regexp_extract(line, ':(\\d+):(\\d+)', 2)::INT AS col, regexp_extract(line, 'Unresolved reference:? ''([^'']+)''', 1) AS ref FROM {values([(x,) for x in _LOG], 'line')} WHERE regexp_matches(line, '^e: .*Unresolved reference:? '''))"


@query(f"WITH {_ERRORS} SELECT * FROM e")
def compiler_errors(spark: SparkSession, sf: str) -> DataFrame:
    return P.compiler_errors(spark.createDataFrame([(x,) for x in _LOG], "line string"))


@query("SELECT * FROM (VALUES ('/abs/a.kt', 'Helper', 1, 'fixable', 'p.c.Helper'), ('a.kt', 'Helper', 1, 'fixable', 'p.c.Helper'), ('a.kt', 'Twice', 1, 'fixable', 'p.b.Twice'), ('d.kt', 'Ghost', 1, 'unfixable', NULL), ('a.kt', 'Only', 1, 'fixable', 'p.b.Only')) AS t(file, ref, n, status, \"import\")")
def compiler_fixup(spark: SparkSession, sf: str) -> DataFrame:
    return P.fixups(compiler_errors(spark, sf), kotlin(spark))


_CLASSES = [("a.hpp", "class Foo { int x; };\nFoo f;"), ("b.hpp", "class Foo;\nstruct Foo : Bar {\n};"), ("c.cpp", "void g(Foo a, Food b);"), ("d.cpp", "int main() {}")]


@query("SELECT * FROM (VALUES ('a.hpp', 1, 0, 1), ('b.hpp', 1, 1, 0), ('c.cpp', 0, 0, 1)) AS t(path, definitions, forwards, refs)")
def symbol_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return P.lookup(spark.createDataFrame(_CLASSES, "path string, text string"), "Foo")


@query(f"WITH {_SYMS}, {_IMPORTS} SELECT name, n, dependents FROM (SELECT name, count(*) AS n, max(dependents) AS dependents FROM ts JOIN units u ON u.p_partkey = ts.id JOIN deg ON deg.key = u.key GROUP BY name HAVING count(DISTINCT file) > 1) ORDER BY dependents DESC, name LIMIT 30")
def symbol_duplicates_ranked(spark: SparkSession, sf: str) -> DataFrame:
    d = unit_degrees(spark, sf).select(F.col("p_partkey").alias("id"), "dependents")
    j = symbols(spark, sf)[1].join(d, "id").groupBy("name").agg(F.count("*").alias("n"), F.max("dependents").alias("dependents"), F.count_distinct("file").alias("files"))
    return j.filter("files > 1").select("name", "n", "dependents").orderBy(F.desc("dependents"), "name").limit(30)


# reports

_MATCHES = f"""{_IMPORTS}, mt AS (SELECT u.key AS src, u.p_partkey AS id, deg.dependents, ((u.p_partkey * 37) % 100) / 100.0::DOUBLE AS similarity, u.p_partkey % 17 = 0 AS stub, u.p_partkey % 9 AS src_functions, u.p_partkey % 7 AS tgt_functions,
u.p_partkey % 5 AS src_types, u.p_partkey % 4 AS tgt_types, CASE WHEN u.p_partkey % 13 = 0 THEN 2 ELSE 0 END AS todos, CASE WHEN u.p_partkey % 11 = 0 THEN 1 ELSE 0 END AS lint, u.p_partkey % 3 AS tests, u.p_partkey % 40 AS src_docs, u.p_partkey % 23 AS tgt_docs FROM units u JOIN deg ON deg.key = u.key)"""


def matches(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return unit_degrees(spark, sf).select(
        F.col("key").alias("src"), k.alias("id"), "dependents", (((k * 37) % 100) / 100.0).alias("similarity"), (k % 17 == 0).alias("stub"), (k % 9).alias("src_functions"), (k % 7).alias("tgt_functions"), (k % 5).alias("src_types"), (k % 4).alias("tgt_types"),
        F.when(k % 13 == 0, 2).otherwise(0).alias("todos"), F.when(k % 11 == 0, 1).otherwise(0).alias("lint"), (k % 3).alias("tests"), (k % 40).alias("src_docs"), (k % 23).alias("tgt_docs"),
    )


_DEF = "greatest(src_functions - tgt_functions, 0) + greatest(src_types - tgt_types, 0)"


@query(f"WITH {_MATCHES} SELECT src, round(dependents * 1e6 + ({_DEF}) * 1e4 + (src_functions + src_types) * 100.0 + greatest(0.0, 1 - similarity) * 10.0, 6) AS score, round(dependents * (1 - similarity), 6) AS simple FROM mt")
def priority_ladder(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    lacking = R.deficit(c("src_functions"), c("tgt_functions")) + R.deficit(c("src_types"), c("tgt_types"))
    score = R.priority(c("dependents"), lacking, c("src_functions") + c("src_types"), c("similarity"))
    return matches(spark, sf).select("src", F.round(score, 6).alias("score"), F.round(R.priority_simple(c("dependents"), c("similarity")), 6).alias("simple"))


@query(f"WITH {_MATCHES} SELECT src, CASE WHEN stub THEN 'STUB' WHEN similarity < 0.4 THEN 'LOW_SIM' WHEN src_functions > tgt_functions THEN 'MISSING_FUNCS' WHEN src_types > tgt_types THEN 'MISSING_TYPES' WHEN tests > 0 THEN 'MISSING_TESTS' WHEN lint > 0 THEN 'LINT' WHEN todos > 0 THEN 'TODO' ELSE '' END AS issue FROM mt")
def issue_status(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return matches(spark, sf).select("src", R.issue(c("stub"), c("similarity"), c("src_functions") - c("tgt_functions"), c("src_types") - c("tgt_types"), c("tests"), c("lint"), c("todos")).alias("issue"))


@query(f"WITH {_MATCHES} SELECT CASE WHEN stub THEN 'critical' WHEN similarity >= 0.85 THEN 'complete' WHEN similarity >= 0.6 THEN 'partial' ELSE 'critical' END AS quality, count(*) AS n, round(avg(similarity) FILTER (NOT stub), 6) AS mean FROM mt GROUP BY 1")
def quality_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return R.buckets(matches(spark, sf))


@query(f"WITH {_MATCHES} SELECT src, similarity, row_number() OVER (ORDER BY similarity, stub DESC, dependents DESC, src_functions - tgt_functions DESC, src) AS place FROM mt")
def status_order(spark: SparkSession, sf: str) -> DataFrame:
    by = [F.col("similarity"), F.desc("stub"), F.desc("dependents"), F.desc(F.col("src_functions") - F.col("tgt_functions")), F.col("src")]
    return J.ranked(matches(spark, sf), by, "place").select("src", "similarity", "place")


@query(f"""WITH {_MATCHES} SELECT count(*) AS pairs, count(*) FILTER (similarity < 0.6 OR stub) AS incomplete, count(*) FILTER (stub) AS stubs, sum(todos) AS todos, sum(lint) AS lint, sum(greatest(src_functions - tgt_functions, 0)) AS missing_functions,
round(avg(similarity) FILTER (NOT stub), 6) AS mean_similarity, round(100.0 * sum(least(src_functions, tgt_functions)) / sum(src_functions), 6) AS parity_percent FROM mt""")
def summary_totals(spark: SparkSession, sf: str) -> DataFrame:
    return R.totals(matches(spark, sf))


@query(f"WITH {_MATCHES}, g AS (SELECT src, src_docs, CASE WHEN src_docs <= 0 THEN 0.0 WHEN tgt_docs <= 0 THEN 1.0 ELSE greatest(0.0, 1 - tgt_docs::DOUBLE / src_docs) END AS gap FROM mt) SELECT src, src_docs, round(gap, 6) AS gap FROM g WHERE gap > 0.2 AND src_docs > 5")
def doc_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return R.doc_gaps(matches(spark, sf)).select("src", "src_docs", F.round("gap", 6).alias("gap"))


@query(f"WITH {_MATCHES} SELECT src, round(CASE WHEN src_docs > 0 THEN least(1.0, tgt_docs::DOUBLE / src_docs) ELSE 1.0 END, 6) AS capped, round(CASE WHEN greatest(src_docs, tgt_docs) > 0 THEN least(src_docs, tgt_docs)::DOUBLE / greatest(src_docs, tgt_docs) ELSE 1.0 END, 6) AS balance, round(0.5 * similarity + 0.5 * CASE WHEN src_docs > 0 THEN least(1.0, tgt_docs::DOUBLE / src_docs) ELSE 1.0 END, 6) AS weighted FROM mt")
def doc_coverage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    s, t = F.col("src_docs"), F.col("tgt_docs")
    r = lambda c, n: F.round(c, 6).alias(n)
    return matches(spark, sf).select("src", r(M.capped(t, s), "capped"), r(M.balance(s, t), "balance"), r(M.doc_weighted(F.col("similarity"), s, t), "weighted"))


@query(f"WITH {_MATCHES} SELECT key, dependents FROM deg WHERE key NOT IN (SELECT src FROM mt WHERE id % 3 <> 0) ORDER BY dependents DESC, key")
def missing_by_dependents(spark: SparkSession, sf: str) -> DataFrame:
    u = degrees(spark, sf).filter("key IS NOT NULL")
    found = units(spark, sf).filter("p_partkey % 3 <> 0").select(F.col("key").alias("src"))
    return J.missing_by_dependents(u, found)


@query(f"WITH {_MATCHES} SELECT src, dependents FROM mt WHERE similarity < 0.85 AND dependents >= 10 AND id % 3 <> 0 UNION ALL SELECT src, dependents FROM mt WHERE dependents >= 10 AND id % 3 = 0")
def next_actions(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf).filter("dependents >= 10 AND (similarity < 0.85 OR id % 3 = 0)").select("src", "dependents")


@query(f"WITH {_MATCHES} SELECT src, id % 2 * 10 + todos * 3 + lint * 8 + tests * 8 + (id % 4) * 20 + (id % 6) * 5 + id % 8 AS score FROM mt ORDER BY score DESC, src LIMIT 50")
def lint_score_top(spark: SparkSession, sf: str) -> DataFrame:
    c, k = F.col, F.col("id")
    score = R.lint_score(k % 2, c("todos"), c("lint"), c("tests"), k % 4, k % 6, k % 8)
    return matches(spark, sf).select("src", score.alias("score")).orderBy(F.desc("score"), "src").limit(50)


_FIT = [(k, h / 10, s / 10, j / 10, c / 10, i / 10, e, m) for k, (h, s, j, c, i, e, m) in enumerate([(9, 8, 6, 1, 1, False, False), (9, 8, 5, 8, 2, False, False), (8.6, 7, 5, 2, 4, False, False), (3, 3, 3, 9, 9, False, True), (5, 4, 3, 0, 0, True, False), (2, 2, 2, 5, 5, False, True), (7, 7, 7, 7, 7, False, False)])]


@query(f"""WITH f AS (SELECT id, h::DOUBLE AS h, s::DOUBLE AS s, j::DOUBLE AS j, c::DOUBLE AS c, i::DOUBLE AS i, e, m FROM {values(_FIT, 'id, h, s, j, c, i, e, m')}),
g AS (SELECT *, greatest(0.5 * c + 0.15 * i + 0.15 * h + 0.1 * j + 0.1 * s, CASE WHEN h >= 0.9 AND s >= 0.8 AND j >= 0.6 THEN 0.7 * h + 0.2 * s + 0.1 * j ELSE 0 END, CASE WHEN c >= 0.8 AND h >= 0.85 AND s >= 0.75 AND j >= 0.5 THEN h ELSE 0 END,
CASE WHEN i >= 0.35 AND h >= 0.85 AND s >= 0.6 AND j >= 0.45 THEN 0.6 * h + 0.25 * s + 0.15 * j ELSE 0 END) AS base, 0.7 * c + 0.3 * i AS nm FROM f)
SELECT id, round(CASE WHEN e THEN 0.5 * h + 0.3 * s + 0.2 * j WHEN m THEN greatest(base, CASE WHEN nm >= 0.7 THEN 0.85 + 0.15 * ((nm - 0.7) / 0.3) ELSE nm END) ELSE base END, 6) AS combined, round(CASE WHEN e THEN h ELSE 0.7 * c + 0.3 * h END, 6) AS body FROM g""")
def content_combined(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    f = spark.createDataFrame(_FIT, "id int, h double, s double, j double, c double, i double, e boolean, m boolean")
    return f.select("id", F.round(M.with_content(c("c"), c("i"), c("h"), c("j"), c("s"), c("e"), c("m")), 6).alias("combined"), F.round(M.body_score(c("c"), c("h"), c("e")), 6).alias("body"))


# work queue


@query(f"WITH {_MATCHES}, t AS (SELECT src AS key, dependents FROM mt WHERE id % 3 = 0 UNION SELECT src, dependents FROM mt WHERE id % 3 <> 0 AND (similarity < 0.85 OR todos > 0 OR lint > 0 OR stub)) SELECT key, dependents, 'pending' AS status FROM t")
def task_init(spark: SparkSession, sf: str) -> DataFrame:
    m = matches(spark, sf)
    return K.init(m.filter("id % 3 <> 0"), m.filter("id % 3 = 0").select(F.col("src").alias("key"), "dependents"))


@query(f"WITH {_MATCHES}, t AS (SELECT src AS key, dependents FROM mt WHERE id % 3 = 0 UNION SELECT src, dependents FROM mt WHERE id % 3 <> 0 AND (similarity < 0.85 OR todos > 0 OR lint > 0 OR stub)), a AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS n FROM (SELECT DISTINCT user_id FROM events)) SELECT key, dependents, user_id AS agent FROM (SELECT *, row_number() OVER (ORDER BY dependents DESC, key) AS n FROM t) JOIN a USING (n)")
def task_assign(spark: SparkSession, sf: str) -> DataFrame:
    agents = table(spark, sf, "events").select(F.col("user_id").alias("agent")).distinct()
    return K.assign(task_init(spark, sf), agents)


_STATE = "k AS (SELECT event_id % 500 AS task, ts, event_id, CASE event_type WHEN 'click' THEN 'assigned' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'blocked' WHEN 'signup' THEN 'pending' END AS status FROM events), st AS (SELECT task, arg_max(status, (ts, event_id)) AS status, count(*) AS changes FROM k WHERE status IS NOT NULL GROUP BY task)"


def _task_events(spark, sf):
    return table(spark, sf, "events").withColumn("task", F.col("event_id") % 500)


@query(f"WITH {_STATE} SELECT task, status, changes FROM st")
def task_state(spark: SparkSession, sf: str) -> DataFrame:
    return K.current(_task_events(spark, sf))


@query(f"WITH {_STATE} SELECT task, status, changes FROM st")
def task_state_stream(spark: SparkSession, sf: str) -> DataFrame:
    return S.run(S.states(S.read(spark, f"{sf}/events.parquet").withColumn("task", F.col("event_id") % 500)))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, user_id, count(*) AS n FROM events GROUP BY ALL")
def activity_stream(spark: SparkSession, sf: str) -> DataFrame:
    a = S.run(S.activity(S.read(spark, f"{sf}/events.parquet")))
    return a.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "user_id", "n")


@query(f"WITH {_STATE} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'assigned') AS assigned, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'blocked') AS blocked FROM st")
def task_stats(spark: SparkSession, sf: str) -> DataFrame:
    return K.stats(task_state(spark, sf))


@query(f"WITH {_MATCHES} SELECT src, similarity >= 0.85 AND todos = 0 AND NOT stub AS complete, similarity >= 0.5 AS release FROM mt")
def task_gates(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf).select("src", K.may_complete(F.col("similarity"), F.col("todos"), F.col("stub").cast("int")).alias("complete"), K.may_release(F.col("similarity")).alias("release"))


@query(f"WITH {_STATE} SELECT task AS key, task % 10 AS dependents, CASE WHEN status IN ('assigned', 'completed') THEN status ELSE 'pending' END AS status FROM st WHERE task % 5 <> 0 UNION ALL SELECT task, 0, status FROM st WHERE task % 5 = 0 AND status IN ('assigned', 'completed')")
def task_rescan(spark: SparkSession, sf: str) -> DataFrame:
    old = task_state(spark, sf).select(F.col("task").alias("key"), "status", F.lit(0).cast("long").alias("dependents"))
    new = old.filter("key % 5 <> 0").select("key", (F.col("key") % 10).alias("dependents"))
    return K.rescan(old, new)


# Expected places, proposals, suspicious constructs, planned scores


@query(f"""WITH u AS (SELECT p_partkey, lower(p_type) AS dir, replace(p_name, ' ', '_') AS stem FROM part)
SELECT p_partkey, dir || '/' || {_PASCAL % 'stem'} || '.kt' AS kotlin, dir || '/' || replace(stem, '_', '-') || '.ts' AS typescript, dir || '/' || stem || '.py' AS python, dir || '.' || {_PASCAL % 'stem'} AS name FROM u""")
def expected_targets(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".rs"))
    return table(spark, sf, "part").select("p_partkey", *(N.expected_target(path, x).alias(x) for x in ("kotlin", "typescript", "python")), N.expected_target_name(path, "kotlin").alias("name"))


@query(f"WITH {_CORPORA} SELECT DISTINCT src, tgt, origin AS found, '// port-lint: source ' || regexp_replace(path, '^src/', '') AS expected FROM scores JOIN src s ON s.key = src JOIN t USING (tgt) WHERE score < 1")
def provenance_proposals(spark: SparkSession, sf: str) -> DataFrame:
    s, t = corpora(spark, sf)
    return J.proposals(s, t, J.header_scores(s, t))


_PAIRS = [("a.rs", "A.kt", "pub type FooBar = u8;", "typealias FooBar = Byte\ntypealias Extra = Int"), ("b.rs", "B.kt", "fn x() {}", '@file:Suppress("x")\nfun x() {}'), ("c.rs", "C.kt", "", "")]


@query("SELECT * FROM (VALUES ('a.rs', 'A.kt', 'typealias Extra'), ('b.rs', 'B.kt', 'suppression')) AS t(src, tgt, what)")
def suspicious_constructs(spark: SparkSession, sf: str) -> DataFrame:
    return J.suspicious(spark.createDataFrame(_PAIRS, "src string, tgt string, src_text string, tgt_text string"))


@query(f"WITH {_MATCHES} SELECT src, round(greatest(0.0, least(1.0, 0.35 * similarity + 0.35 * (id % 10) / 10.0 + 0.2 * (id % 7) / 7.0 + 0.1 * (id % 3) / 3.0 - lint * 0.05)), 6) AS score FROM mt")
def rule_scores(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    return matches(spark, sf).select("src", F.round(R.rule_score(F.col("similarity"), (k % 10) / 10.0, (k % 7) / 7.0, (k % 3) / 3.0, F.col("lint") * 0.05), 6).alias("score"))


_LACKING = [("a", "shift_by", "n: Int"), ("a", "new", ""), ("b", "fmt", "f: Formatter")]


@query("SELECT * FROM (VALUES ('a', 'fun new() { TODO(\"port\") }' || chr(10) || 'fun shiftBy(n: Int) { TODO(\"port\") }'), ('b', 'fun fmt(f: Formatter) { TODO(\"port\") }')) AS t(unit, text)")
def generated_stubs(spark: SparkSession, sf: str) -> DataFrame:
    return R.stub_functions(spark.createDataFrame(_LACKING, "unit string, name string, args string"))
