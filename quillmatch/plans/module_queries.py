"""Queries on packages, imports of whole texts, node names and small rules. Paths and texts are made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import packages as K
from ..functions import tensor as L
from ..functions import text as X
from ..operators import graph as G
from ..operators import trees as T
from .registry import query, table
from .text_queries import _VEC, AZ, _vectors, az
from .tree_queries import _PAGES, page_nodes

_PATH = "'src/' || regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') || CASE page_id % 4 WHEN 1 THEN '/mod' WHEN 2 THEN '/__init__' WHEN 3 THEN '/lib' ELSE '' END"


def _module_sql(passed: str, roots: str, ext: str) -> str:
    name = f"CASE WHEN x[-1] = '' THEN '{ext}' ELSE x[-1] END"
    return f"array_to_string(list_concat(list_filter(x[:-2], d -> d NOT IN ('', '.', {passed})), CASE WHEN {name} IN ({roots}) THEN [] ELSE [{name}] END), '.')"


@query(f"""WITH p AS (SELECT page_id, string_split({_PATH}, '/') AS x FROM pages) SELECT page_id, {_module_sql("'src', 'lib'", "'mod', 'lib'", '.rs')} AS rust, {_module_sql("'src', 'lib'", "'__init__'", '.py')} AS python, {_module_sql("'src', 'include'", "''", '.h')} AS cpp FROM p""")
def module_paths(spark: SparkSession, sf: str) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, ("", "/mod", "/__init__", "/lib"))), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("src/"), F.regexp_replace("url", "^[a-z]+://|[?#].*$", ""), end)
    of = lambda ext: F.array_join(K.package_of(F.concat(path, F.lit(ext)), F.lit("")), ".")
    return table(spark, sf, "pages").select("page_id", of(".rs").alias("rust"), of(".py").alias("python"), of(".h").alias("cpp"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'geo.n' || s_nationkey || '.s' || s_suppkey END AS kotlin,
CASE WHEN s_suppkey % 2 = 0 THEN 'geo.n' || s_nationkey || '.s' || s_suppkey ELSE 'a.b_' || s_suppkey END AS cpp FROM supplier""")
def source_packages(spark: SparkSession, sf: str) -> DataFrame:
    s, n, k = table(spark, sf, "supplier"), F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")
    kotlin = F.concat(F.lit("/* package not.this */\n// package nor.this\n"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("package geo.`n"), n, F.lit("`.s"), k, F.lit("\n"))), F.lit("class A\n"))
    cpp = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('using namespace std;\nconst char* x = "namespace no {";\nnamespace geo::n'), n, F.lit(" {\n  // inner\n  namespace s"), k, F.lit(" { int x; }\n  namespace later { int y; }\n}\n"))).otherwise("int x;\n")
    of = lambda ext, text: F.array_join(K.package_of(F.concat(F.lit("include/a/b_"), k, F.lit(ext)), text), ".")
    return s.select("s_suppkey", of(".kt", kotlin).alias("kotlin"), of(".hpp", cpp).alias("cpp"))


@query("""WITH s AS (SELECT s_suppkey::VARCHAR AS k, s_nationkey::VARCHAR AS n FROM supplier)
SELECT k || '.py' AS importer, unnest(['os.path', 'm' || n, 'geo.n' || n || '.a' || k, 'geo.n' || n || '.common', 'star', 'x.b', 'x.d' || k]) AS module_path, unnest(['path', 'm' || n, 'a' || k, 'common', '*', 'b', 'd' || k]) AS item,
unnest([false, false, false, false, true, false, false]) AS wildcard FROM s""")
def python_imports(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit("import os.path, m"), n, F.lit(" as q\nfrom geo.n"), n, F.lit(" import (\n    a"), k, F.lit(",  # the first\n    common as c,\n)\nfrom star import *\nimportant = 1\nfrom x import b, \\\n    d"), k, F.lit("  # import no\nz = 'import y'\n"),
    )
    return G.python_imports(table(spark, sf, "supplier").select(F.concat(k, F.lit(".py")).alias("path"), text.alias("text")))


@query(f"WITH {_PAGES} SELECT CASE node_type {' '.join(f'WHEN {k} THEN {v!r}' for k, v in T.TYPE_NAMES.items())} ELSE 'OTHER' END AS name, count(*) AS n FROM nodes GROUP BY 1")
def node_type_names(spark: SparkSession, sf: str) -> DataFrame:
    return page_nodes(spark, sf).groupBy(T.type_name(F.col("node_type")).alias("name")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, contains(text, 'todo!') OR (len(string_split(text, chr(10))) <= 50 AND regexp_matches(text, '(?i)TODO|FIXME|placeholder|not implemented|not yet implemented')) AS stub, len(regexp_extract_all(text, '(?i)TODO[:\\s](.*)', 1)) AS todos,
contains(text, 'macro_rules!') AS macros FROM documents""")
def script_stubs(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.is_script_stub(t, F.contains(t, F.lit("todo!")), F.size(F.split(t, "\n"))).alias("stub"), F.size(X.script_todos(t)).alias("todos"), X.has_macro_rules(t).alias("macros"))


@query(f"SELECT page_id, contains(translate(regexp_replace(url, '([^/])\\.[^./]*$', '\\1'), '{AZ}_', '{az}'), 'blog') AS named FROM pages")
def path_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", N.matches_path(F.col("url"), F.lit("Bl_og.kt")).alias("named"))


@query(f"WITH e AS ({_VEC}) SELECT vec_id, len(v) + 3 AS n, round(list_sum(v), 6) AS total, 0.0 AS last FROM e")
def tensor_joined(spark: SparkSession, sf: str) -> DataFrame:
    e = _vectors(spark, sf).select("vec_id", L.joined(F.col("v"), L.zeros(3)).alias("v"))
    return e.select("vec_id", F.size("v").alias("n"), F.round(L.total(F.col("v")), 6).alias("total"), F.element_at("v", -1).alias("last"))
