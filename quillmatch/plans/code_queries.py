"""Queries on source texts: parsed trees, functions, symbols, lint. The texts are literal, as the tables hold no code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tree_lstm
from ..operators import trees as T
from ..sources import code as C
from . import compare
from .registry import query, table, values
from .tree_queries import TAGS, trees

RUST = """// a header
use foo::bar::Baz;
/// Adds.
pub struct Point { x: i32 }
impl Point {
    pub fn new(x: i32) -> Self { Point { x } }
    fn shift_by(&self, other: i32) -> i32 {
        if other > 0 { return self.x + other; }
        self.x
    }
}
pub fn free_fn(value: u8, unused: u8) -> u8 { value * 2 }
fn later() { todo!() }
#[cfg(test)]
mod tests {
    #[test]
    fn works() { assert_eq!(1, 1); }
}
"""
KOTLIN = """// port-lint: source src/point.rs
package geo
import foo.bar.Baz
/** Adds. */
class Point(val x: Int) {
    fun shiftBy(other: Int): Int {
        if (other > 0) { return x + other }
        return x
    }
}
fun freeFn(value: Byte, unused: Byte): Byte { return value * 2 }
fun later() { TODO() }
"""
PYTHON = '''import numpy as np
def mean(xs, weights):
    """Mean."""
    return float(np.sum(xs) / len(xs))
class Box:
    def get(self):
        pass
    def put(self, v):
        self.v = np.array([v])[0]
'''
CPP = """#pragma once
#include "geo/point.hpp"
class Shape { public: int area(int w, int h) { return w * w; } };
int used(int a) { (void)a; return 1; }
"""
FILES = [("src/point.rs", "rust", RUST), ("geo/Point.kt", "kotlin", KOTLIN), ("m.py", "python", PYTHON), ("shape.hpp", "cpp", CPP)]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "unit string, lang string, text string")


_SYMBOLS = [
    ("src/point.rs", "STRUCT", "Point", "", False, False), ("src/point.rs", "IMPL", "Point", "", False, False), ("src/point.rs", "IMPL_METHOD", "new", "Point", False, False), ("src/point.rs", "IMPL_METHOD", "shift_by", "Point", False, False),
    ("src/point.rs", "FUNCTION", "free_fn", "", False, False), ("src/point.rs", "FUNCTION", "later", "", False, True), ("src/point.rs", "FUNCTION", "works", "", True, False),
    ("geo/Point.kt", "STRUCT", "Point", "", False, False), ("geo/Point.kt", "IMPL_METHOD", "shiftBy", "Point", False, False), ("geo/Point.kt", "FUNCTION", "freeFn", "", False, False), ("geo/Point.kt", "FUNCTION", "later", "", False, True),
    ("m.py", "FUNCTION", "mean", "", False, False), ("m.py", "STRUCT", "Box", "", False, False), ("m.py", "IMPL_METHOD", "get", "Box", False, True), ("m.py", "IMPL_METHOD", "put", "Box", False, False),
    ("shape.hpp", "STRUCT", "Shape", "", False, False), ("shape.hpp", "IMPL_METHOD", "area", "Shape", False, False), ("shape.hpp", "FUNCTION", "used", "", False, False),
]


@query(f"SELECT * FROM {values(_SYMBOLS, 'unit, kind, name, parent, is_test, is_stub')}")
def parsed_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return C.symbols(files(spark)).select("unit", "kind", "name", "parent", "is_test", "is_stub")


@query(f"SELECT unit, count(*) AS functions, count(*) FILTER (is_test) AS tests, count(*) FILTER (is_stub) AS stubs FROM {values(_SYMBOLS, 'unit, kind, name, parent, is_test, is_stub')} WHERE kind IN ('FUNCTION', 'IMPL_METHOD') GROUP BY unit")
def parsed_functions(spark: SparkSession, sf: str) -> DataFrame:
    s = C.symbols(files(spark)).filter(F.col("kind").isin("FUNCTION", "IMPL_METHOD"))
    return s.groupBy("unit").agg(F.count("*").alias("functions"), F.count_if("is_test").alias("tests"), F.count_if("is_stub").alias("stubs"))


@query("SELECT * FROM (VALUES ('src/point.rs', 'free_fn', 'unused'), ('geo/Point.kt', 'freeFn', 'unused'), ('m.py', 'mean', 'weights'), ('shape.hpp', 'area', 'h')) AS t(unit, name, param)")
def unused_params(spark: SparkSession, sf: str) -> DataFrame:
    return C.unused_parameters(files(spark)).select("unit", "name", "param")


_DIRTY = [("clean", "// port-lint: source a/parse_tree.rs\nval x = 1 // it's fine\n"), ("fn", "fn main() { let x = vec![1]; }"), ("snake", "val my_value = 1"), ("suppress", '@Suppress("unused") val a = 1'), ("life", "// borrows for 'a here"), ("rider", "// port-lint: source a.rs fn cheat()")]


@query("SELECT * FROM (VALUES ('clean', ''), ('fn', 'fn in code;let in code;macro in code'), ('snake', 'snake_case my_value in code'), ('suppress', 'suppression'), ('life', 'lifetime in comments'), ('rider', 'fn in comments')) AS t(unit, reasons)")
def contamination(spark: SparkSession, sf: str) -> DataFrame:
    return C.contamination(spark.createDataFrame(_DIRTY, "unit string, text string"))


@query("SELECT * FROM (VALUES ('src/point.rs', 1, 2, 0), ('geo/Point.kt', 1, 1, 0), ('m.py', 1, 0, 0), ('shape.hpp', 0, 0, 0)) AS t(unit, doc, line, block)")
def comment_stats(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("lang") == "rust", F.concat("text", F.lit("// last"))).otherwise(F.col("text"))
    return C.comments(files(spark).withColumn("text", text)).select("unit", "doc", "line", "block")


@query("SELECT * FROM (VALUES ('m.py', 1, 2, 1, 0, 1, 1)) AS t(unit, imports, names, casts, conversions, operators, subscripts)")
def numpy_audit(spark: SparkSession, sf: str) -> DataFrame:
    return C.array_lint(files(spark).filter("lang = 'python'")).drop("other")


@query()
def parsed_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and depths of the trees of all pages and of the literal texts."""
    pages = table(spark, sf, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("unit"), F.lit("html").alias("lang"), F.col("html").alias("text"))
    return T.measures(C.parse_nodes(files(spark).unionByName(pages), TAGS))


@query()
def identifier_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.identifiers(files(spark))


@query()
def two_file_report(spark: SparkSession, sf: str) -> DataFrame:
    return compare.two_files(spark, FILES[0], FILES[1])


@query()
def deep_comparison(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark).withColumnRenamed("unit", "path")
    return compare.deep(f.filter("lang = 'rust'"), f.filter("lang = 'kotlin'"))


@query()
def symbol_parity_of_texts(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark).withColumnRenamed("unit", "path")
    return compare.symbol_parity(f.filter("lang = 'rust'"), f.filter("lang = 'kotlin'"))


@query()
def tree_lstm_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return tree_lstm.embed(trees(spark))
