"""Scores, statuses and totals of matched pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLETE, PARTIAL, LOW = 0.85, 0.6, 0.4


def deficit(src: Column, tgt: Column) -> Column:
    return F.greatest(src - tgt, F.lit(0))


def priority(dependents: Column, symbol_deficit: Column, surface: Column, similarity: Column) -> Column:
    """Dependents first, then missing symbols, then size, then dissimilarity."""
    return dependents * 1e6 + symbol_deficit * 1e4 + surface * 100.0 + F.greatest(F.lit(0.0), 1.0 - similarity) * 10.0


def priority_simple(dependents: Column, similarity: Column) -> Column:
    return dependents * (1.0 - similarity)


def issue(stub: Column, similarity: Column, functions: Column, types: Column, tests: Column, lint: Column, todos: Column) -> Column:
    return (
        F.when(stub, "STUB").when(similarity < LOW, "LOW_SIM").when(functions > 0, "MISSING_FUNCS").when(types > 0, "MISSING_TYPES")
        .when(tests > 0, "MISSING_TESTS").when(lint > 0, "LINT").when(todos > 0, "TODO").otherwise("")
    )


def bucket(stub: Column, similarity: Column) -> Column:
    return F.when(stub, "critical").when(similarity >= COMPLETE, "complete").when(similarity >= PARTIAL, "partial").otherwise("critical")


def buckets(matches: DataFrame) -> DataFrame:
    """quality, n and the average similarity of those that are no stubs."""
    return matches.groupBy(bucket(F.col("stub"), F.col("similarity")).alias("quality")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(~F.col("stub"), F.col("similarity"))), 6).alias("mean"))


def status_order(matches: DataFrame) -> DataFrame:
    return matches.orderBy("similarity", F.desc("stub"), F.desc("dependents"), F.desc(F.col("src_functions") - F.col("tgt_functions")), "src")


def totals(matches: DataFrame) -> DataFrame:
    incomplete = (F.col("similarity") < PARTIAL) | F.col("stub")
    return matches.agg(
        F.count("*").alias("pairs"), F.count_if(incomplete).alias("incomplete"), F.count_if("stub").alias("stubs"), F.sum("todos").alias("todos"), F.sum("lint").alias("lint"),
        F.sum(deficit(F.col("src_functions"), F.col("tgt_functions"))).alias("missing_functions"), F.round(F.avg(F.when(~F.col("stub"), F.col("similarity"))), 6).alias("mean_similarity"),
        F.round(100.0 * F.sum(F.least("src_functions", "tgt_functions")) / F.sum("src_functions"), 6).alias("parity_percent"),
    )


def doc_gaps(docs: DataFrame, least: float = 0.2, lines: int = 5) -> DataFrame:
    from .similarity import doc_gap

    gap = doc_gap(F.col("src_docs"), F.col("tgt_docs"))
    return docs.withColumn("gap", gap).filter((F.col("gap") > least) & (F.col("src_docs") > lines)).orderBy(F.desc(F.col("gap") * F.col("src_docs")), "src")


def lint_score(casts: Column, names: Column, conversions: Column, operators: Column, imports: Column, subscripts: Column, other: Column) -> Column:
    """Weighted findings of a Python file that should not lean on arrays of another library."""
    return casts * 10 + names * 3 + conversions * 8 + operators * 8 + imports * 20 + subscripts * 5 + other


def markdown(df: DataFrame, title: str) -> DataFrame:
    """A report as lines of text: a heading, a header row, and the rows of df in its order."""
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    spark = df.sparkSession
    body = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |")).alias("value"))
    return spark.createDataFrame([(h,) for h in head], "value string").unionAll(body)


def rule_score(text: Column, tree: Column, parity: Column, coverage: Column, penalty: Column) -> Column:
    """A transliteration's score by rule: text and tree alike, parity of symbols, coverage, less a penalty; 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.35 * text + 0.35 * tree + 0.2 * parity + 0.1 * coverage - penalty))


def stub_functions(missing: DataFrame) -> DataFrame:
    """unit and the text of stubs for its missing functions (unit, name, args), in the order of their names."""
    from ..functions.names import camel

    line = F.concat(F.lit("fun "), camel(F.col("name")), F.lit("("), "args", F.lit(') { TODO("port") }'))
    return missing.groupBy("unit").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
