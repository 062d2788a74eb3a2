"""Files as tables, and tables as files: corpora, configurations, task lists, compiler logs, reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N

EXTENSIONS = {"rust": ("rs",), "kotlin": ("kt", "kts"), "cpp": ("cpp", "hpp", "cc", "h"), "python": ("py",), "typescript": ("ts", "tsx")}
SKIP = r"/(target|build|_deps|node_modules|vendor)/|/build_"
SKIP_DIRECTORY_SCAN = r"/(vendor|build|tmp|\.git)/"
CONFIG_SCHEMA = "type string, name string, source struct<path:string,language:string>, target struct<path:string,language:string>, reexport_modules array<string>"
TASK_SCHEMA = "source_root string, target_root string, tasks array<struct<source_path:string,target_path:string,dependents:bigint,similarity:double,status:string,assigned_to:string,assigned_at:string,completed_at:string>>"
DEFAULT_CONFIG = dict(type="port", name="", source=dict(path="", language="rust"), target=dict(path="", language="kotlin"), reexport_modules=[])


def _rows(df: DataFrame, root: str) -> DataFrame:
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + root.rstrip("/").replace(".", r"\."), "")
    rel = F.regexp_replace(rel, "^/+", "")
    return df.select(rel.alias("path"), N.language(F.col("path")).alias("lang"), F.decode("content", "UTF-8").alias("text"), F.col("length").alias("bytes"))


def scan(spark: SparkSession, root: str, language: str | None = None, skip: str = SKIP) -> DataFrame:
    """path (below root), lang, text and bytes of the source files under root, or of the one file that root is.

    Extensions are filtered by the reader, before a file is opened."""
    if os.path.isfile(root):
        return _rows(spark.read.format("binaryFile").load(root), os.path.dirname(root))
    wanted = EXTENSIONS[language] if language else tuple(e for x in EXTENSIONS.values() for e in x)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(wanted) + "}").load(root)
    return _rows(df.filter(~F.col("path").rlike(skip)), os.path.abspath(root) if "://" not in root else root)


def with_tests(spark: SparkSession, root: str, language: str | None = None) -> DataFrame:
    """As scan, with the tests beside a source root below src/commonMain/kotlin."""
    main = scan(spark, root, language)
    twin = root.replace("/src/commonMain/kotlin", "/src/commonTest/kotlin")
    return main.unionByName(scan(spark, twin, language)) if twin != root and os.path.isdir(twin) else main


def units(files: DataFrame) -> DataFrame:
    """unit, lang, paths and text: the files of a logical unit, headers first, joined by blank lines."""
    part = F.struct((~N.is_header(F.col("path"))).alias("h"), "path", "text")
    g = files.groupBy(N.unit_key(F.col("path")).alias("unit"), "lang").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return g.select("unit", "lang", F.transform("parts", lambda p: p["path"]).alias("paths"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"))


def compiler_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line").filter(F.col("line").startswith("e: "))


def config(spark: SparkSession, path: str) -> DataFrame:
    """One row; what a file lacks is null, and a list that it lacks is empty."""
    c = spark.read.schema(CONFIG_SCHEMA).json(path, multiLine=True)
    return c.withColumn("reexport_modules", F.coalesce("reexport_modules", F.array().cast("array<string>")))


def write_default_config(path: str) -> bool:
    """Writes a configuration to fill in, unless there is one."""
    if os.path.exists(path):
        return False
    with open(path, "w") as f:
        json.dump(DEFAULT_CONFIG, f, indent=2)
    return True


def is_reexport(path: Column, patterns: list[str]) -> Column:
    expr = F.lit(False)
    for p in patterns:
        expr = expr | N.glob(path, p)
    return expr


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """The tasks of a task file; a status that isn't known is pending."""
    known = ("pending", "assigned", "completed", "blocked")
    t = spark.read.schema(TASK_SCHEMA).json(path, multiLine=True).select(F.explode("tasks").alias("t")).select("t.*")
    return t.withColumn("status", F.when(F.col("status").isin(*known), F.col("status")).otherwise("pending"))


def write_tasks(df: DataFrame, path: str) -> None:
    """As one JSON document of tasks, the way it is read."""
    df.agg(F.collect_list(F.struct(*df.columns)).alias("tasks")).coalesce(1).write.mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Lines of text (value) as a report; reports are short, so one file."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
