"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_own_dir: str | None = None

#: Bytes of the Arrow batches that pass between an executor and its Python workers; Spark's own limit is 64 MB, of which
#: either side holds several.
BATCH_BYTES = 4 << 20


class Kept(dict):
    """What a Python worker keeps from one partition to the next. tidy() empties it behind a partition that didn't ask for any."""

    every: list[Kept] = []

    def __init__(self):
        super().__init__()
        self.asked = False
        self.every.append(self)

    def made(self, key: object, make: Callable[[], object]) -> object:
        self.asked = True
        if key not in self:
            self[key] = make()
        return self[key]


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by ``BATCH_BYTES``, unless its application was started with a bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests, which run
    in one process). A cluster without the setting is an error, as its executors would not see a folder made here."""
    global _own_dir
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there.rstrip("/")
    set_already = spark.sparkContext.getCheckpointDir()
    if set_already:
        return set_already.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="quillmatch-")
    spark.sparkContext.setCheckpointDir(_own_dir)
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def result_path(spark: SparkSession, name: str) -> str:
    """A fresh path for files that a result is read from: they go when the driver's process ends."""
    path = new_path(spark, name)
    atexit.register(_forget, path)
    return path


def _forget(path: str) -> None:
    where, inner = filesystem(path)
    if where.get_file_info(inner).type == fs.FileType.Directory:
        where.delete_dir(inner)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of ours in the shared folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, so that a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system and the path within it, for a URI or a plain path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, in as many partitions as there are cores where it has fewer: a file of one row group can't be split."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def list_array(values: np.ndarray, ptr: np.ndarray, kind: pa.DataType, valid: np.ndarray | None = None) -> pa.ListArray:
    """A list column of values[ptr[i]:ptr[i+1]]; null where valid is false."""
    mask = None if valid is None or valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(values, kind), mask=mask)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def tidy() -> None:
    """Gives memory that a partition's arrays held back to the system, as workers live on for later stages."""
    for kept in Kept.every:
        if not kept.asked:
            kept.clear()
        kept.asked = False
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; it keeps the memory


def fold_arrow(df: DataFrame, start: Callable[[], object], step: Callable[[object, pa.RecordBatch], None], end: Callable[[object], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow that gathers into start() over a whole partition and yields end() once."""
    kind = T.StructType.fromDDL(schema)
    arrow = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, any_rows = start(), False
        for batch in batches:
            step(state, batch)
            any_rows = True
        tidy()
        for out in end(state) if any_rows else ():
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name]).cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def gather_arrow(df: DataFrame, start: Callable[[], object], step: Callable[[object, pa.RecordBatch], Iterator[dict]], end: Callable[[object], Iterator[dict]], schema: str) -> DataFrame:
    """fold_arrow whose step() yields too, for what it can't hold until the end."""
    kind = T.StructType.fromDDL(schema)
    arrow = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            for out in step(state, batch):
                yield _record(out, arrow)
        tidy()
        for out in end(state):
            yield _record(out, arrow)

    return df.mapInArrow(run, kind)


def _record(out: dict, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[f.name]).cast(f.type) for f in arrow], schema=arrow)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow where fn yields dicts of columns for each batch; they are cast to the schema given."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fn(batch):
                cols = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in (out[f.name] for f in arrow)]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)
        tidy()

    return df.mapInArrow(run, kind)
