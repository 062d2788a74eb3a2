"""Token ids as Parquet list columns: chosen encodings, row groups and page indexes, for selective reads.

Each task writes one file: doc_id, n_tokens and lang delta-encoded or by dictionary, tokens as a list of int32, by
dictionary (ids take 16 bits or fewer) or delta. Every text's ids are decoded and compared with it before they are written.
With ``order="range"`` rows go by ranges of doc_id (and of a hash of the text, so that one doc_id of very many rows is
split too) and are in order within a file, so that a range of doc_ids is in few pages of few files; with "none" they stay
where they are, without a shuffle, and page indexes help only as far as the input was in order. Row groups hold ``ROW_GROUP_TOKENS`` tokens or so, and every page has
min and max in the page index, so a reader that wants some doc_ids, or no tokens, reads those pages only. Files carry
the task attempt in their names and are renamed when complete; the manifest names the files of attempts that counted,
so an executor that is lost, or a second attempt, leaves nothing that a reader would see.

A null text is written with a null list and null n_tokens, an empty one with an empty list. Rows of a repeated or null
doc_id are all written, null ones first, those of one doc_id in no given order. Reads by range give no rows without doc_id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import filesystem, list_array

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ROW_GROUP_TOKENS, PAGE_BYTES = 4_000_000, 256 << 10
FILE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_tokens", pa.int32()), ("tokens", pa.list_(pa.int32()))])
MANIFEST = "file string, row_group int, rows long, tokens long, bytes long"


def write(docs: DataFrame, path: str, encoding: str = "dictionary", tokenizer: str = DEFAULT_RANKS, order: str = "range") -> DataFrame:
    """Writes the token files of docs under path; file, row_group, rows, tokens and bytes of all that counts.

    The work happens when the result is computed: compute it once, and keep it."""
    options = {
        "write_page_index": True, "data_page_size": PAGE_BYTES, "compression": "none", "version": "2.6", "write_statistics": True,
        "use_dictionary": ["lang", "tokens.list.element"] if encoding == "dictionary" else ["lang"],
        "column_encoding": {"doc_id": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"} | ({} if encoding == "dictionary" else {"tokens.list.element": "DELTA_BINARY_PACKED"}),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.parquet"
        where, inner = filesystem(path)
        where.create_dir(inner, recursive=True)
        written, held, tokens = [], [], 0
        with where.open_output_stream(f"{inner}/_{name}") as sink, pq.ParquetWriter(sink, FILE_SCHEMA, **options) as writer:

            def flush() -> None:
                nonlocal held, tokens
                if held:
                    t = pa.Table.from_batches(held, FILE_SCHEMA)
                    writer.write_table(t, row_group_size=max(1, t.num_rows))
                    written.append((t.num_rows, tokens))
                    held, tokens = [], 0

            batch = first
            while batch is not None:
                there = batch.column("text").is_valid().to_numpy(zero_copy_only=False)
                for i, j, _, ids, ptr, _, _ in bpe.encode_batch(batch, tokenizer):
                    ok = there[i:j]
                    held.append(
                        pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").slice(i, j - i), batch.column("lang").slice(i, j - i), pa.array(np.diff(ptr).astype(np.int32), mask=~ok), list_array(ids, ptr, pa.int32(), ok)],
                            schema=FILE_SCHEMA,
                        )
                    )
                    tokens += len(ids)
                    if tokens >= ROW_GROUP_TOKENS:
                        flush()
                batch = next(batches, None)
            flush()
        where.move(f"{inner}/_{name}", f"{inner}/{name}")
        size = where.get_file_info(f"{inner}/{name}").size
        yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"] * len(written), "row_group": pa.array(range(len(written)), pa.int32()), "rows": [r for r, _ in written], "tokens": [t for _, t in written], "bytes": [size] * len(written)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    if order == "range":
        rows = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id")
    return rows.mapInArrow(run, MANIFEST)


def files(manifest: DataFrame) -> list[str]:
    return [r["file"] for r in manifest.select("file").distinct().orderBy("file").collect()]


def read_metadata(spark: SparkSession, names: list[str]) -> DataFrame:
    """doc_id, lang and n_tokens; no page of tokens is read."""
    return read(spark, names).select("doc_id", "lang", "n_tokens")


def read_tokens(spark: SparkSession, names: list[str], low: int, high: int) -> DataFrame:
    """The rows of the documents low to high; row groups and pages without any are skipped."""
    return read(spark, names).filter(F.col("doc_id").between(low, high))


def read(spark: SparkSession, names: list[str]) -> DataFrame:
    schema = "doc_id long, lang string, n_tokens int, tokens array<int>"
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
