"""Arrow batches between executors and their Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of a batch; Spark's own limit is 64 MB, of which either side holds several.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by ``BATCH_BYTES``, unless its application was started with a bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(BATCH_BYTES))
