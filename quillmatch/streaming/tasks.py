"""Task states over a stream of events, as a stateful aggregation with a batch twin in operators.tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tasks import TRANSITIONS
from ..checkpoint import new_path


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream over Parquet files of events; timestamps without a zone become timestamps, for the watermark."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def states(events: DataFrame) -> DataFrame:
    """task and status after its last change; state is one row a task, whatever the number of events."""
    known = events.withColumn("status", F.create_map([F.lit(x) for kv in TRANSITIONS.items() for x in kv])[F.col("event_type")]).filter("status IS NOT NULL")
    return known.groupBy("task").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("changes"))


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by user and window; windows close, and their state goes, once the watermark is past them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count("*").alias("n")).select("w.start", "user_id", "n")


def run(stream: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """All that is there now, run through the stream into Parquet files in the shared folder; the result as a table. Each
    batch has a folder of its own, so a batch that is done again leaves nothing twice; of a complete result the last counts."""
    spark = stream.sparkSession
    path = new_path(spark, "stream")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).trigger(availableNow=True)
    query = writer.option("checkpointLocation", checkpoint or f"{path}-state").start()
    query.awaitTermination()
    batches = spark.read.schema(stream.schema.add("batch", "long")).parquet(path) if query.lastProgress else spark.createDataFrame([], stream.schema.add("batch", "long"))
    if mode == "complete":
        batches = batches.filter(F.col("batch") == (batches.agg(F.max("batch")).first()[0] or 0))
    return batches.drop("batch")
