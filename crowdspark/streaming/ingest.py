"""Structured Streaming ingest: raw readings -> 15-minute slots -> day-partitioned table.

Each arriving reading proposes its nearest slot (within 7.5 minutes); a streaming
aggregation keyed by (date, ride_id, slot) keeps the nearest reading (ties -> earliest).
The watermark sits on the slot time: once it passes a slot, no later reading can reach that
slot any more, so the row is final and is emitted once (append mode) and appended to the
table by ``foreachBatch`` (one directory per micro-batch id, so a replayed batch overwrites
its own output: exactly-once together with the checkpoint).  Readings older than the watermark are late and are dropped,
like the batch collector that never revisits a stored day.  The open tail (slots within
the watermark delay of the newest reading) stays in the state store until newer readings
arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hhmm, timestamp_from_micros
from ..operators.align import nearest_order, slot_candidates
from ..schema import QUEUE_DATA

RAW_READING = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("ride_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("queue_time", T.IntegerType()),
    T.StructField("is_closed", T.IntegerType()),
])


def aligned_stream(raw: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """Streaming (or batch) frame of raw readings -> final 15-minute slot rows.

    ``delay`` must cover 15 minutes (a slot is final once readings 7.5 minutes past it have
    arrived, and a slot runs up to 7.5 minutes ahead of its reading) plus the disorder of
    arrival."""
    c = slot_candidates(raw).withColumn("slot", timestamp_from_micros(F.col("slot_us")))
    c = c.withWatermark("slot", delay)
    c = c.withColumn("_order", nearest_order())
    g = c.groupBy("date", "ride_id", "slot").agg(*[F.min_by(v, "_order").alias(v) for v in ("queue_time", "is_closed")])
    return g.select("date", "ride_id", "slot", hhmm("slot").alias("time_of_day"), "queue_time", "is_closed")


def read_raw_stream(spark: SparkSession, source_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(RAW_READING)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(source_dir)


def start_ingest(spark: SparkSession, source_dir: str, table_path: str, checkpoint_path: str,
                 delay: str = "30 minutes", available_now: bool = True, files_per_trigger: int | None = None):
    """Start the ingest query; each micro-batch's final slots are appended by day."""
    stream = aligned_stream(read_raw_stream(spark, source_dir, files_per_trigger), delay)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        # one directory per micro-batch, overwritten on replay: a re-run batch after a
        # failure replaces its own output instead of appending it twice
        batch.write.mode("overwrite").partitionBy("date").parquet(f"{table_path}/epoch_id={epoch_id}")

    w = (stream.writeStream.outputMode("append").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint_path))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_table(spark: SparkSession, table_path: str) -> DataFrame:
    """The rows that all micro-batches have written; a table without any reads as empty."""
    fields = [f for f in QUEUE_DATA.fields if f.name != "date"]
    schema = T.StructType([*fields, T.StructField("epoch_id", T.LongType()), T.StructField("date", T.DateType())])
    return spark.read.schema(schema).parquet(table_path).select(
        "date", "ride_id", "slot", "time_of_day", "queue_time", "is_closed")
