"""Table writers: readings append, ride dimension insert-or-ignore, CSV export.

Stored readings lie in folders by park and day, so the days a park has are known from the folders
alone, and a request for some days or parks reads only theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.labels import unique_ride_parks
from ..operators.worklist import last_stored_day
from ..schema import PARK_INFO, QUEUE_DATA

STORED = T.StructType([*QUEUE_DATA.fields, T.StructField("park_id", T.StringType())])
FOLDERS = ("park_id", "date")


def create_tables(spark: SparkSession, readings_path: str, park_info_path: str) -> None:
    """Create empty readings / ride tables when absent; read them under their fixed schemas
    (``read_readings``, ``PARK_INFO``), as a table without rows holds no file to read one from."""
    for path, schema, parts in ((readings_path, STORED, FOLDERS), (park_info_path, PARK_INFO, ())):
        w = spark.createDataFrame([], schema).write.mode("ignore")
        (w.partitionBy(*parts) if parts else w).parquet(path)


def _folders(df: DataFrame) -> list[str]:
    return [c for c in FOLDERS if c in df.columns]


def _dealt(df: DataFrame) -> DataFrame:
    """Clustered by folder in tasks of measured size: adaptive execution splits what is larger than
    its advisory size over as many tasks as that takes, and puts small folders together."""
    return df.hint("rebalance", *[F.col(c) for c in _folders(df)])


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """The stored readings under their fixed schema; a table without rows reads as empty."""
    return spark.read.schema(STORED).parquet(path)


def readings_of_days(readings: DataFrame, days: DataFrame) -> DataFrame:
    """The readings of the requested ``days`` (date, ...): of a table in folders by day only those
    days' folders are read.  The request is one row per day of the calendar at most, which bounds
    what is sent to all tasks."""
    wanted = days.select("date").where(F.col("date") >= F.lit(EARLIEST).cast("date")).distinct()
    return readings.join(F.broadcast(wanted), "date", "left_semi")


EARLIEST = "1900-01-01"         # no readings before; a comparison lets Spark see that a request selects


def append_readings(df: DataFrame, path: str) -> None:
    """Append readings in folders by park (where known) and day; no de-duplication (a re-run
    appends again)."""
    _dealt(df).write.mode("append").partitionBy(*_folders(df)).parquet(path)


def unstored_readings(readings: DataFrame, stored: DataFrame) -> DataFrame:
    """Readings (with park_id) that lie after their park's last stored day (all of a park without
    any); rides of no known park count as one park."""
    last = last_stored_day(stored).select(F.col("park_id").alias("_park"), F.col("last_day").alias("_last"))
    out = readings.join(last, F.col("park_id").eqNullSafe(F.col("_park")), "left")
    return out.where(F.col("_last").isNull() | (F.col("date") > F.col("_last"))).select(*readings.columns)


def ingest_readings(readings: DataFrame, park_info: DataFrame, path: str) -> None:
    """Append what is not stored yet, resuming each park after its last stored day: running it
    again with the same input adds nothing.  A ride of two parks raises."""
    spark = readings.sparkSession
    rows = readings.select(*QUEUE_DATA.fieldNames()).join(unique_ride_parks(park_info), "ride_id", "left")
    append_readings(unstored_readings(rows.select(*STORED.fieldNames()), read_readings(spark, path)), path)


def overwrite_reading_days(df: DataFrame, path: str) -> None:
    """Replace exactly the day folders present in ``df`` (dynamic partition overwrite): re-running
    a day is idempotent, other days are untouched."""
    (_dealt(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*_folders(df)).parquet(path))


def first_per_key(rows: DataFrame, keys=("ride_id", "park_id"), order_cols=("date", "pos")) -> DataFrame:
    """First row per key by arrival order (what a sequence of insert-or-ignore keeps)."""
    others = [c for c in rows.columns if c not in keys and c not in order_cols]
    g = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order_cols)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys=("ride_id", "park_id"),
                     order_cols=("date", "pos")) -> DataFrame:
    """Rows of ``incoming`` whose key is new (first arrival wins), to be appended."""
    return first_per_key(incoming, keys, order_cols).join(existing.select(*keys), list(keys), "left_anti")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line, no index; one part per task (no funnel into a single file)."""
    df.write.mode("overwrite").option("header", True).csv(path)
