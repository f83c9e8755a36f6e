"""The stored tables by name: readings and rides in the session's catalog, bucketed by ride.

Both tables are dealt into the same number of buckets by ride and sorted in them, so the lookup of
a reading's ride, and anything grouped by ride, meets without moving the readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import PARK_INFO, QUEUE_DATA

READINGS, RIDES = "queue_data", "park_info"
BUCKETS = 64                    # files a day at least; the same in both tables
_KEPT = ("ride_id", "date")


def _columns(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)


def create_tables(spark: SparkSession, location: str, buckets: int = BUCKETS, readings: str = READINGS,
                  rides: str = RIDES) -> None:
    """Create both tables below ``location`` (a folder all executors share) where they do not exist;
    the readings are partitioned by day, too.  Existing tables stay as they are."""
    for name, schema, days in ((readings, QUEUE_DATA, "PARTITIONED BY (date) "), (rides, PARK_INFO, "")):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_columns(schema)}) USING parquet {days}"
                  f"CLUSTERED BY (ride_id) SORTED BY (ride_id) INTO {buckets} BUCKETS "
                  f"LOCATION '{location.rstrip('/')}/{name.split('.')[-1]}'")


def insert(df: DataFrame, name: str, overwrite: bool = False) -> None:
    """Append the rows to the table, or with ``overwrite`` replace the days they hold; columns go
    by name."""
    columns = df.sparkSession.table(name).columns
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.select(*columns).write.insertInto(name, overwrite=overwrite)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def insert_new_rides(rides: DataFrame, name: str = RIDES) -> None:
    """Append the rides whose key the table does not hold (``sinks.insert_or_ignore``); ``rides``
    carries the arrival order in ``date`` and ``pos``."""
    from .sinks import insert_or_ignore
    insert(insert_or_ignore(rides.sparkSession.table(name), rides), name)
