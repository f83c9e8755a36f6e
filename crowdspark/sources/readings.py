"""Readings and park-dimension scans (projection and predicate reach the Parquet reader)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nan_to_null, parse_day


def _as_frame(spark: SparkSession, src) -> DataFrame:
    if isinstance(src, DataFrame):
        return src
    return spark.read.parquet(src) if "/" in str(src) else spark.table(src)


def scan_readings(spark: SparkSession, src, where: str | Column | None = None,
                  columns: list[str] | None = None, strict_dates: bool = False) -> DataFrame:
    """Readings scan: caller-supplied projection and predicate, day text normalised to DATE.

    ``date`` may be stored as 'YYYY/MM/DD' or 'YYYY-MM-DD' text or as DATE already.  With
    ``strict_dates`` an unparseable day raises (ANSI cast); otherwise it becomes NULL.
    ``queue_time`` NaN is turned into NULL so averages skip it.
    """
    df = _as_frame(spark, src)
    if where is not None:
        df = df.where(where)
    if columns:
        df = df.select(*columns)
    if "date" in df.columns and dict(df.dtypes)["date"] == "string":
        day = (F.to_date(F.translate("date", "/", "-"), "yyyy-M-d") if strict_dates
               else parse_day("date"))
        df = df.withColumn("date", day)
    if "queue_time" in df.columns and dict(df.dtypes)["queue_time"] in ("double", "float"):
        df = df.withColumn("queue_time", nan_to_null("queue_time"))
    return df


def scan_park_info(spark: SparkSession, src, where: str | Column | None = None,
                   columns: list[str] | None = None) -> DataFrame:
    """Ride dimension scan with its own projection / predicate."""
    df = _as_frame(spark, src)
    if where is not None:
        df = df.where(where)
    if columns:
        df = df.select(*columns)
    return df


def open_readings(readings: DataFrame) -> DataFrame:
    """Open readings only, surrogate ``id`` dropped when present."""
    return readings.where(F.col("is_closed") == 0).drop("id")
