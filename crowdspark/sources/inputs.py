"""What the training and inference pipelines read: one object with a table per input.

``from_folder`` reads what ingest stored and the services' JSON documents; ``from_tables`` maps
the driver's tables onto the same shapes.  The pipelines know only this object.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import align
from ..schema import DAILY_WEATHER, PARK_INFO
from ..session import materialise
from . import documents, landed, sinks
from .readings import scan_park_info, scan_readings


@dataclass
class Inputs:
    # stored readings: date, ride_id, time_of_day, queue_time, is_closed; of all days, or of those in
    # the ``date`` column of a frame
    readings: Callable[..., DataFrame]
    park_info: DataFrame                         # ride_id, park_id, ride_name
    parks: DataFrame                             # park directory document
    aliases: DataFrame                           # name_lower, alpha2 of countries
    public_holidays: DataFrame
    school_holidays: DataFrame
    schedule: DataFrame
    weather: DataFrame                           # park_id, date, tavg, prcp, wspd
    forecast: Callable[[str], DataFrame]         # as-of day -> forecast documents


def from_tables(spark: SparkSession, sf_dir: str, missing_park: str = "3", short_park: str = "2",
                short_days: int = 6) -> Inputs:
    """The driver's tables: raw events are aligned and stored as ingest would."""
    def readings(days: DataFrame | None = None) -> DataFrame:
        raw = landed.events_readings(spark, sf_dir)
        if days is not None:
            raw = sinks.readings_of_days(raw, days)
        a = align.align_to_slots(raw).select("date", "ride_id", "time_of_day", "queue_time", "is_closed")
        return materialise(a, "readings") if days is None else a

    weather = landed.events_weather(spark, sf_dir)
    return Inputs(
        readings, landed.events_park_info(spark, sf_dir), landed.park_directory(spark, sf_dir),
        landed.country_aliases(spark, sf_dir), landed.public_holidays(spark, sf_dir),
        landed.school_periods(spark, sf_dir), landed.schedule_payloads(spark, sf_dir), weather,
        lambda as_of: landed.forecast_payloads(weather, as_of, missing_park=missing_park, short_park=short_park,
                                               short_days=short_days))


def from_folder(spark: SparkSession, path: str) -> Inputs:
    """A folder of stored tables and documents:

    queue_data/, park_info/        Parquet, as ingest writes them
    weather/                       Parquet: park_id, date, tavg, prcp, wspd
    countries.csv                  name, code
    parks.json                     park directory
    public_holidays.json, school_holidays.json, schedule.json, forecast.json
                                   a file or a folder of files each
    """
    base = path.rstrip("/")

    def docs(kind: str) -> DataFrame:
        return documents.read_documents(spark, f"{base}/{kind}.json", kind)

    def readings(days: DataFrame | None = None) -> DataFrame:
        stored = sinks.read_readings(spark, f"{base}/queue_data")
        if days is not None:
            stored = sinks.readings_of_days(stored, days)
        return scan_readings(spark, stored, columns=["date", "ride_id", "time_of_day", "queue_time", "is_closed"])

    countries = spark.read.option("header", True).schema("name string, code string").csv(f"{base}/countries.csv")
    return Inputs(
        readings, scan_park_info(spark, spark.read.schema(PARK_INFO).parquet(f"{base}/park_info"), columns=PARK_INFO.fieldNames()),
        docs("parks"), countries.selectExpr("lower(name) as name_lower", "upper(code) as alpha2"),
        docs("public_holidays"), docs("school_holidays"), docs("schedule"),
        spark.read.schema(DAILY_WEATHER).parquet(f"{base}/weather"), lambda as_of: docs("forecast"))


def export_folder(spark: SparkSession, inputs: Inputs, path: str, as_of: str) -> None:
    """Write any inputs in the layout ``from_folder`` reads (documents one per line)."""
    from pyspark.sql import functions as F

    base = path.rstrip("/")
    slots = inputs.readings()
    if "slot" not in slots.columns:
        slots = slots.withColumn("slot", F.to_timestamp(F.concat_ws(" ", F.col("date").cast("string"), F.col("time_of_day"))))
    sinks.create_tables(spark, f"{base}/queue_data", f"{base}/park_info")
    sinks.ingest_readings(slots, inputs.park_info, f"{base}/queue_data")
    inputs.park_info.write.mode("overwrite").parquet(f"{base}/park_info")
    inputs.weather.write.mode("overwrite").parquet(f"{base}/weather")
    inputs.aliases.selectExpr("name_lower as name", "alpha2 as code").write.mode("overwrite").option("header", True).csv(
        f"{base}/countries.csv")
    for kind, df in (("parks", inputs.parks), ("public_holidays", inputs.public_holidays),
                     ("school_holidays", inputs.school_holidays), ("schedule", inputs.schedule),
                     ("forecast", inputs.forecast(as_of))):
        df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{base}/{kind}.json")
