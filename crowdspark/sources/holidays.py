"""Public holidays and school-holiday periods as day tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import date_days, parse_day
from ..operators.report import in_order


def public_holiday_days(rows: DataFrame) -> DataFrame:
    """(country_code, date) distinct; entries without a date are kept out, no type filter."""
    return (rows.where(F.col("date").isNotNull())
            .select("country_code", parse_day("date").alias("date"))
            .where(F.col("date").isNotNull())
            .distinct())


def parse_periods(periods: DataFrame) -> DataFrame:
    """Periods with both days parseable (padded or not); malformed rows skipped."""
    return (periods.select("country", "holiday_name", parse_day("start_date").alias("start_date"),
                           parse_day("end_date").alias("end_date"))
            .where(F.col("start_date").isNotNull() & F.col("end_date").isNotNull()))


def merged_periods(periods: DataFrame) -> DataFrame:
    """(country, start_date, end_date): the periods of a country with those that overlap or follow
    each other day by day joined to one, so that no day lies in two.  Inverted periods give none.

    Of the periods that start on one day only the longest counts; a running maximum of the ends
    over the starts before shows where a gap begins (gaps and islands).  The window sees at most
    one row per country and day of the calendar, however many periods there are."""
    p = parse_periods(periods).where(F.col("start_date") <= F.col("end_date"))
    longest = p.groupBy("country", "start_date").agg(F.max("end_date").alias("end_date"))
    in_order = Window.partitionBy("country").orderBy("start_date")
    reached = F.max("end_date").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opened = longest.withColumn("_opens", F.coalesce(F.col("start_date") > F.date_add(reached, 1), F.lit(True)).cast("int"))
    island = opened.withColumn("_island", F.sum("_opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return (island.groupBy("country", "_island").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))
            .drop("_island"))


def school_holiday_days(periods: DataFrame) -> DataFrame:
    """(country, date), each day of each country's periods once: merged periods become days, so as
    many rows are made as the result has."""
    return merged_periods(periods).select("country", F.explode(date_days("start_date", "end_date")).alias("date"))


def period_metrics() -> list[Column]:
    """Aggregates over period rows as they come: how many there are, how many have a day that cannot
    be read, and how many end before they begin (B17); for ``observe`` beside the result."""
    start, end = parse_day("start_date"), parse_day("end_date")
    return [F.count("*").alias("periods"), F.count_if(start.isNull() | end.isNull()).alias("unreadable"),
            F.count_if(end < start).alias("inverted")]


def periods_in_order(periods: DataFrame) -> DataFrame:
    """Periods in the order of their start day (the order the source is asked for), ties by country
    and name, each with its 1-based ``place``."""
    return in_order(parse_periods(periods), by=("start_date", "country", "holiday_name"))
