"""Incremental collection work list: per park, the days still to fetch."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import date_days, day_text

DEFAULT_URL = "parks/%s/calendar/%s"


def parse_config_day(text: str) -> dt.date:
    """'YYYY/MM/DD' -> date; anything else raises ValueError."""
    try:
        return dt.datetime.strptime(text, "%Y/%m/%d").date()
    except (TypeError, ValueError) as e:
        raise ValueError(f"not a day of the form 2024/01/31: {text!r}") from e


def check_range(start: str, end: str) -> tuple[dt.date, dt.date]:
    s, e = parse_config_day(start), parse_config_day(end)
    if e < s:
        raise ValueError(f"the range ends ({end}) before it begins ({start})")
    return s, e


def range_problem(start: Column, end: Column) -> Column:
    """What is wrong with a range of day texts, as ``check_range`` sees it, else NULL: for ranges that
    come as rows, where one bad row must not stop the others."""
    def day(text: Column) -> Column:
        return F.when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(text, "yyyy/M/d"))

    s, e = day(start), day(end)
    return (F.when(s.isNull(), "the start is no day").when(e.isNull(), "the end is no day")
            .when(e < s, "the range ends before it begins"))


def days_between(start: Column, end: Column, exclude_months=()) -> Column:
    """Inclusive ascending days without the excluded months (empty when end < start)."""
    days = date_days(start, end)
    if exclude_months:
        ms = F.array(*[F.lit(int(m)) for m in exclude_months])
        days = F.filter(days, lambda d: ~F.array_contains(ms, F.month(d)))
    return days


def last_stored_day(readings: DataFrame, park_info: DataFrame | None = None) -> DataFrame:
    """(park_id, last_day): latest stored day per park.

    Stored readings lie in folders by park and day: their own ``park_id`` is used, and as both
    columns come from the folders' names, no column of a file is read.  Readings without a park
    get it through the ride dimension."""
    if "park_id" in readings.columns:
        return readings.groupBy("park_id").agg(F.max("date").alias("last_day"))
    r = readings.groupBy("ride_id").agg(F.max("date").alias("date"))       # rides, not readings, are joined
    return (r.join(park_info.select("ride_id", "park_id"), "ride_id")
            .groupBy("park_id").agg(F.max("date").alias("last_day")))


def stored_gaps(readings: DataFrame, park_info: DataFrame, exclude_months=()) -> DataFrame:
    """(park_id, date): days between a park's first and last stored day without any reading,
    which resuming after the last stored day never revisits."""
    r = readings.select("ride_id", "date").distinct()
    days = r.join(park_info.select("ride_id", "park_id"), "ride_id").select("park_id", "date").distinct()
    span = days.groupBy("park_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    every = span.select("park_id", F.explode(days_between(F.col("lo"), F.col("hi"), exclude_months)).alias("date"))
    return every.join(days, ["park_id", "date"], "left_anti")


def work_list(parks: DataFrame, start: str, end: str, exclude_months=(), last_days: DataFrame | None = None,
              url_template: str = DEFAULT_URL) -> DataFrame:
    """(park_id, date 'YYYY/MM/DD', url) per park and day still to fetch.

    Without ``last_days`` the whole configured range; with it each park resumes the day
    after its last stored day (never before the configured start).  Gaps before the last
    stored day are not revisited.
    """
    s, e = check_range(start, end)
    p = parks.select("park_id").distinct()
    begin = F.lit(s)
    if last_days is not None:
        p = p.join(last_days, "park_id", "left")
        begin = F.greatest(F.lit(s), F.coalesce(F.date_add("last_day", 1), F.lit(s)))
    days = p.select("park_id", F.explode(days_between(begin, F.lit(e), exclude_months)).alias("d"))
    text = day_text("d", "/")
    return days.select("park_id", text.alias("date"), F.format_string(url_template, F.col("park_id"), text).alias("url"))
