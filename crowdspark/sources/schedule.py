"""Park schedule documents -> per-day opening / closing wall-clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse_day, wall_clock_hhmm


def schedule_entries(payloads: DataFrame) -> DataFrame:
    """One row per entry: park_id, year_month, pos, date, opening_time, closing_time.

    Times are the local wall-clock 'HH:MM' of the ISO text ('Z' or any offset is not
    applied).  An entry whose times do not parse has NULL times and ``bad`` = true.
    """
    e = payloads.select("park_id", "year_month", F.posexplode("schedule").alias("pos", "entry"))
    o = wall_clock_hhmm(F.col("entry.openingTime"))
    c = wall_clock_hhmm(F.col("entry.closingTime"))
    return e.select("park_id", "year_month", "pos", parse_day(F.col("entry.date")).alias("date"),
                    o.alias("opening_time"), c.alias("closing_time"),
                    (o.isNull() | c.isNull() | parse_day(F.col("entry.date")).isNull()).alias("bad"))


def schedule_day(payloads: DataFrame, days: DataFrame) -> DataFrame:
    """For each asked (park_id, date) the times of its month document's first entry for the day,
    and a NULL pair where the document has none or the entry's times do not parse."""
    e = schedule_entries(payloads).where(F.col("date").isNotNull())
    first = e.groupBy("park_id", "date").agg(
        F.min_by(F.struct("opening_time", "closing_time", "bad"), F.struct("year_month", "pos")).alias("t"))
    good = F.col("t").isNotNull() & ~F.col("t.bad")
    return days.select("park_id", "date").join(first, ["park_id", "date"], "left").select(
        "park_id", "date", F.when(good, F.col("t.opening_time")).alias("opening_time"),
        F.when(good, F.col("t.closing_time")).alias("closing_time"))


def schedule_days(payloads: DataFrame, strict_month: bool = True) -> DataFrame:
    """(park_id, date, opening_time, closing_time): the last entry of a date wins.

    With ``strict_month`` a single unparseable entry voids its whole month document, the
    way one failure discards the month's response.
    """
    e = schedule_entries(payloads)
    if strict_month:
        bad_docs = e.where("bad").select("park_id", "year_month").distinct()
        e = e.join(bad_docs, ["park_id", "year_month"], "left_anti")
    e = e.where(~F.col("bad"))
    last = e.groupBy("park_id", "date").agg(
        F.max_by(F.struct("opening_time", "closing_time"), F.struct("year_month", "pos")).alias("t"))
    return last.select("park_id", "date", "t.opening_time", "t.closing_time")
