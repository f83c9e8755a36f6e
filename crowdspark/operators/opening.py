"""Opening hours per park-day: observed first / last reading, else the published schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import leading_int
from ..schema import OPENING_COLS


def _minute(text) -> F.Column:
    """Minute of the day of 'HH:MM' text; anything else is NULL."""
    t = F.col(text)
    return F.when(t.rlike("^[0-9]{2}:[0-9]{2}$"), F.substring(t, 1, 2).cast("int") * 60 + F.substring(t, 4, 2).cast("int"))


def _hhmm_of(minute) -> F.Column:
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), F.pmod(minute, F.lit(60)))


def _first_last(grouped) -> DataFrame:
    g = grouped.agg(F.min("_minute").alias("_lo"), F.max("_minute").alias("_hi"))
    keys = [c for c in g.columns if c not in ("_lo", "_hi")]
    return g.select(*keys, F.when(F.col("_lo").isNotNull(), _hhmm_of(F.col("_lo"))).alias("opening_time"),
                    F.when(F.col("_hi").isNotNull(), _hhmm_of(F.col("_hi"))).alias("closing_time"))


def first_last_times(readings: DataFrame, park_info: DataFrame | None = None, scope: str = "park") -> DataFrame:
    """First / last 'HH:MM' per day over all readings (closed ones included).

    The times are compared as minutes of the day, which order like the stored fixed-width text
    and keep the aggregation a hash aggregate; text of another shape is skipped.

    scope='park': per (park_id, date) through the ride dimension (what the text intends);
    scope='all' : per date over every park (what the code does), keyed by date only.
    """
    r = readings.select("date", "ride_id", _minute("time_of_day").alias("_minute")).where(F.col("date").isNotNull())
    if scope == "all":
        return _first_last(r.groupBy("date"))
    # one row per ride-day before the join: a park-day meets rides, not readings
    r = r.groupBy("date", "ride_id").agg(F.min("_minute").alias("_a"), F.max("_minute").alias("_b"))
    r = r.select("date", "ride_id", F.explode(F.array("_a", "_b")).alias("_minute"))
    return _first_last(r.join(park_info.select("ride_id", "park_id").distinct(), "ride_id").groupBy("park_id", "date"))


def days_without_history(requested: DataFrame, history: DataFrame) -> DataFrame:
    """Requested (park_id, date) that have no readings: an anti join."""
    keys = [k for k in ("park_id", "date") if k in history.columns]
    return requested.join(history.select(*keys), keys, "left_anti")


def requested_by_month(missing: DataFrame) -> DataFrame:
    """Missing days bucketed by year-month per park (one schedule document each)."""
    return (missing.groupBy("park_id", F.date_format("date", "yyyy-MM").alias("year_month"))
            .agg(F.count("*").alias("n_days"), F.min("date").alias("first_day"), F.max("date").alias("last_day")))


def opening_times(requested: DataFrame, history: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """requested (park_id, date) + opening_time / closing_time.

    A day with readings takes its observed first / last time; only a day without readings
    takes the schedule entry; otherwise NULL.  The choice is per day, not per field.
    """
    keys = [k for k in ("park_id", "date") if k in history.columns]
    h = history.select(*keys, F.col("opening_time").alias("_h_open"), F.col("closing_time").alias("_h_close"),
                       F.lit(True).alias("_has_h"))
    base = [F.col(f"`{c}`") for c in requested.columns]
    out = requested.join(h, keys, "left")
    if schedule is None:
        return out.select(*base, F.col("_h_open").alias("opening_time"), F.col("_h_close").alias("closing_time"))
    s = schedule.select("park_id", "date", F.col("opening_time").alias("_s_open"),
                        F.col("closing_time").alias("_s_close"))
    out = out.join(s, ["park_id", "date"], "left")
    use_h = F.col("_has_h").isNotNull()
    return out.select(*base, F.when(use_h, F.col("_h_open")).otherwise(F.col("_s_open")).alias("opening_time"),
                      F.when(use_h, F.col("_h_close")).otherwise(F.col("_s_close")).alias("closing_time"))


def opening_hour_features(df: DataFrame, drop_missing: bool = True) -> DataFrame:
    """opening_hr, closing_hr (hour part), hours_open_for = closing - opening (may be <= 0).

    When either time fails to parse all three are NULL; such rows are dropped unless
    ``drop_missing`` is False.
    """
    o, c = leading_int("opening_time"), leading_int("closing_time")
    ok = o.isNotNull() & c.isNotNull()
    rest = [F.col(f"`{x}`") for x in df.columns if x not in ("opening_time", "closing_time")]
    out = df.select(*rest, F.when(ok, o).alias("opening_hr"), F.when(ok, c).alias("closing_hr"),
                    F.when(ok, c - o).alias("hours_open_for"))
    return out.na.drop(subset=OPENING_COLS) if drop_missing else out


def add_opening_hours(df: DataFrame, history: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    return opening_hour_features(opening_times(df, history, schedule))
