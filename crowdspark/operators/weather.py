"""Weather features: observed history, monthly climatology and forecast with fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nan_to_null, parse_day

FORECAST_HORIZON_DAYS = 16
RENAME = {"tavg": "temperature_c", "prcp": "precipitation_mm", "wspd": "wind_speed_kmh"}


def daily_history(weather: DataFrame) -> DataFrame:
    """(park_id, date, temperature_c, precipitation_mm, wind_speed_kmh); NaN -> NULL."""
    return weather.select("park_id", "date", *[nan_to_null(src).alias(dst) for src, dst in RENAME.items()])


def add_weather_history(df: DataFrame, weather: DataFrame, as_of: str | None = None, on_late: str = "null") -> DataFrame:
    """Left join on (park_id, date).

    Like the source that refuses a range ending after today, a park whose requested days
    end after ``as_of`` gets no observations (all NULL) when ``as_of`` is given; with ``on_late``
    = 'error' such a park raises instead of losing its rows to imputation later.
    """
    hist = daily_history(weather)
    out = df.join(hist, ["park_id", "date"], "left")
    if as_of is not None:
        last = F.max("date").over(Window.partitionBy("park_id"))
        late = last > F.to_date(F.lit(as_of))
        if on_late == "error":
            late = F.when(late, F.raise_error(F.concat(F.lit("the requested days end after the as-of day for park "),
                                                       F.col("park_id"))).cast("boolean")).otherwise(F.lit(False))
        out = out.select(*[F.col(f"`{c}`") for c in out.columns if c not in RENAME.values()],
                         *[F.when(~late, F.col(c)).alias(c) for c in RENAME.values()])
    return out


def climatology(weather: DataFrame, as_of: str, years_back: int = 5, months: list[int] | None = None) -> DataFrame:
    """Per (park_id, month): pooled mean of the daily values of the ``years_back`` calendar
    years before the year of ``as_of`` (NULLs skipped per column)."""
    y = F.year(F.to_date(F.lit(as_of)))
    h = daily_history(weather).where((F.year("date") >= y - years_back) & (F.year("date") <= y - 1))
    if months is not None:
        h = h.where(F.month("date").isin(months))
    return h.groupBy("park_id", F.month("date").alias("month")).agg(
        *[F.avg(c).alias(c) for c in RENAME.values()])


def forecast_rows(payloads: DataFrame) -> DataFrame:
    """Forecast responses -> (park_id, date, weather...) by zipping the parallel arrays;
    NULL values are kept.  ``allowed_end`` is the last day the service allows, parsed from
    its message ('... to YYYY-MM-DD')."""
    z = payloads.select(
        "park_id",
        parse_day(F.regexp_extract("reason", r"to (\d{4}-\d{2}-\d{2})", 1)).alias("allowed_end"),
        F.explode(F.arrays_zip(F.col("daily.time").alias("time"),
                               F.col("daily.temperature_2m_mean").alias("t"),
                               F.col("daily.precipitation_sum").alias("p"),
                               F.col("daily.windspeed_10m_mean").alias("w"))).alias("z"))
    return z.select("park_id", "allowed_end", parse_day("z.time").alias("date"),
                    F.col("z.t").cast("double").alias("temperature_c"),
                    F.col("z.p").cast("double").alias("precipitation_mm"),
                    F.col("z.w").cast("double").alias("wind_speed_kmh"))


def add_weather_forecast(df: DataFrame, payloads: DataFrame, clim: DataFrame, as_of: str,
                         horizon_days: int = FORECAST_HORIZON_DAYS) -> DataFrame:
    """Forecast up to its last returned day (capped at as_of + horizon and the allowed end),
    monthly climatology after it; a park without a forecast uses climatology throughout.

    A NULL inside the forecast span stays NULL (the choice is by day, not ``coalesce``).
    """
    start = F.to_date(F.lit(as_of))
    fc = forecast_rows(payloads).where(F.col("date") <= F.date_add(start, horizon_days))
    fc = fc.where(F.col("allowed_end").isNull() | (F.col("date") <= F.col("allowed_end")))
    fc_end = fc.groupBy("park_id").agg(F.max("date").alias("_fc_end"))
    fcv = fc.select("park_id", "date", *[F.col(c).alias(f"_f_{c}") for c in RENAME.values()])
    cl = clim.select("park_id", F.col("month").alias("_month"), *[F.col(c).alias(f"_c_{c}") for c in RENAME.values()])
    out = (df.join(fc_end, "park_id", "left")
           .join(fcv, ["park_id", "date"], "left")
           .withColumn("_month", F.month("date"))
           .join(cl, ["park_id", "_month"], "left"))
    in_fc = F.col("_fc_end").isNotNull() & (F.col("date") <= F.col("_fc_end"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      *[F.when(in_fc, F.col(f"_f_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in RENAME.values()])
