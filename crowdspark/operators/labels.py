"""Target construction: readings -> park per reading -> two-level daily mean -> crowd level.

Plan shape: readings scan (is_closed pushed down) -> join with the ride dimension (no hint:
adaptive execution broadcasts it if its measured size allows, and splits a skewed ride
otherwise) -> partial + final hash aggregate on (date, park, ride) -> hash aggregate on (date, park) -> one window
sorted by (park, mean) over park-days (already aggregated, so bounded by parks x days).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import round_half_even_int, round_to


def unique_ride_parks(park_info: DataFrame) -> DataFrame:
    """ride_id -> park_id, one row per ride; a ride listed under two parks raises when used.

    A plain join would silently duplicate readings; the lookup must be a function of the ride.
    """
    g = park_info.where(F.col("ride_id").isNotNull()).groupBy("ride_id").agg(
        F.min("park_id").alias("park_id"), F.count("*").alias("_n_parks"))
    return g.select("ride_id", F.when(F.col("_n_parks") > 1,
                                      F.raise_error(F.concat(F.lit("ride maps to several parks: "), F.col("ride_id"))))
                    .otherwise(F.col("park_id")).alias("park_id"))


def normalise_park_ids(df: DataFrame, include_park_ids=None) -> DataFrame:
    """park_id -> number (bad -> dropped) -> int; optional include list (scalar or list)."""
    num = F.col("park_id").cast("string").try_cast("double")
    df = df.where(num.isNotNull()).withColumn("park_id", num.cast("int"))
    if include_park_ids is not None:
        ids = [include_park_ids] if isinstance(include_park_ids, (int, str)) else list(include_park_ids)
        df = df.where(F.col("park_id").isin([int(x) for x in ids]))
    return df


def attach_park(readings: DataFrame, park_info: DataFrame, include_park_ids=None) -> DataFrame:
    """Left lookup ride -> park, numeric park ids, include filter."""
    df = readings.join(unique_ride_parks(park_info), on="ride_id", how="left")
    return normalise_park_ids(df, include_park_ids)


def ride_day_mean(readings_with_park: DataFrame) -> DataFrame:
    """Mean wait per (date, park, ride) in full precision; NULL keys dropped, NULL waits skipped."""
    r = readings_with_park.where(F.col("date").isNotNull() & F.col("park_id").isNotNull() & F.col("ride_id").isNotNull())
    return r.groupBy("date", "park_id", "ride_id").agg(F.avg("queue_time").alias("avg_queue_time"))


def park_day_mean(ride_means: DataFrame) -> DataFrame:
    """Unweighted mean of ride means per (date, park); NULL when every ride mean is NULL."""
    return ride_means.groupBy("date", "park_id").agg(F.avg("avg_queue_time").alias("avg_queue_time"))


def percentile_rank_level(park_days: DataFrame, value: str = "avg_queue_time", by: str = "park_id",
                          out: str = "crowd_level") -> DataFrame:
    """Average-rank percentile per ``by`` x 100, half-even rounded to int; a NULL value has no
    level and takes no rank.

    rank_avg = (first rank of the tie + last rank of the tie) / 2; last rank is the RANGE
    count of values up to the current one, so all three terms share one window (one sort).
    ``percent_rank`` / ``cume_dist`` use other definitions.  Values closer than 1e-6 tie, so
    that the last bits of a mean, which depend on the order of addition, cannot split a tie.
    """
    w = Window.partitionBy(by).orderBy(round_to(value).asc_nulls_last())
    first = F.rank().over(w)
    last = F.count(value).over(w)          # default RANGE frame: includes peers
    n = F.count(value).over(Window.partitionBy(by))
    pct = ((first + last) / 2.0) / n * 100.0
    return park_days.withColumn(out, F.when(F.col(value).isNotNull(), round_half_even_int(pct)))


def crowd_levels(readings: DataFrame, park_info: DataFrame, include_park_ids=None, open_only: bool = True) -> DataFrame:
    """(date, park_id string, crowd_level int) per park-day."""
    if open_only:
        readings = readings.where(F.col("is_closed") == 0)
    readings = readings.drop("id")
    with_park = attach_park(readings, park_info, include_park_ids)
    days = park_day_mean(ride_day_mean(with_park))
    lvl = percentile_rank_level(days)
    return lvl.select("date", F.col("park_id").cast("string").alias("park_id"), "crowd_level")


def level_metrics() -> list[Column]:
    """Aggregates over the label frame: rows, parks, and rows without a level (D13); for ``observe``
    beside the result."""
    return [F.count("*").alias("n_rows"), F.array_sort(F.collect_set("park_id")).alias("parks"),
            F.count_if(F.col("crowd_level").isNull()).alias("without_level")]


def level_report(levels: DataFrame) -> DataFrame:
    """Row count and sorted park list (one row)."""
    return levels.agg(*level_metrics()[:2])
