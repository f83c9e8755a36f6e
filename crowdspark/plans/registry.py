"""Registered queries: name -> (Spark callable(spark, sf_dir), DuckDB oracle SQL or None).

Every query reads the driver's tables (through ``sources.landed``) over whole tables; the
result is projected with ``as_report`` (dates as text) and the oracle aliases every column
the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import round_to
from ..operators import labels
from ..session import apply_defaults
from ..sources import landed
from ..sources.readings import open_readings, scan_readings
from . import oracle_views as V
from .output import as_report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_defaults(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


# ------------------------------------------------------------------ readings and labels

def _orders_levels(spark, sf_dir):
    return labels.crowd_levels(scan_readings(spark, landed.orders_readings(spark, sf_dir)),
                               landed.customer_park_info(spark, sf_dir))


@register("scan_open_readings", V.with_ctes(V.R_O) + """
select cast(date as varchar) as date, ride_id, queue_time, is_closed from r_o where is_closed = 0""")
def scan_open_readings(spark, sf_dir):
    """A1 A3 B1 B2: open readings, day text normalised, surrogate id dropped."""
    r = scan_readings(spark, landed.orders_readings(spark, sf_dir, text_dates=True))
    return as_report(open_readings(r))


@register("park_lookup", V.with_ctes(V.R_O, V.P_O, """ride_park as (
  select ride_id, min(park_id) as park_id from p_o group by ride_id)""") + """
select cast(r.date as varchar) as date, r.ride_id, r.queue_time, cast(cast(trunc(try_cast(rp.park_id as double)) as integer) as varchar) as park_id
from r_o r left join ride_park rp using (ride_id)
where try_cast(rp.park_id as double) is not null""")
def park_lookup(spark, sf_dir):
    """Ride -> park lookup (unique), numeric coercion, include filter (all)."""
    r = scan_readings(spark, landed.orders_readings(spark, sf_dir, text_dates=True), columns=["date", "ride_id", "queue_time"])
    out = labels.attach_park(r, landed.customer_park_info(spark, sf_dir), include_park_ids=None)
    return as_report(out.withColumn("park_id", F.col("park_id").cast("string")))


@register("park_lookup_included", V.with_ctes(V.R_O, V.P_O, """ride_park as (
  select ride_id, min(park_id) as park_id from p_o group by ride_id)""") + """
select cast(r.date as varchar) as date, r.ride_id, r.queue_time, rp.park_id
from r_o r join ride_park rp using (ride_id) where rp.park_id in ('2', '7', '11')""")
def park_lookup_included(spark, sf_dir):
    """The same for chosen parks only."""
    r = scan_readings(spark, landed.orders_readings(spark, sf_dir), columns=["date", "ride_id", "queue_time"])
    out = labels.attach_park(r, landed.customer_park_info(spark, sf_dir), include_park_ids=[2, "7", 11])
    return as_report(out.withColumn("park_id", F.col("park_id").cast("string")))


@register("ride_day_mean", V.with_ctes(V.R_O, V.P_O, V.LEVELS_O) + """
select cast(date as varchar) as date, cast(park_id as varchar) as park_id, ride_id, """ + V.r6("avg_queue_time") + """ as avg_queue_time from ride_day""")
def ride_day_mean(spark, sf_dir):
    """Mean wait per (date, park, ride) over open readings."""
    r = open_readings(scan_readings(spark, landed.orders_readings(spark, sf_dir)))
    m = labels.ride_day_mean(labels.attach_park(r, landed.customer_park_info(spark, sf_dir)))
    return as_report(m.select("date", F.col("park_id").cast("string").alias("park_id"), "ride_id",
                              round_to("avg_queue_time").alias("avg_queue_time")))


@register("park_day_mean", V.with_ctes(V.R_O, V.P_O, V.LEVELS_O) + """
select cast(date as varchar) as date, cast(park_id as varchar) as park_id, """ + V.r6("avg_queue_time") + """ as avg_queue_time from park_day""")
def park_day_mean(spark, sf_dir):
    """Unweighted mean of ride means per (date, park)."""
    r = open_readings(scan_readings(spark, landed.orders_readings(spark, sf_dir)))
    m = labels.park_day_mean(labels.ride_day_mean(labels.attach_park(r, landed.customer_park_info(spark, sf_dir))))
    return as_report(m.select("date", F.col("park_id").cast("string").alias("park_id"),
                              round_to("avg_queue_time").alias("avg_queue_time")))


@register("crowd_level", V.with_ctes(V.R_O, V.P_O, V.LEVELS_O) + """
select cast(date as varchar) as date, park_id, crowd_level from levels""")
def crowd_level(spark, sf_dir):
    """E1 I6 (+ D1 D2 C1): percentile crowd level 0-100 per park-day."""
    return as_report(_orders_levels(spark, sf_dir))


@register("crowd_level_missing", V.with_ctes(
    "r_o as (select * replace (case when month(date) = 3 then null else queue_time end as queue_time) from ("
    + V.R_O.split(" as (", 1)[1] + ")", V.P_O, V.LEVELS_O) + """
select cast(date as varchar) as date, park_id, crowd_level from levels""")
def crowd_level_missing(spark, sf_dir):
    """E1 with park-days whose every wait is missing (all of March): they have no level and take
    no rank."""
    r = scan_readings(spark, landed.orders_readings(spark, sf_dir))
    r = r.withColumn("queue_time", F.when(F.month("date") != 3, F.col("queue_time")))
    return as_report(labels.crowd_levels(r, landed.customer_park_info(spark, sf_dir)))


@register("crowd_level_report", V.with_ctes(V.R_O, V.P_O, V.LEVELS_O) + """
select count(*) as n_rows, list_sort(list(distinct park_id)) as parks from levels""")
def crowd_level_report(spark, sf_dir):
    """Row count and park list of the label frame."""
    return labels.level_report(_orders_levels(spark, sf_dir))


# Query groups register themselves on import.
from . import queries_features  # noqa: E402,F401
from . import queries_ingest  # noqa: E402,F401
from . import queries_model  # noqa: E402,F401
from . import queries_report  # noqa: E402,F401
