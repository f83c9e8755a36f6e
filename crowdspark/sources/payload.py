"""Captured chart payloads -> flat readings (what the page extractor returns per ride)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import closed_flag, falsy_zero, last_path_part, parse_day, parse_reading_time, time_metrics, wall_clock_text
from ..functions.strings import PARK_DATASET_LABEL, UNKNOWN_RIDE_NAME


def valid_panels(payloads: DataFrame) -> DataFrame:
    """Panels with a link, a ride id at the end of it, labels and a park-reported dataset."""
    p = payloads.select("park_id", parse_day("date").alias("date"), F.posexplode("panels").alias("panel_pos", "panel"))
    park_ds = F.try_element_at(F.filter("panel.datasets", lambda d: d["label"] == PARK_DATASET_LABEL), F.lit(1))
    p = p.select("park_id", "date", "panel_pos",
                 last_path_part(F.col("panel.href")).alias("ride_id"),
                 F.coalesce(F.trim(F.col("panel.ride_name")), F.lit(UNKNOWN_RIDE_NAME)).alias("ride_name"),
                 F.col("panel.labels").alias("labels"), park_ds.alias("park_ds"))
    return p.where(F.col("ride_id").isNotNull() & (F.col("ride_id") != "") & F.col("labels").isNotNull()
                   & F.col("park_ds").isNotNull())


def flatten_payloads(payloads: DataFrame, drop_missing: bool = False, observed: Observation | None = None) -> DataFrame:
    """One row per data point: park_id, date, ride_id, ride_name, pos, ts, time_of_day text,
    queue_time (missing -> 0, or no row with ``drop_missing``), is_closed (1 only for an exact 0).

    ``observed`` gets the number of time texts and of those that are no time (B14), and of points
    the park did not report, from the job that reads the result."""
    p = valid_panels(payloads)
    pts = p.select("park_id", "date", "panel_pos", "ride_id", "ride_name", "park_ds",
                   F.posexplode("labels").alias("pos", "label"))
    v = F.try_element_at(F.col("park_ds.data"), F.col("pos") + 1)
    if observed is not None:
        pts = pts.observe(observed, *time_metrics("label"), F.count_if(v.isNull()).alias("unreported"))
    ts = parse_reading_time("label")
    if drop_missing:
        pts = pts.where(v.isNotNull())
    return pts.select("park_id", "date", "ride_id", "ride_name", "panel_pos", "pos", ts.alias("ts"),
                      wall_clock_text(ts).alias("time_of_day"),
                      falsy_zero(v).alias("queue_time"), closed_flag(v).alias("is_closed"))
