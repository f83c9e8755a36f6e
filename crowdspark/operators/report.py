"""Presentation of predictions: summary, labels, display table, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import CROWD_BANDS, crowd_label
from ..session import materialise

# Fixed values of the expected output: the display column names.
DISPLAY_NAMES = ["Date", "Day", "Crowd Level", "CI Lower (−1σ)", "CI Upper (+1σ)", "Category"]


def forecast_summary(preds: DataFrame, by=("park_id",)) -> DataFrame:
    """Per group: truncated mean, peak, peak minus mean, first day of the minimum and of the
    maximum (ties -> earliest day), days formatted 'EEE dd MMM'."""
    lvl, d = F.col("crowd_level"), F.col("date")
    g = preds.groupBy(*by).agg(
        F.avg(lvl).cast("int").alias("mean_level"), F.max(lvl).alias("peak_level"),
        F.min_by(d, F.struct(lvl, d)).alias("quietest"),
        F.min_by(d, F.struct(-lvl, d)).alias("busiest"))
    return g.select(*by, "mean_level", "peak_level", (F.col("peak_level") - F.col("mean_level")).alias("peak_minus_mean"),
                    F.date_format("quietest", "EEE dd MMM").alias("quietest_day"),
                    F.date_format("busiest", "EEE dd MMM").alias("busiest_day"))


def empty_result_warning(preds: DataFrame) -> str | None:
    """A warning text when a prediction run produced no rows (e.g. every day lacked opening
    hours), else None; reads at most one row."""
    return "No predictions: every requested day was dropped (missing features)." if preds.isEmpty() else None


def in_order(preds: DataFrame, by=("date", "park_id")) -> DataFrame:
    """``preds`` sorted by ``by`` with each row's 1-based ``place``: range partitions are stored,
    numbered inside, and offset by the row counts of the partitions before them."""
    dealt = materialise(preds.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()),
                        "in-order")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return (dealt.withColumn("_row", inside).join(parts, "_part")
            .withColumn("place", (F.col("_before") + F.col("_row")).cast("bigint")).drop("_part", "_before", "_row")
            .orderBy("place"))


def with_labels(preds: DataFrame) -> DataFrame:
    return preds.withColumn("busy_label", crowd_label("crowd_level"))


def display_table(preds: DataFrame) -> DataFrame:
    """Date text, weekday name, level, band, label - under the display column names."""
    cols = [F.date_format("date", "yyyy-MM-dd"), F.date_format("date", "EEEE"), F.col("crowd_level"),
            F.col("ci_lower"), F.col("ci_upper"), crowd_label("crowd_level")]
    extra = [c for c in preds.columns if c == "park_id"]
    return preds.select(*extra, *[c.alias(n) for c, n in zip(cols, DISPLAY_NAMES)])


def band_rows(preds: DataFrame, by=("park_id",)) -> DataFrame:
    """The chart's threshold bands (y0, y1, label) with what lies in each, per group: days, first and
    last day, and the share of the group's days.  A level of y1 lies in the band above; what lies
    above the last band, and days without a level, are in none."""
    bands = [(max(0, top - 25), top, label) for top, label in CROWD_BANDS if top <= 75]
    level = F.col("crowd_level")
    band = F.coalesce(*[F.when((level >= low) & (level < top), F.struct(F.lit(low).alias("y0"), F.lit(top).alias("y1"),
                                                                       F.lit(label).alias("label"))) for low, top, label in bands])
    of_group = preds.groupBy(*by).agg(F.count("*").alias("_n"))
    held = preds.withColumn("_band", band).where(F.col("_band").isNotNull()).groupBy(*by, "_band").agg(
        F.count("*").alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    return held.join(of_group, list(by)).select(*by, "_band.*", "days", "first_day", "last_day",
                                                (F.col("days") / F.col("_n")).alias("share"))
