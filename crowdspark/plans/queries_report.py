"""Registered queries: forecast summary, labels, display table, CSV export.

The prediction frame is the orders world's month baseline: each park-day's level is the
park's mean level of that month, with its population spread as the band (the shape the
forest interval produces).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clip, round_half_even_int, round_to
from ..operators import report
from ..session import scratch_path
from ..sources import sinks
from . import oracle_views as V
from .output import as_report
from .queries_features import orders_levels
from .registry import register

_PREDS = V.with_ctes(V.R_O, V.P_O, V.LEVELS_O, """pm as (
  select *, avg(crowd_level) over (partition by park_id, month(date)) as m,
         stddev_pop(crowd_level) over (partition by park_id, month(date)) as s
  from levels),
preds as (
  select date, park_id, cast(round_even(m, 0) as integer) as crowd_level,
         cast(round_even(greatest(0, least(100, m - s)), 0) as integer) as ci_lower,
         cast(round_even(greatest(0, least(100, m + s)), 0) as integer) as ci_upper
  from pm)""")

_LABEL = """case when crowd_level < 25 then 'Quiet' when crowd_level < 50 then 'Moderate'
                 when crowd_level < 75 then 'Busy' else 'Very Busy' end"""


def month_baseline_predictions(spark, sf_dir):
    lv = orders_levels(spark, sf_dir)
    w = Window.partitionBy("park_id", F.month("date"))
    m, s = F.avg("crowd_level").over(w), F.stddev_pop("crowd_level").over(w)
    return lv.select("date", "park_id", round_half_even_int(m).alias("crowd_level"),
                     round_half_even_int(clip(m - s)).alias("ci_lower"),
                     round_half_even_int(clip(m + s)).alias("ci_upper"))


@register("forecast_summary", _PREDS + """,
agg as (select park_id, min(crowd_level) as mn, max(crowd_level) as mx, avg(crowd_level) as av from preds group by 1)
select a.park_id, cast(trunc(a.av) as integer) as mean_level, a.mx as peak_level,
       a.mx - cast(trunc(a.av) as integer) as peak_minus_mean,
       strftime((select min(date) from preds p where p.park_id = a.park_id and p.crowd_level = a.mn), '%a %d %b') as quietest_day,
       strftime((select min(date) from preds p where p.park_id = a.park_id and p.crowd_level = a.mx), '%a %d %b') as busiest_day
from agg a""")
def forecast_summary(spark, sf_dir):
    """Truncated mean, peak, peak - mean, first quietest / busiest day per park."""
    return report.forecast_summary(month_baseline_predictions(spark, sf_dir))


@register("crowd_labels", V.with_ctes(V.R_O, V.P_O, V.LEVELS_O) + f"""
select cast(date as varchar) as date, park_id, crowd_level, {_LABEL} as busy_label from levels""")
def crowd_labels(spark, sf_dir):
    """Quiet / Moderate / Busy / Very Busy by the 25-50-75 bands."""
    return as_report(report.with_labels(orders_levels(spark, sf_dir)))


_DISPLAY = f"""
select park_id, strftime(date, '%Y-%m-%d') as "Date", strftime(date, '%A') as "Day", crowd_level as "Crowd Level",
       ci_lower as "CI Lower (−1σ)", ci_upper as "CI Upper (+1σ)", {_LABEL} as "Category"
from preds"""


@register("output_order", _PREDS + """
select park_id, cast(date as varchar) as date, crowd_level, cast(row_number() over (order by date, park_id) as bigint) as place
from preds""")
def output_order(spark, sf_dir):
    """predictions in the order they are shown (day, then park), with each row's place: a
    distributed sort and places by partition counts, no single sorting task."""
    return as_report(report.in_order(month_baseline_predictions(spark, sf_dir)).select("park_id", "date", "crowd_level", "place"))


@register("band_rows", _PREDS + """,
bands as (select * from (values (0, 25, 'Quiet'), (25, 50, 'Moderate'), (50, 75, 'Busy')) as t(y0, y1, label)),
n as (select park_id, count(*) as n from preds group by 1)
select p.park_id, y0, y1, label, count(*) as days, cast(min(date) as varchar) as first_day, cast(max(date) as varchar) as last_day,
       floor(count(*) / any_value(n.n) * 1e6 + 0.5) / 1e6 as share
from preds p join bands on crowd_level >= y0 and crowd_level < y1 join n on n.park_id = p.park_id group by 1, 2, 3, 4""")
def band_rows(spark, sf_dir):
    """The chart's threshold bands with the predicted days that lie in each, per park."""
    rows = report.band_rows(month_baseline_predictions(spark, sf_dir))
    return as_report(rows.withColumn("share", round_to("share")))


@register("display_table", _PREDS + _DISPLAY)
def display_table(spark, sf_dir):
    """Display projection with formatted day, weekday name, band and label."""
    return report.display_table(month_baseline_predictions(spark, sf_dir))


@register("csv_export", _PREDS + """, disp as (""" + _DISPLAY + """)
select cast(park_id as varchar) as park_id, "Date", "Day", cast("Crowd Level" as varchar) as "Crowd Level",
       cast("CI Lower (−1σ)" as varchar) as "CI Lower (−1σ)", cast("CI Upper (+1σ)" as varchar) as "CI Upper (+1σ)",
       "Category" from disp""")
def csv_export(spark, sf_dir):
    """K5: the display table written as CSV with a header, read back as text."""
    path = scratch_path(spark, "display_csv")
    sinks.export_csv(report.display_table(month_baseline_predictions(spark, sf_dir)), path)
    return spark.read.option("header", True).csv(path)
