"""Registered queries: payload flattening, 15-minute alignment, work lists, table writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions import parse_reading_time, unparsed_times
from ..operators import align, labels, worklist
from ..session import materialise, scratch_path
from ..sources import catalog, holidays, landed, payload, sinks
from ..sources.readings import scan_readings
from ..streaming import ingest
from . import oracle_views as V
from .output import as_report
from .registry import register

# Collection parameters of the orders world (the configured range and closed months).
CONFIG_START, CONFIG_END, EXCLUDE_MONTHS = "1995/01/01", "2001/12/31", (12, 1, 2)

_PANEL_ROWS = """pts as (
  select cast(user_id % 3 + 1 as varchar) as park_id, cast(ts as date) as date, cast(user_id as varchar) as ride_id,
         'Ride ' || cast(user_id as varchar) as ride_name, event_id,
         strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') as ts,
         strftime(ts, '%Y-%m-%d %H:%M:%S') as time_of_day,
         coalesce(case when event_type = 'error' then 0 when value >= 1 then cast(floor(value) as integer) end, 0) as queue_time,
         case when event_type = 'error' then 1 else 0 end as is_closed
  from events where user_id % 17 <> 0)"""

_ALIGN = """c as (
  select *, epoch_us(ts) as us, epoch_us(ts) - epoch_us(ts) % 900000000 as f from src),
cand as (
  select *, f as slot_us from c union all select *, f + 900000000 as slot_us from c),
ok as (select *, abs(us - slot_us) as diff from cand where abs(us - slot_us) <= 450000000),
ranked as (
  select *, row_number() over (partition by date, ride_id, slot_us order by diff, us, id) as rn from ok),
aligned as (
  select date, ride_id, make_timestamp(slot_us) as slot, queue_time, is_closed from ranked where rn = 1)"""

_ALIGNED_OUT = """
select cast(date as varchar) as date, ride_id, strftime(slot, '%Y-%m-%d %H:%M:%S') as slot,
       strftime(slot, '%H:%M') as time_of_day, queue_time, is_closed from aligned"""


@register("panel_flatten", V.with_ctes(_PANEL_ROWS) + """
select park_id, cast(date as varchar) as date, ride_id, ride_name, time_of_day, queue_time, is_closed from pts""")
def panel_flatten(spark, sf_dir):
    """Chart panels -> readings (invalid panels skipped, missing -> open 0)."""
    f = payload.flatten_payloads(landed.chart_payloads(spark, sf_dir))
    return as_report(f.select("park_id", "date", "ride_id", "ride_name", "time_of_day", "queue_time", "is_closed"))


@register("panel_flatten_known", V.with_ctes(_PANEL_ROWS) + """
select p.park_id, cast(p.date as varchar) as date, p.ride_id, p.time_of_day, p.queue_time, p.is_closed
from pts p join events e using (event_id) where e.event_type = 'error' or e.value >= 1""")
def panel_flatten_known(spark, sf_dir):
    """The same without the points the park did not report."""
    f = payload.flatten_payloads(landed.chart_payloads(spark, sf_dir), drop_missing=True)
    return as_report(f.select("park_id", "date", "ride_id", "time_of_day", "queue_time", "is_closed"))


@register("stored_gaps", V.with_ctes(V.R_O, V.P_O, """have as (
  select distinct p.park_id, r.date from r_o r join p_o p on r.ride_id = p.ride_id),
span as (select park_id, min(date) as lo, max(date) as hi from have group by 1),
days as (select park_id, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from span)""") + """
select park_id, cast(date as varchar) as date from days d anti join have h using (park_id, date)
where month(date) not in (12, 1, 2)""")
def stored_gaps(spark, sf_dir):
    """Days inside a park's stored range without readings."""
    r = scan_readings(spark, landed.orders_readings(spark, sf_dir))
    return as_report(worklist.stored_gaps(r, landed.customer_park_info(spark, sf_dir), EXCLUDE_MONTHS))


# Text forms of a reading time by event_id % 10: (Spark expression, whether seconds are kept).
_TIME_FORMS = [("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", True), ("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")", True),
               ("date_format(ts, 'yyyy-MM-dd HH:mm:ss') || '+01:00'", True), ("date_format(ts, \"yyyy-MM-dd'T'HH:mm\")", False),
               ("date_format(ts, 'MMM dd yyyy HH:mm:ss')", True), ("date_format(ts, 'MM/dd/yyyy HH:mm')", False),
               ("date_format(ts, 'EEE MMM dd yyyy HH:mm:ss') || ' GMT+0000 (UTC)'", True), ("date_format(ts, 'yyyy/M/d H:mm:ss')", True),
               ("date_format(ts, 'h:mm a')", None), ("date_format(ts, 'd MMM yyyy HH:mm:ss')", True)]
_TIME_SQL = "case event_id % 10 " + " ".join(
    f"when {i} then " + ("null" if keep is None else f"strftime(ts, '%Y-%m-%d %H:%M:{'%S' if keep else '00'}')")
    for i, (_, keep) in enumerate(_TIME_FORMS)) + " end"


def _time_texts(spark, sf_dir):
    e = landed.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    form = " ".join(f"when {i} then {sql}" for i, (sql, _) in enumerate(_TIME_FORMS))
    return e.select("event_id", F.expr(f"case event_id % 10 {form} end").alias("time"))


@register("reading_times", f"select event_id, {_TIME_SQL} as reading_time from events")
def reading_times(spark, sf_dir):
    """Reading times in ten text forms; the wall-clock is kept, a twelve-hour clock is no time."""
    return as_report(_time_texts(spark, sf_dir).select("event_id", parse_reading_time("time").alias("reading_time")))


@register("reading_times_unparsed", "select count(*) as texts, count(*) filter (where event_id % 10 = 8) as unparsed from events")
def reading_times_unparsed(spark, sf_dir):
    """How many reading times are dropped."""
    return unparsed_times(_time_texts(spark, sf_dir))


@register("align_15min", V.with_ctes(V.R_E, "src as (select id, date, ride_id, ts, queue_time, is_closed from r_e)",
                                     _ALIGN) + _ALIGNED_OUT)
def align_15min(spark, sf_dir):
    """Nearest reading per 15-minute slot within 7.5 minutes."""
    return as_report(align.align_to_slots(landed.events_readings(spark, sf_dir)))


@register("payload_aligned", V.with_ctes(
    _PANEL_ROWS, "src as (select event_id as id, date, ride_id, ts, queue_time, is_closed from pts)", _ALIGN)
    + _ALIGNED_OUT)
def payload_aligned(spark, sf_dir):
    """B14 + C10: flattened panel readings (text times parsed, bad ones skipped) aligned."""
    f = payload.flatten_payloads(landed.chart_payloads(spark, sf_dir)).where(F.col("ts").isNotNull())
    # arrival order inside a page: panel position, then point position
    f = f.withColumn("id", F.col("panel_pos") * F.lit(1 << 32) + F.col("pos"))
    return as_report(align.align_to_slots(f))


_PARKS = "parks as (select distinct park_id from p_o)"
_WORK = """
select park_id, strftime(d, '%Y/%m/%d') as date, 'parks/' || park_id || '/calendar/' || strftime(d, '%Y/%m/%d') as url
from days where month(d) not in (12, 1, 2)"""


@register("date_work_list", V.with_ctes(V.P_O, _PARKS, """days as (
  select park_id, cast(unnest(generate_series(date '1995-01-01', date '2001-12-31', interval 1 day)) as date) as d
  from parks)""") + _WORK)
def date_work_list(spark, sf_dir):
    """Every park x every configured day outside the closed months."""
    parks = landed.customer_park_info(spark, sf_dir)
    return worklist.work_list(parks, CONFIG_START, CONFIG_END, EXCLUDE_MONTHS)


@register("range_guards", V.with_ctes(V.SCHOOL_DAYS) + """
select country, case when s is null then 'the start is no day' when e is null then 'the end is no day'
                     when e < s then 'the range ends before it begins' end as problem, count(*) as ranges
from parsed group by 1, 2""")
def range_guards(spark, sf_dir):
    """Ranges that come as rows (each country's periods), checked one by one: what is wrong with
    how many."""
    p = landed.school_periods(spark, sf_dir).select("country", F.translate("start_date", "-", "/").alias("s"),
                                                    F.translate("end_date", "-", "/").alias("e"))
    return (p.groupBy("country", worklist.range_problem(F.col("s"), F.col("e")).alias("problem"))
            .agg(F.count("*").alias("ranges")))


@register("pending_dates", V.with_ctes(V.R_O, V.P_O, _PARKS, """last as (
  select p.park_id, max(r.date) as last_day from r_o r join p_o p on r.ride_id = p.ride_id group by 1),
starts as (
  select p.park_id, greatest(date '1995-01-01', coalesce(l.last_day + 1, date '1995-01-01')) as s
  from parks p left join last l using (park_id)),
days as (
  select park_id, cast(unnest(generate_series(s, date '2001-12-31', interval 1 day)) as date) as d
  from starts where s <= date '2001-12-31')""") + _WORK)
def pending_dates(spark, sf_dir):
    """Resume each park the day after its last stored day."""
    pi = landed.customer_park_info(spark, sf_dir)
    last = worklist.last_stored_day(scan_readings(spark, landed.orders_readings(spark, sf_dir)), pi)
    return worklist.work_list(pi, CONFIG_START, CONFIG_END, EXCLUDE_MONTHS, last_days=last)


@register("append_readings", V.with_ctes(V.R_E, "src as (select id, date, ride_id, ts, queue_time, is_closed from r_e)",
                                         _ALIGN) + _ALIGNED_OUT)
def append_readings(spark, sf_dir):
    """K1 K3 G1: tables created, aligned readings ingested twice (the second run resumes after
    the last stored day and adds nothing), then the last day re-stored idempotently (dynamic
    partition overwrite); the read-back is returned."""
    readings_path = scratch_path(spark, "queue_data")
    sinks.create_tables(spark, readings_path, scratch_path(spark, "park_info"))
    aligned = materialise(align.align_to_slots(landed.events_readings(spark, sf_dir)), "aligned")
    rides = landed.events_park_info(spark, sf_dir)
    for _ in range(2):
        sinks.ingest_readings(aligned, rides, readings_path)
    stored = sinks.read_readings(spark, readings_path)
    last = stored.agg(F.max("date").alias("date"))
    sinks.overwrite_reading_days(materialise(stored.join(last, "date").select(*stored.columns), "last-day"), readings_path)
    back = sinks.read_readings(spark, readings_path)
    return as_report(back.select("date", "ride_id", "slot", "time_of_day", "queue_time", "is_closed"))


@register("last_day_stored", V.with_ctes(V.R_E, V.P_E, "src as (select id, date, ride_id, ts, queue_time, is_closed from r_e)",
                                         _ALIGN) + """
select p.park_id, cast(max(a.date) as varchar) as last_day from aligned a join p_e p using (ride_id)
where p.park_id <> '2' or a.date <= date '2024-01-20' group by 1""")
def last_day_stored(spark, sf_dir):
    """The last stored day per park from the folders of the stored readings: no column of a
    file is read (park 2 is stored up to January 20 only)."""
    path = scratch_path(spark, "queue_data")
    rides = landed.events_park_info(spark, sf_dir)
    raw = landed.events_readings(spark, sf_dir)
    raw = raw.where((F.pmod(F.col("ride_id").cast("bigint"), F.lit(3)) != 1) | (F.col("date") <= F.to_date(F.lit("2024-01-20"))))
    sinks.create_tables(spark, path, scratch_path(spark, "park_info"))
    sinks.ingest_readings(align.align_to_slots(raw), rides, path)
    return as_report(worklist.last_stored_day(sinks.read_readings(spark, path)))


@register("readings_of_days", V.with_ctes(V.R_E, "src as (select id, date, ride_id, ts, queue_time, is_closed from r_e)",
                                          _ALIGN, """asked as (
  select cast(max(ts) as date) - cast(i * 3 as integer) as date from events, range(5) r(i) group by i)""") + """
select cast(a.date as varchar) as date, a.ride_id, a.time_of_day, a.queue_time from (
  select *, strftime(slot, '%H:%M') as time_of_day from aligned) a semi join asked using (date)""")
def readings_of_days(spark, sf_dir):
    """Stored readings of five requested days; only those days' folders are read (dynamic
    partition pruning by the request)."""
    path = scratch_path(spark, "queue_data")
    raw = landed.events_readings(spark, sf_dir)
    sinks.create_tables(spark, path, scratch_path(spark, "park_info"))
    sinks.ingest_readings(align.align_to_slots(raw), landed.events_park_info(spark, sf_dir), path)
    last = raw.agg(F.max("date").alias("hi"))
    asked = last.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.date_sub("hi", i * 3))).alias("date"))
    got = sinks.readings_of_days(sinks.read_readings(spark, path), asked)
    return as_report(got.select("date", "ride_id", "time_of_day", "queue_time"))


@register("catalog_ride_lookup", V.with_ctes(V.R_E, V.P_E, "src as (select id, date, ride_id, ts, queue_time, is_closed from r_e)",
                                             _ALIGN) + """
select cast(a.date as varchar) as date, a.ride_id, strftime(a.slot, '%H:%M') as time_of_day, a.queue_time, p.park_id
from aligned a join p_e p using (ride_id)""")
def catalog_ride_lookup(spark, sf_dir):
    """Readings and rides stored as tables of the session's catalog, created where they
    do not exist, bucketed by ride; the rides are inserted twice (the second time adds none).  The
    lookup reads both by name and moves no readings."""
    own = uuid.uuid4().hex[:12]
    readings, rides = f"queue_data_{own}", f"park_info_{own}"
    location = scratch_path(spark, "catalog")
    for _ in range(2):
        catalog.create_tables(spark, location, 8, readings, rides)
    catalog.insert(align.align_to_slots(landed.events_readings(spark, sf_dir)), readings)
    arrived = landed.events_park_info(spark, sf_dir).withColumn("date", F.lit(None).cast("date")).withColumn("pos", F.lit(0))
    for _ in range(2):
        catalog.insert_new_rides(arrived, rides)
    got = labels.attach_park(scan_readings(spark, readings, columns=["date", "ride_id", "time_of_day", "queue_time"]),
                             spark.table(rides))
    return as_report(got.withColumn("park_id", F.col("park_id").cast("string")))


_LATE = 50                      # every so manieth reading of the first half arrives after it

_STREAM = V.with_ctes(V.R_E, f"""bounds as (
  select epoch_us(min(ts)) as lo, epoch_us(max(ts)) as hi from r_e),
landing as (
  select r.*, not (epoch_us(ts) * 2 < lo + hi and id % {_LATE} <> 7) as second from r_e r, bounds),
src as (select * from landing)""", """c as (
  select *, epoch_us(ts) as us, epoch_us(ts) - epoch_us(ts) % 900000000 as f from src),
cand as (
  select *, f as slot_us from c union all select *, f + 900000000 as slot_us from c),
ok as (select *, abs(us - slot_us) as diff from cand where abs(us - slot_us) <= 450000000),
marks as (
  select max(slot_us) filter (where not second) - 1800000000 as first_mark, max(slot_us) - 1800000000 as last_mark from ok),
ranked as (
  select ok.*, row_number() over (partition by date, ride_id, slot_us order by diff, us, id) as rn
  from ok, marks where not second or slot_us > first_mark or first_mark is null)""")


@register("stream_ingest", _STREAM + """
select cast(date as varchar) as date, ride_id, strftime(make_timestamp(slot_us), '%Y-%m-%d %H:%M:%S') as slot,
       strftime(make_timestamp(slot_us), '%H:%M') as time_of_day, queue_time, is_closed
from ranked, marks where rn = 1 and slot_us <= last_mark""")
def stream_ingest(spark, sf_dir):
    """K1 H6 C10 as a stream: readings land in two parts, the second with some that come late; the
    query takes what is there, stops, and is started again from its checkpoint for the second part
    and once more for nothing.  The table holds the aligned rows that the watermark (30 minutes)
    allows: no open slots at the end, and no late reading of a slot already written."""
    raw = landed.events_readings(spark, sf_dir).select(*ingest.RAW_READING.fieldNames())
    us = F.unix_micros("ts")
    ends = raw.agg((F.min(us) + F.max(us)).alias("ends")).scalar()
    parts = materialise(raw.withColumn("second", ~((us * 2 < ends) & (F.col("id") % _LATE != 7))), "landing")
    source, out, ckpt = (scratch_path(spark, f"stream-{n}") for n in ("source", "table", "checkpoint"))
    for part in ("not second", "second", None):
        if part is not None:
            parts.where(part).select(*raw.columns).write.mode("append").parquet(source)
        ingest.start_ingest(spark, source, out, ckpt).awaitTermination()
    return as_report(ingest.read_table(spark, out))


@register("observed_counters", V.with_ctes(_PANEL_ROWS, V.SCHOOL_DAYS, V.R_O, V.P_O, V.LEVELS_O) + """
select 'reading times' as rows_of, 'texts' as counter, count(*) as n from pts
union all select 'reading times', 'unparsed', 0
union all select 'reading times', 'unreported', count(*) from events
  where user_id % 17 <> 0 and event_type <> 'error' and not value >= 1
union all select 'school periods', 'periods', count(*) from periods
union all select 'school periods', 'unreadable', count(*) from parsed where s is null or e is null
union all select 'school periods', 'inverted', count(*) from parsed where e < s
union all select 'crowd levels', 'n_rows', count(*) from levels
union all select 'crowd levels', 'without_level', count(*) from levels where crowd_level is null""")
def observed_counters(spark, sf_dir):
    """B14 B17 D13 (and D12 in median_missing_counters): what a step drops or cannot read, observed
    by the job that writes its result; nothing is read again for it."""
    times, periods, levels = Observation(), Observation(), Observation()
    materialise(payload.flatten_payloads(landed.chart_payloads(spark, sf_dir), observed=times), "points")
    found = landed.school_periods(spark, sf_dir).observe(periods, *holidays.period_metrics())
    materialise(holidays.school_holiday_days(found), "school-days")
    made = labels.crowd_levels(scan_readings(spark, landed.orders_readings(spark, sf_dir)),
                               landed.customer_park_info(spark, sf_dir))
    materialise(made.observe(levels, *labels.level_metrics()), "levels")
    rows = [(what, name, int(n)) for what, seen in (("reading times", times), ("school periods", periods), ("crowd levels", levels))
            for name, n in seen.get.items() if name != "parks"]
    return spark.createDataFrame(rows, "rows_of string, counter string, n bigint")


@register("park_info_upsert", V.with_ctes(_PANEL_ROWS, """named as (
  select ride_id, park_id, ride_name || ' @' || strftime(date, '%Y-%m-%d') as ride_name, date from pts),
firsts as (
  select ride_id, park_id, arg_min(ride_name, date) as ride_name from named group by 1, 2)""") + """
select ride_id, park_id, ride_name from firsts""")
def park_info_upsert(spark, sf_dir):
    """K2: ride dimension kept by insert-or-ignore - the first page naming a ride wins.
    The first half of the pages is stored first, the rest is upserted against it."""
    pages = payload.flatten_payloads(landed.chart_payloads(spark, sf_dir))
    rows = pages.select("ride_id", "park_id", F.concat("ride_name", F.lit(" @"), F.date_format("date", "yyyy-MM-dd")).alias("ride_name"),
                        "date", F.col("panel_pos").alias("pos"))
    b = rows.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    mid = b["lo"] + (b["hi"] - b["lo"]) / 2
    path = scratch_path(spark, "park_info")
    first = sinks.first_per_key(rows.where(F.col("date") <= F.lit(mid)))
    first.write.mode("append").parquet(path)
    existing = spark.read.parquet(path)
    sinks.insert_or_ignore(existing, rows.where(F.col("date") > F.lit(mid))).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("ride_id", "park_id", "ride_name")


@register("slot_grid", V.with_ctes(V.R_E, "src as (select id, date, ride_id, ts, queue_time, is_closed from r_e)", _ALIGN,
                                   """bounds as (
  select date, ride_id, epoch_us(min(ts)) - epoch_us(min(ts)) % 900000000 as lo,
         epoch_us(date_trunc('minute', max(ts))) as hi_min from r_e group by 1, 2),
grid as (
  select date, ride_id, lo,
         case when hi_min % 900000000 = 0 then hi_min else hi_min - hi_min % 900000000 + 900000000 end as hi
  from bounds),
filled as (select date, ride_id, count(*) as n_filled from aligned group by 1, 2)""") + """
select cast(g.date as varchar) as date, g.ride_id,
       strftime(make_timestamp(g.lo), '%Y-%m-%d %H:%M:%S') as first_slot,
       strftime(make_timestamp(g.hi), '%Y-%m-%d %H:%M:%S') as last_slot,
       cast((g.hi - g.lo) // 900000000 + 1 as integer) as n_slots, f.n_filled
from grid g join filled f on f.date = g.date and f.ride_id = g.ride_id""")
def slot_grid(spark, sf_dir):
    """Per ride-day grid floor(first) .. minute-based ceil(last), and how many of its
    slots the alignment filled."""
    r = landed.events_readings(spark, sf_dir)
    b = r.groupBy("date", "ride_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    g = b.select("date", "ride_id", align.slot_grid("first", "last").alias("grid"))
    filled = align.align_to_slots(r).groupBy("date", "ride_id").agg(F.count("*").alias("n_filled"))
    out = g.select("date", "ride_id", F.element_at("grid", 1).alias("first_slot"), F.element_at("grid", -1).alias("last_slot"),
                   F.size("grid").alias("n_slots")).join(filled, ["date", "ride_id"])
    return as_report(out)


@register("last_stored_day", V.with_ctes(V.R_O, V.P_O) + """
select p.park_id, replace(max(r.date_text), '-', '/') as last_day
from r_o r join p_o p on r.ride_id = p.ride_id group by 1""")
def last_stored_day(spark, sf_dir):
    """Latest stored day per park through the ride dimension, as 'YYYY/MM/DD'."""
    r = scan_readings(spark, landed.orders_readings(spark, sf_dir))
    last = worklist.last_stored_day(r, landed.customer_park_info(spark, sf_dir))
    return last.select("park_id", F.translate(F.date_format("last_day", "yyyy-MM-dd"), "-", "/").alias("last_day"))
