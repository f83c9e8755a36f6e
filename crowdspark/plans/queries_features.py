"""Registered queries: directories, calendar, holidays, opening hours, weather, imputation,
encoding."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions import round_to
from ..operators import calendar, encode, impute, labels, opening, weather
from ..session import materialise
from ..sources import directories, documents, holidays, landed, schedule
from ..sources.readings import scan_readings
from . import oracle_views as V
from .output import as_report
from .registry import register

AS_OF_ORDERS = "2001-06-01"        # forecast day of the orders world (FIXTURES F_o)
FORECAST_REQUEST_DAYS = 30
OPENING_EXTRA_DAYS = 21            # requested days beyond the last reading (events world)


def orders_levels(spark, sf_dir):
    return labels.crowd_levels(scan_readings(spark, landed.orders_readings(spark, sf_dir)),
                               landed.customer_park_info(spark, sf_dir))


def events_levels(spark, sf_dir):
    return labels.crowd_levels(landed.events_readings(spark, sf_dir), landed.events_park_info(spark, sf_dir))


def park_dim(spark, sf_dir):
    return directories.park_dimension(landed.park_directory(spark, sf_dir), landed.destination_directory(spark, sf_dir))


def countries(spark, sf_dir):
    return calendar.park_countries(directories.parks_from_directory(landed.park_directory(spark, sf_dir)),
                                   landed.country_aliases(spark, sf_dir))


# ------------------------------------------------------------------ directories, calendar, holidays

@register("park_directory", """
select cast(n_nationkey as varchar) as park_id, n_name as name, r_name as country,
       cast(n_nationkey * 2.5 - 30 as double) as latitude, cast(n_nationkey * 5.0 - 60 as double) as longitude,
       n_name || ' (ID ' || cast(n_nationkey as varchar) || ')' as label,
       'dest-' || cast(n_nationkey as varchar) as external_id
from nation join region on n_regionkey = r_regionkey""")
def park_directory(spark, sf_dir):
    """Nested directories -> park dimension with label and external id."""
    return park_dim(spark, sf_dir)


_DOW = ", ".join(f"coalesce(isodow(d) - 1 = {i - 1}, false) as day_of_week_{i}" for i in range(1, 8))
_MON = ", ".join(f"coalesce(month(d) = {i}, false) as month_{i}" for i in range(1, 13))


@register("calendar_one_hot", f"""
with days as (select distinct cast(o_orderdate as date) as d from orders)
select cast(d as varchar) as date, {_DOW}, {_MON} from days""")
def calendar_one_hot(spark, sf_dir):
    """Weekday (Monday = 1) and month one-hots of every order day."""
    days = landed.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return as_report(calendar.add_date_features(days))


@register("bank_holiday_flag", V.with_ctes(V.R_O, V.P_O, V.LEVELS_O, V.COUNTRY, V.PUBLIC_HOLIDAYS) + """
select cast(l.date as varchar) as date, l.park_id, l.crowd_level,
       coalesce(h.country_code is not null, false) as is_bank_holiday
from levels l left join park_country pc on l.park_id = pc.park_id
left join public_holidays h on h.country_code = pc.alpha2 and h.date = l.date""")
def bank_holiday_flag(spark, sf_dir):
    """Public-holiday flag through park -> country -> code."""
    days = holidays.public_holiday_days(landed.public_holidays(spark, sf_dir))
    return as_report(calendar.add_bank_holidays(orders_levels(spark, sf_dir), countries(spark, sf_dir), days))


@register("unknown_parks", V.with_ctes(V.R_O, V.P_O, V.LEVELS_O, V.COUNTRY) + """
select cast(coalesce(sum(n), 0) as bigint) as rows_without_country, count(*) as parks_without_country
from (select park_id, count(*) as n from levels where cast(park_id as integer) % 5 <> 0 or park_id not in (
        select park_id from park_country where alpha2 is not null) group by 1)""")
def unknown_parks(spark, sf_dir):
    """Park-days whose park the directory does not know are counted (here it lists every
    fifth park only)."""
    known = countries(spark, sf_dir).where(F.col("park_id").cast("int") % 5 == 0)
    return calendar.unknown_parks(orders_levels(spark, sf_dir), known)


@register("school_holiday_days", V.with_ctes(V.SCHOOL_DAYS) + """
select country, cast(date as varchar) as date from school_days""")
def school_holiday_days(spark, sf_dir):
    """Periods (non-padded, inverted, malformed rows) -> distinct days."""
    return as_report(holidays.school_holiday_days(landed.school_periods(spark, sf_dir)))


@register("school_holiday_flag", V.with_ctes(V.R_O, V.P_O, V.LEVELS_O, V.COUNTRY, V.SCHOOL_DAYS) + """
select cast(l.date as varchar) as date, l.park_id, l.crowd_level,
       coalesce(s.country is not null, false) as is_school_holiday
from levels l left join directory d on l.park_id = d.park_id
left join school_days s on s.country = d.country and s.date = l.date""")
def school_holiday_flag(spark, sf_dir):
    """Day within any school period of the park's country (expanded equi join)."""
    days = holidays.school_holiday_days(landed.school_periods(spark, sf_dir))
    return as_report(calendar.add_school_holidays(orders_levels(spark, sf_dir), countries(spark, sf_dir), days))


@register("school_periods_in_order", V.with_ctes(V.SCHOOL_DAYS, """named as (
  select r_name as country, 'break-' || o_orderkey as holiday_name, strftime(cast(o_orderdate as date), '%Y-%-m-%-d') as start_date
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  where o_orderpriority <> '5-LOW')""") + """
select country, holiday_name, cast(cast(strptime(start_date, '%Y-%m-%d') as date) as varchar) as start_date,
       row_number() over (order by strptime(start_date, '%Y-%m-%d'), country, holiday_name) as place
from named""")
def school_periods_in_order(spark, sf_dir):
    """the readable periods in the order of their start day, with their places."""
    got = holidays.periods_in_order(landed.school_periods(spark, sf_dir))
    return as_report(got.select("country", "holiday_name", "start_date", "place"))


@register("merged_school_periods", V.with_ctes(V.SCHOOL_DAYS, """islands as (
  select country, date, date - cast(row_number() over (partition by country order by date) as integer) as island from school_days)""") + """
select country, cast(min(date) as varchar) as start_date, cast(max(date) as varchar) as end_date
from islands group by country, island""")
def merged_school_periods(spark, sf_dir):
    """Overlapping and adjoining periods of a country as one, before they become days."""
    return as_report(holidays.merged_periods(landed.school_periods(spark, sf_dir)))


# Country names as a careless hand would write them, by nation: the right one, marked letters, one
# letter left out, two swapped, in another case with blanks, and a name of no country.
_MISSPELT = ["r_name", "translate(r_name, 'AEIOU', 'ÁÉÍÖÜ')", "substr(r_name, 1, 2) || substr(r_name, 4)",
             "substr(r_name, 1, 1) || substr(r_name, 3, 1) || substr(r_name, 2, 1) || substr(r_name, 4)",
             "'  ' || lower(r_name) || '.'", "'Atlantis ' || r_name"]
_SPELT = "case n_nationkey % 6 " + " ".join(f"when {i} then {t}" for i, t in enumerate(_MISSPELT)) + " end"


@register("country_lookup", f"""
with asked as (
  select cast(n_nationkey as varchar) as park_id, {_SPELT} as country from nation join region on n_regionkey = r_regionkey),
plain as (
  select *, trim(regexp_replace(strip_accents(lower(country)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as p from asked),
known as (select lower(r_name) as k, upper(substr(r_name, 1, 2)) as code from region),
likely as (
  select park_id, code, k, 1 - levenshtein(p, k) / greatest(length(p), length(k)) as likeness,
         len(list_intersect(list_distinct([substr(' ' || p || ' ', i, 2) for i in range(1, length(p) + 2)]),
                            list_distinct([substr(' ' || k || ' ', i, 2) for i in range(1, length(k) + 2)]))) as shared
  from plain, known),
best as (
  select * from likely where likeness >= 0.7
  qualify row_number() over (partition by park_id order by likeness desc, shared desc, k, code) = 1)
select a.park_id, a.country, b.code as country_code from asked a left join best b using (park_id)""")
def country_lookup(spark, sf_dir):
    """Countries found by names that are misspelt, accented or oddly written, against aliases
    that list every country twice, the second time with a later code."""
    n, r = landed.table(spark, sf_dir, "nation"), landed.table(spark, sf_dir, "region")
    parks = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("string").alias("park_id"), F.expr(_SPELT).alias("country"))
    aliases = landed.country_aliases(spark, sf_dir)
    return calendar.park_countries(parks, aliases.unionAll(aliases.withColumn("alpha2", F.lit("ZZ"))))


def _as_json(df):
    """Each row as the JSON text a service would answer with."""
    return df.select(F.to_json(F.struct("*")).alias("body"))


@register("park_directory_json", """
select cast(n_nationkey as varchar) as park_id, n_name as name, r_name as country,
       cast(n_nationkey * 2.5 - 30 as double) as latitude, cast(n_nationkey * 5.0 - 60 as double) as longitude,
       n_name || ' (ID ' || cast(n_nationkey as varchar) || ')' as label,
       'dest-' || cast(n_nationkey as varchar) as external_id
from nation join region on n_regionkey = r_regionkey""")
def park_directory_json(spark, sf_dir):
    """Both directories parsed from JSON text under their fixed schemas."""
    parks = documents.parse_documents(_as_json(landed.park_directory(spark, sf_dir)), "parks")
    destinations = documents.parse_documents(_as_json(landed.destination_directory(spark, sf_dir)), "destinations")
    return directories.park_dimension(parks, destinations)


@register("public_holidays_json", V.with_ctes(V.PUBLIC_HOLIDAYS) + """
select country_code, cast(date as varchar) as date from public_holidays""")
def public_holidays_json(spark, sf_dir):
    """One JSON array of entries (one of them without a date) -> public-holiday days."""
    rows = landed.public_holidays(spark, sf_dir)
    doc = rows.groupBy("country_code").agg(F.to_json(F.collect_list(F.struct("country_code", "date", "name"))).alias("body"))
    return as_report(holidays.public_holiday_days(documents.parse_documents(doc, "public_holidays")))


@register("school_holidays_json", V.with_ctes(V.SCHOOL_DAYS) + """
select country, cast(date as varchar) as date from school_days""")
def school_holidays_json(spark, sf_dir):
    """Period documents, one per holiday and some of them cut off, -> distinct days."""
    text = _as_json(landed.school_periods(spark, sf_dir))
    cut = text.select(F.expr("substring(body, 1, 20)").alias("body"))
    periods = documents.parse_documents(text.unionAll(cut), "school_holidays")
    return as_report(holidays.school_holiday_days(periods))


@register("unreadable_documents", """
select 2 * count(*) as documents, count(*) as unreadable from orders""")
def unreadable_documents(spark, sf_dir):
    """Documents that are no JSON are counted, not lost silently."""
    text = _as_json(landed.school_periods(spark, sf_dir))
    return documents.unreadable(text.unionAll(text.select(F.expr("substring(body, 1, 20)").alias("body"))), "school_holidays")


# ------------------------------------------------------------------ opening hours (events world)

_HIST = """hist as (
  select p.park_id, r.date, min(r.time_of_day) as opening_time, max(r.time_of_day) as closing_time
  from r_e r join p_e p using (ride_id) group by 1, 2)"""

_SCHED = """ev_day as (
  select cast(user_id % 3 + 1 as varchar) as park_id, cast(ts as date) as d,
         date_trunc('hour', min(ts)) as open_ts, date_trunc('hour', max(ts)) + interval 1 hour as close_ts,
         count(*) filter (where event_type = 'error') as n_err, count(*) filter (where event_type = 'view') as n_view
  from events group by 1, 2),
sched as (
  select park_id, d + 14 as date, 0 as k, open_ts + interval 14 day as o, close_ts + interval 14 day as c from ev_day
  union all
  select park_id, d + 14, 1, open_ts + interval 14 day + interval 1 hour, close_ts + interval 14 day + interval 1 hour
  from ev_day where n_err > n_view),
sched_last as (
  select park_id, date, arg_max(strftime(o, '%H:%M'), k) as opening_time, arg_max(strftime(c, '%H:%M'), k) as closing_time
  from sched group by 1, 2)"""

_REQ = f"""req as (
  select p.park_id, cast(unnest(generate_series(b.lo, b.hi, interval 1 day)) as date) as date
  from (select distinct park_id from p_e) p,
       (select min(cast(ts as date)) as lo, max(cast(ts as date)) + {OPENING_EXTRA_DAYS} as hi from events) b)"""


@register("opening_hours_park", V.with_ctes(V.R_E, V.P_E, _HIST) + """
select park_id, cast(date as varchar) as date, opening_time, closing_time from hist""")
def opening_hours_park(spark, sf_dir):
    """D3 F2: first / last reading time per park-day (closed readings included)."""
    h = opening.first_last_times(landed.events_readings_with_time(spark, sf_dir), landed.events_park_info(spark, sf_dir))
    return as_report(h)


@register("opening_hours_all", V.with_ctes(V.R_E) + """
select cast(date as varchar) as date, min(time_of_day) as opening_time, max(time_of_day) as closing_time
from r_e group by date""")
def opening_hours_all(spark, sf_dir):
    """D3 (scope='all'): the same over every park's readings, keyed by day."""
    return as_report(opening.first_last_times(landed.events_readings_with_time(spark, sf_dir), scope="all"))


def requested_days(spark, sf_dir, parks_df, extra_days: int):
    """Every park x every day from the first reading to ``extra_days`` after the last one."""
    b = landed.events_readings(spark, sf_dir).agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    return parks_df.select("park_id").distinct().select(
        "park_id", F.explode(F.sequence(F.lit(b["lo"]), F.date_add(F.lit(b["hi"]), extra_days))).alias("date"))


@register("opening_hours_filled", V.with_ctes(V.R_E, V.P_E, _HIST, _SCHED, _REQ) + """,
sel as (
  select r.park_id, r.date,
         case when h.park_id is not null then h.opening_time else s.opening_time end as ot,
         case when h.park_id is not null then h.closing_time else s.closing_time end as ct
  from req r left join hist h on r.park_id = h.park_id and r.date = h.date
  left join sched_last s on r.park_id = s.park_id and r.date = s.date),
feat as (
  select park_id, date, try_cast(split_part(ot, ':', 1) as integer) as o, try_cast(split_part(ct, ':', 1) as integer) as c
  from sel)
select park_id, cast(date as varchar) as date, o as opening_hr, c as closing_hr, c - o as hours_open_for
from feat where o is not null and c is not null""")
def opening_hours_filled(spark, sf_dir):
    """History else schedule, hour features, drop missing."""
    pi = landed.events_park_info(spark, sf_dir)
    hist = opening.first_last_times(landed.events_readings_with_time(spark, sf_dir), pi)
    sched = schedule.schedule_days(landed.schedule_payloads(spark, sf_dir))
    req = requested_days(spark, sf_dir, pi, OPENING_EXTRA_DAYS)
    return as_report(opening.add_opening_hours(req, hist, sched))


@register("opening_missing_months", V.with_ctes(V.R_E, V.P_E, _HIST, _REQ) + """
select r.park_id, strftime(r.date, '%Y-%m') as year_month, count(*) as n_days,
       cast(min(r.date) as varchar) as first_day, cast(max(r.date) as varchar) as last_day
from req r anti join hist h on r.park_id = h.park_id and r.date = h.date group by 1, 2""")
def opening_missing_months(spark, sf_dir):
    """Requested days without readings, bucketed by year-month per park."""
    pi = landed.events_park_info(spark, sf_dir)
    hist = opening.first_last_times(landed.events_readings_with_time(spark, sf_dir), pi)
    miss = opening.days_without_history(requested_days(spark, sf_dir, pi, OPENING_EXTRA_DAYS), hist)
    return as_report(opening.requested_by_month(miss))


@register("schedule_day_json", V.with_ctes(V.R_E, V.P_E, _SCHED, _REQ, """sched_first as (
  select park_id, date, arg_min(strftime(o, '%H:%M'), k) as opening_time, arg_min(strftime(c, '%H:%M'), k) as closing_time
  from sched group by 1, 2)""") + """
select r.park_id, cast(r.date as varchar) as date, s.opening_time, s.closing_time
from req r left join sched_first s on s.park_id = r.park_id and s.date = r.date""")
def schedule_day_json(spark, sf_dir):
    """The day variant over JSON schedule documents: the day's first entry, else NULLs."""
    docs = documents.parse_documents(_as_json(landed.schedule_payloads(spark, sf_dir)), "schedule")
    req = requested_days(spark, sf_dir, landed.events_park_info(spark, sf_dir), OPENING_EXTRA_DAYS)
    return as_report(schedule.schedule_day(docs, req))


# ------------------------------------------------------------------ weather (orders world)

@register("weather_history", V.with_ctes(V.R_O, V.P_O, V.LEVELS_O, V.W_O) + """
select cast(l.date as varchar) as date, l.park_id, l.crowd_level, w.tavg as temperature_c,
       w.prcp as precipitation_mm, w.wspd as wind_speed_kmh
from levels l left join w_o w on w.park_id = l.park_id and w.date = l.date""")
def weather_history(spark, sf_dir):
    """Observed daily weather joined on (park, day)."""
    return as_report(weather.add_weather_history(orders_levels(spark, sf_dir), landed.orders_weather(spark, sf_dir)))


_CLIM = f"""clim as (
  select park_id, month(date) as month, avg(tavg) as temperature_c, avg(prcp) as precipitation_mm,
         avg(wspd) as wind_speed_kmh
  from w_o where year(date) between year(date '{AS_OF_ORDERS}') - 5 and year(date '{AS_OF_ORDERS}') - 1 group by 1, 2)"""


@register("weather_history_late", V.with_ctes(V.R_O, V.P_O, V.LEVELS_O, V.W_O, f"""late as (
  select park_id, max(date) > date '{AS_OF_ORDERS}' as late from levels group by 1)""") + """
select cast(l.date as varchar) as date, l.park_id, case when not t.late then w.tavg end as temperature_c,
       case when not t.late then w.prcp end as precipitation_mm, case when not t.late then w.wspd end as wind_speed_kmh
from levels l join late t using (park_id) left join w_o w on w.park_id = l.park_id and w.date = l.date""")
def weather_history_late(spark, sf_dir):
    """A park whose requested range ends after the forecast day gets no observations."""
    out = weather.add_weather_history(orders_levels(spark, sf_dir), landed.orders_weather(spark, sf_dir), AS_OF_ORDERS)
    return as_report(out.drop("crowd_level"))


@register("weather_climatology_months", V.with_ctes(V.W_O, _CLIM) + f"""
select park_id, cast(month as integer) as month, {V.r6('temperature_c')} as temperature_c from clim where month in (3, 7)""")
def weather_climatology_months(spark, sf_dir):
    """H5: the monthly means of chosen months only."""
    c = weather.climatology(landed.orders_weather(spark, sf_dir), AS_OF_ORDERS, months=[3, 7])
    return c.select("park_id", "month", round_to("temperature_c").alias("temperature_c"))


@register("weather_climatology", V.with_ctes(V.W_O, _CLIM) + f"""
select park_id, cast(month as integer) as month, {V.r6('temperature_c')} as temperature_c, {V.r6('precipitation_mm')} as precipitation_mm,
       {V.r6('wind_speed_kmh')} as wind_speed_kmh from clim""")
def weather_climatology(spark, sf_dir):
    """Monthly means over the five calendar years before the forecast day."""
    c = weather.climatology(landed.orders_weather(spark, sf_dir), AS_OF_ORDERS)
    return c.select("park_id", "month", *[round_to(x).alias(x) for x in weather.RENAME.values()])


@register("weather_forecast_filled", V.with_ctes(V.W_O, _CLIM, f"""fc as (
  select * from w_o where date between date '{AS_OF_ORDERS}' and date '{AS_OF_ORDERS}' + 16 and park_id <> '3'
     and not (park_id = '5' and date > date '{AS_OF_ORDERS}' + 10)),
fc_end as (select park_id, max(date) as fc_end from fc group by 1),
req as (
  select cast(n_nationkey as varchar) as park_id,
         cast(unnest(generate_series(date '{AS_OF_ORDERS}', date '{AS_OF_ORDERS}' + {FORECAST_REQUEST_DAYS}, interval 1 day)) as date) as date
  from nation)""") + """
select r.park_id, cast(r.date as varchar) as date,
  (floor((case when e.fc_end is not null and r.date <= e.fc_end then f.tavg else c.temperature_c end) * 1e6 + 0.5) / 1e6) as temperature_c,
  (floor((case when e.fc_end is not null and r.date <= e.fc_end then f.prcp else c.precipitation_mm end) * 1e6 + 0.5) / 1e6) as precipitation_mm,
  (floor((case when e.fc_end is not null and r.date <= e.fc_end then f.wspd else c.wind_speed_kmh end) * 1e6 + 0.5) / 1e6) as wind_speed_kmh
from req r left join fc_end e on e.park_id = r.park_id
left join fc f on f.park_id = r.park_id and f.date = r.date
left join clim c on c.park_id = r.park_id and c.month = month(r.date)""")
def weather_forecast_filled(spark, sf_dir):
    """Forecast to its last day, climatology after, per park."""
    w = landed.orders_weather(spark, sf_dir)
    parks = directories.parks_from_directory(landed.park_directory(spark, sf_dir)).select("park_id")
    start = F.to_date(F.lit(AS_OF_ORDERS))
    req = parks.select("park_id", F.explode(F.sequence(start, F.date_add(start, FORECAST_REQUEST_DAYS))).alias("date"))
    out = weather.add_weather_forecast(req, landed.forecast_payloads(w, AS_OF_ORDERS),
                                       weather.climatology(w, AS_OF_ORDERS), AS_OF_ORDERS)
    return as_report(out.select("park_id", "date", *[round_to(c).alias(c) for c in weather.RENAME.values()]))


# ------------------------------------------------------------------ imputation and encoding

_WH = """wh as (
  select l.date, l.park_id, l.crowd_level, w.tavg as temperature_c, w.prcp as precipitation_mm,
         w.wspd as wind_speed_kmh
  from levels l left join w_o w on w.park_id = l.park_id and w.date = l.date),
""" + ",\n".join([V.median_cte("m_t", "wh", "temperature_c"), V.median_cte("m_p", "wh", "precipitation_mm"),
                  V.median_cte("m_w", "wh", "wind_speed_kmh")]) + """,
med as (select m_t.m as mt, m_p.m as mp, m_w.m as mw from m_t, m_p, m_w)"""


def _weather_frame(spark, sf_dir):
    return weather.add_weather_history(orders_levels(spark, sf_dir), landed.orders_weather(spark, sf_dir))


@register("median_impute", V.with_ctes(V.R_O, V.P_O, V.LEVELS_O, V.W_O, _WH) + """
select cast(date as varchar) as date, park_id, crowd_level,
       floor(coalesce(temperature_c, mt) * 1e6 + 0.5) / 1e6 as temperature_c,
       floor(coalesce(precipitation_mm, mp) * 1e6 + 0.5) / 1e6 as precipitation_mm,
       floor(coalesce(wind_speed_kmh, mw) * 1e6 + 0.5) / 1e6 as wind_speed_kmh
from wh, med
where coalesce(temperature_c, mt) is not null and coalesce(precipitation_mm, mp) is not null
  and coalesce(wind_speed_kmh, mw) is not null""")
def median_impute(spark, sf_dir):
    """Exact batch medians fill numeric NULLs, remaining NULL rows dropped."""
    frame = materialise(_weather_frame(spark, sf_dir), "weather-frame")
    filled, _ = impute.fill_with_median(frame)
    return as_report(filled.select("date", "park_id", "crowd_level",
                                   *[round_to(c).alias(c) for c in weather.RENAME.values()]))


@register("median_missing_counters", V.with_ctes(V.R_O, V.P_O, V.LEVELS_O, V.W_O, _WH) + """
select count(*) filter (where temperature_c is null or precipitation_mm is null or wind_speed_kmh is null) as rows_with_nulls_before,
       count(*) filter (where coalesce(temperature_c, mt) is null or coalesce(precipitation_mm, mp) is null
                          or coalesce(wind_speed_kmh, mw) is null) as rows_with_nulls_after,
       count(*) filter (where coalesce(temperature_c, mt) is null or coalesce(precipitation_mm, mp) is null
                          or coalesce(wind_speed_kmh, mw) is null) as rows_dropped
from wh, med""")
def median_missing_counters(spark, sf_dir):
    """Rows with NULLs before / after imputation and rows dropped, observed by the job that
    writes the imputed rows."""
    frame = materialise(_weather_frame(spark, sf_dir), "weather-frame")
    seen = Observation()
    filled, _ = impute.fill_with_median(frame, observed=seen)
    materialise(filled, "filled")               # the job that writes the result counts
    names = ["rows_with_nulls_before", "rows_with_nulls_after", "rows_dropped"]
    return spark.createDataFrame([tuple(seen.get[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


_PARKS_ALL = [str(i) for i in range(25)]        # nation keys: the park ids of the orders world
_ONE_HOT_SQL = ", ".join(f"coalesce(cast(park_id = '{p}' as integer), 0) as park_{p}" for p in sorted(_PARKS_ALL))


@register("park_one_hot", V.with_ctes(V.R_O, V.P_O, V.LEVELS_O) + f"""
select cast(date as varchar) as date, crowd_level, {_ONE_HOT_SQL} from levels""")
def park_one_hot(spark, sf_dir):
    """L1: park_<id> integer columns (ids string-sorted), park_id removed."""
    return as_report(encode.one_hot_parks(orders_levels(spark, sf_dir)))


_ALIGN_SQL = ", ".join(
    (f"coalesce(cast(park_id = '{p}' as integer), 0) as park_{p}" if p in ("1", "2", "3") else f"0 as park_{p}")
    for p in sorted(_PARKS_ALL))


@register("align_columns", V.with_ctes(V.R_E, V.P_E, V.LEVELS_O.replace("r_o", "r_e").replace("p_o", "p_e")) + f"""
select cast(date as varchar) as date, crowd_level, {_ALIGN_SQL}, 0 as is_bank_holiday from levels""")
def align_columns(spark, sf_dir):
    """Events-world one-hots aligned to the orders-world training columns (missing -> 0)."""
    train_cols = ["crowd_level"] + [f"park_{v}" for v in encode.park_values(landed.customer_park_info(spark, sf_dir))]
    train_cols.append("is_bank_holiday")
    inf = encode.one_hot_parks(events_levels(spark, sf_dir))
    return as_report(encode.align_columns(inf, train_cols, keep=["date"]))
