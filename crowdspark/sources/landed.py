"""Landed inputs derived from the driver's tables.

The engine reads its inputs as tables: readings, ride -> park dimension, park / destination
directories, public holidays, school-holiday periods, park schedules, daily weather, forecast
payloads and captured chart payloads.  This module maps the driver's TPC-H-like tables onto
those shapes (the mapping of FIXTURES.md part B), so every query's work grows with the data.

Two worlds are used:
* orders world  - day-level readings (orders -> readings, customer -> park info, lineitem ->
  weather), 25 parks, 1995-2001;
* events world  - minute-level readings (events), parks 1..3, January 2024; it feeds the
  15-minute alignment, opening hours and the full training / inference frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import day_text, exact_mean, hhmm, round_to

# Fixed values of the holiday mapping: month / day of the public holidays, and the one
# (country, month) pair left out so countries differ.
PUBLIC_HOLIDAY_DAYS = [(1, 1, "New Year"), (5, 1, "Labour Day"), (12, 25, "Christmas")]
PUBLIC_HOLIDAY_SKIP = ("ASIA", 12)
# Schedule offsets per park of the events world (wall-clock is kept, offset ignored).
SCHEDULE_OFFSETS = {"1": "Z", "2": "+01:00", "3": "-05:00"}
SCHEDULE_SHIFT_DAYS = 14


# Columns of the driver's tables: with them, reading a table starts no job to look them up.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ----------------------------------------------------------------------------- orders world

def orders_readings(spark: SparkSession, sf_dir: str, text_dates: bool = False) -> DataFrame:
    """queue_data shape at day level.  ``date`` is a DATE (how the stored table keeps it); with
    ``text_dates`` it is 'YYYY/MM/DD' text like the original writer stored it."""
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").alias("id"),
        (day_text(day, "/") if text_dates else day).alias("date"),
        F.col("o_custkey").cast("string").alias("ride_id"),
        F.col("o_totalprice").alias("queue_time"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("is_closed"),
    )


def customer_park_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("ride_id"),
                    F.col("c_nationkey").cast("string").alias("park_id"),
                    F.col("c_name").alias("ride_name"))


def orders_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather per park (supplier nation) and ship day; partial coverage, NULL wind."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (li.join(s, li.l_suppkey == s.s_suppkey)
            .groupBy(F.col("s_nationkey").cast("string").alias("park_id"),
                     F.col("l_shipdate").cast("date").alias("date"))
            .agg(round_to(exact_mean("l_quantity")).alias("tavg"),
                 round_to(exact_mean("l_discount") * 100).alias("prcp"),
                 F.nullif(round_to(exact_mean("l_tax") * 100), F.lit(0.0)).alias("wspd")))


def school_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holiday periods per country: one per order, start = order day (non-padded text).

    Priority '5-LOW' lands a malformed end, '4-NOT SPECIFIED' an inverted period; the rest
    last ``o_orderkey mod 4`` extra days.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("r_name").alias("country"))
    start = F.col("o_orderdate").cast("date")
    end = (F.when(F.col("o_orderpriority") == "5-LOW", F.lit("junk"))
           .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", day_text(F.date_sub(start, 2)))
           .otherwise(day_text(F.date_add(start, (F.col("o_orderkey") % 4).cast("int")))))
    return (o.join(c, o.o_custkey == c.c_custkey)
            .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("country",
                    F.concat(F.lit("break-"), F.col("o_orderkey").cast("string")).alias("holiday_name"),
                    F.date_format(start, "yyyy-M-d").alias("start_date"),
                    end.alias("end_date")))


# ----------------------------------------------------------------------------- directories

def park_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Park directory document: one row, ``companies`` = regions with their nations as parks,
    followed by a catch-all company listing every park again (lower-case names) so that the
    first match by position matters."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    parks = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("r_regionkey").alias("cpos"), F.col("r_name").alias("company"), F.col("n_nationkey"),
        F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
                 F.col("r_name").alias("country"),
                 (F.col("n_nationkey") * 2.5 - 30).cast("string").alias("latitude"),
                 (F.col("n_nationkey") * 5.0 - 60).cast("string").alias("longitude")).alias("park"))
    extra = parks.select(F.lit(1_000_000).alias("cpos"), F.lit("ALL PARKS").alias("company"), "n_nationkey",
                         F.struct(F.col("park.id").alias("id"), F.lower("park.name").alias("name"),
                                  F.lit(None).cast("string").alias("country"),
                                  F.lit("0").alias("latitude"), F.lit("0").alias("longitude")).alias("park"))
    companies = (parks.unionByName(extra)
                 .groupBy("cpos", "company")
                 .agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "park"))).alias("ps"))
                 .select("cpos", F.struct("company", F.transform("ps", lambda x: x["park"]).alias("parks")).alias("c")))
    return companies.agg(F.sort_array(F.collect_list(F.struct("cpos", "c"))).alias("cs")).select(
        F.transform("cs", lambda x: x["c"]).alias("companies"))


def destination_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destination directory document: destinations = regions, parks with external ids and
    names in another letter case."""
    n = table(spark, sf_dir, "nation")
    parks = n.select(F.col("n_regionkey"), F.col("n_nationkey"),
                     F.struct(F.concat(F.lit("dest-"), F.col("n_nationkey").cast("string")).alias("id"),
                              F.initcap(F.lower("n_name")).alias("name")).alias("park"))
    dest = (parks.groupBy("n_regionkey")
            .agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "park"))).alias("ps"))
            .select("n_regionkey", F.struct(F.concat(F.lit("destination-"), F.col("n_regionkey").cast("string")).alias("destination"),
                                            F.transform("ps", lambda x: x["park"]).alias("parks")).alias("d")))
    return dest.agg(F.sort_array(F.collect_list(F.struct("n_regionkey", "d"))).alias("ds")).select(
        F.transform("ds", lambda x: x["d"]).alias("destinations"))


def country_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country name (lower case) -> two-letter code."""
    r = table(spark, sf_dir, "region")
    return r.select(F.lower("r_name").alias("name_lower"), F.upper(F.substring("r_name", 1, 2)).alias("alpha2"))


def _reading_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y): every calendar year from the first to the last of the readings of both worlds."""
    b = (table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"))
         .unionByName(table(spark, sf_dir, "events").select(F.year("ts").alias("y")))
         .agg(F.min("y").alias("lo"), F.max("y").alias("hi")))
    return b.select(F.explode(F.sequence("lo", "hi")).alias("y"))


def public_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public-holiday rows (country_code, date text, name) for every year present in the
    readings of both worlds; each country also lists one entry without a date."""
    r = table(spark, sf_dir, "region").select("r_name")
    names = r.agg(F.array_sort(F.collect_list("r_name"))).scalar()
    md = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(nm).alias("name"))
                   for m, d, nm in PUBLIC_HOLIDAY_DAYS])
    rows = (_reading_years(spark, sf_dir).select("y", F.explode(names).alias("r_name"))
            .select("r_name", "y", F.explode(md).alias("h"))
            .where(~((F.col("r_name") == PUBLIC_HOLIDAY_SKIP[0]) & (F.col("h.m") == PUBLIC_HOLIDAY_SKIP[1])))
            .select(F.upper(F.substring("r_name", 1, 2)).alias("country_code"),
                    day_text(F.make_date("y", "h.m", "h.d")).alias("date"), F.col("h.name").alias("name")))
    undated = r.select(F.upper(F.substring("r_name", 1, 2)).alias("country_code"),
                       F.lit(None).cast("string").alias("date"), F.lit("Floating day").alias("name"))
    return rows.unionByName(undated)


# ----------------------------------------------------------------------------- events world

def events_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw minute-level readings: id, date, ride_id, ts, queue_time, is_closed."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("date").alias("date"),
                    F.col("user_id").cast("string").alias("ride_id"), F.col("ts").cast("timestamp").alias("ts"),
                    F.floor("value").cast("int").alias("queue_time"),
                    F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_closed"))


def events_readings_with_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings with the 'HH:MM' wall-clock the stored table carries."""
    return events_readings(spark, sf_dir).withColumn("time_of_day", hhmm("ts"))


def events_park_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id").distinct()
    return e.select(F.col("user_id").cast("string").alias("ride_id"),
                    (F.col("user_id") % 3 + 1).cast("string").alias("park_id"),
                    F.concat(F.lit("Ride "), F.col("user_id").cast("string")).alias("ride_name"))


def events_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather per park of the events world (wind is NULL on days with more errors than views)."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    return (e.groupBy((F.col("user_id") % 3 + 1).cast("string").alias("park_id"), F.col("ts").cast("date").alias("date"))
            .agg(round_to(exact_mean("value") / 10).alias("tavg"),
                 round_to(exact_mean(F.when(F.col("event_type") == "click", F.col("value"))) / 20).alias("prcp"),
                 F.when(F.count_if(F.col("event_type") == "error") <= F.count_if(F.col("event_type") == "view"),
                        round_to(exact_mean("value") / 30)).alias("wspd")))


def schedule_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule documents (park_id, year_month, schedule array) as a schedule service returns.

    Each park-day of the events world lands an entry ``SCHEDULE_SHIFT_DAYS`` later: opening
    at the hour of the first event, closing one hour after the hour of the last one (so it
    may pass midnight).  Days with more errors than views get a second, later entry for the
    same date (the last entry wins).  Offsets differ per park.
    """
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    day = (e.groupBy((F.col("user_id") % 3 + 1).cast("string").alias("park_id"), F.col("ts").cast("date").alias("d"))
           .agg(F.date_trunc("hour", F.min("ts")).alias("open_ts"),
                (F.date_trunc("hour", F.max("ts")) + F.expr("INTERVAL 1 HOUR")).alias("close_ts"),
                F.count_if(F.col("event_type") == "error").alias("n_err"),
                F.count_if(F.col("event_type") == "view").alias("n_view")))
    shift = F.expr(f"INTERVAL {SCHEDULE_SHIFT_DAYS} DAYS")
    day = day.select("park_id", F.date_add("d", SCHEDULE_SHIFT_DAYS).alias("date"),
                     (F.col("open_ts") + shift).alias("open_ts"), (F.col("close_ts") + shift).alias("close_ts"),
                     (F.col("n_err") > F.col("n_view")).alias("late"))
    offset = F.coalesce(*[F.when(F.col("park_id") == p, F.lit(o)) for p, o in SCHEDULE_OFFSETS.items()], F.lit("Z"))

    def iso(ts):
        return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), offset)

    first = day.select("park_id", "date", F.lit(0).alias("k"), iso(F.col("open_ts")).alias("openingTime"),
                       iso(F.col("close_ts")).alias("closingTime"))
    late = day.where("late").select("park_id", "date", F.lit(1).alias("k"),
                                    iso(F.col("open_ts") + F.expr("INTERVAL 1 HOUR")).alias("openingTime"),
                                    iso(F.col("close_ts") + F.expr("INTERVAL 1 HOUR")).alias("closingTime"))
    entries = first.unionByName(late)
    return (entries.groupBy("park_id", F.date_format("date", "yyyy-MM").alias("year_month"))
            .agg(F.sort_array(F.collect_list(F.struct("date", "k", "openingTime", "closingTime"))).alias("es"))
            .select("park_id", "year_month",
                    F.transform("es", lambda x: F.struct(day_text(x["date"]).alias("date"),
                                                         x["openingTime"].alias("openingTime"),
                                                         x["closingTime"].alias("closingTime"))).alias("schedule")))


def chart_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured calendar pages (park_id, date, panels) as the page extractor sees them.

    One page holds the panel of one ride and hour, so that no row grows with the readings of a
    day: link text with padding, browser-style time labels, a 'Reported by park' dataset (0 for
    error readings, missing for readings of value < 1) and a visitor dataset.  Rides with id
    divisible by 17 lose their link.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    pts = e.select(
        (F.col("user_id") % 3 + 1).cast("string").alias("park_id"), F.col("ts").cast("date").alias("d"),
        F.col("user_id"), F.hour("ts").alias("hour"), F.col("event_id"),
        F.date_format("ts", "EEE MMM dd yyyy HH:mm:ss 'GMT+0000 (Coordinated Universal Time)'").alias("label"),
        F.when(F.col("event_type") == "error", F.lit(0))
         .when(F.col("value") >= 1, F.floor("value").cast("int")).alias("park_value"),
        F.floor(F.col("value") * 1.1).cast("int").alias("visitor_value"))
    points = pts.groupBy("park_id", "d", "user_id", "hour").agg(
        F.sort_array(F.collect_list(F.struct("event_id", "label", "park_value", "visitor_value"))).alias("p"))
    panel = F.struct(
        F.when(F.col("user_id") % 17 != 0,
               F.format_string("/parks/%s/rides/%d", F.col("park_id"), F.col("user_id"))).alias("href"),
        F.format_string("  Ride %d ", F.col("user_id")).alias("ride_name"),
        F.transform("p", lambda x: x["label"]).alias("labels"),
        F.array(F.struct(F.lit("Reported by visitors").alias("label"),
                         F.transform("p", lambda x: x["visitor_value"]).alias("data")),
                F.struct(F.lit("Reported by park").alias("label"),
                         F.transform("p", lambda x: x["park_value"]).alias("data"))).alias("datasets"))
    return points.select("park_id", day_text("d", "/").alias("date"), F.array(panel).alias("panels"))


def forecast_payloads(weather: DataFrame, as_of: str, horizon_days: int = 16,
                      missing_park: str = "3", short_park: str = "5", short_days: int = 10) -> DataFrame:
    """Forecast responses per park: parallel daily arrays from ``as_of`` on.

    ``missing_park`` gets no forecast and ``short_park`` one that ends early; every
    response carries the allowed-range text the service sends with it.
    """
    start = F.to_date(F.lit(as_of))
    w = weather.where((F.col("date") >= start) & (F.col("date") <= F.date_add(start, horizon_days))
                      & (F.col("park_id") != missing_park)
                      & ~((F.col("park_id") == short_park) & (F.col("date") > F.date_add(start, short_days))))
    g = (w.groupBy("park_id")
         .agg(F.sort_array(F.collect_list(F.struct("date", "tavg", "prcp", "wspd"))).alias("rows"),
              F.max("date").alias("last")))
    return g.select(
        "park_id",
        F.format_string("Parameter 'end_date' is out of allowed range from %s to %s",
                        F.lit(as_of), day_text("last")).alias("reason"),
        F.struct(F.transform("rows", lambda x: day_text(x["date"])).alias("time"),
                 F.transform("rows", lambda x: x["tavg"]).alias("temperature_2m_mean"),
                 F.transform("rows", lambda x: x["prcp"]).alias("precipitation_sum"),
                 F.transform("rows", lambda x: x["wspd"]).alias("windspeed_10m_mean")).alias("daily"))


__all__ = [
    "table", "orders_readings", "customer_park_info", "orders_weather", "school_periods",
    "park_directory", "destination_directory", "country_aliases", "public_holidays",
    "events_readings", "events_readings_with_time", "events_park_info", "events_weather",
    "schedule_payloads", "chart_payloads", "forecast_payloads",
]
