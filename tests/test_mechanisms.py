"""Merged periods, names found by likeness, catalog tables, pruned reads, ingest sizes, counters."""

import datetime as dt
import glob
import os
import random
import tempfile

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from crowdspark.functions import parse_reading_time
from crowdspark.operators import calendar, labels, report, worklist
from crowdspark.schema import PARK_INFO
from crowdspark.sources import catalog, holidays, payload, sinks

D = dt.date


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ----------------------------------------------------------------------------- merged periods

def test_merged_periods_of_hostile_overlaps(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(600):
        start = D(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 500))
        end = start + dt.timedelta(days=rnd.choice([-3, 0, 0, 1, 2, 7, 40]))
        text = rnd.choice(["%Y-%m-%d", "%Y/%m/%d"])
        rows.append((rnd.choice(["A", "B", "C"]), "x", start.strftime(text), end.strftime(text)))
    rows += [("A", "bad", "junk", "2024-01-01"), ("A", "bad", "2024-01-01", None), ("D", "inverted", "2024-02-02", "2024-02-01"),
             ("E", "inside", "2024-03-01", "2024-03-31"), ("E", "inside", "2024-03-05", "2024-03-06"),
             ("E", "adjoining", "2024-04-01", "2024-04-02"), ("E", "gap", "2024-04-04", "2024-04-04")] + rows[:50]
    df = spark.createDataFrame(rows, "country string, holiday_name string, start_date string, end_date string")
    days = set()
    for country, _, a, b in rows:
        try:
            a, b = (dt.datetime.strptime(t.replace("/", "-"), "%Y-%m-%d").date() for t in (a, b))
        except (ValueError, AttributeError):
            continue
        days |= {(country, a + dt.timedelta(days=i)) for i in range((b - a).days + 1)}
    merged = holidays.merged_periods(df).collect()
    assert sum((r["end_date"] - r["start_date"]).days + 1 for r in merged) == len(days)      # no day twice
    got = [tuple(r) for r in holidays.school_holiday_days(df).collect()]
    assert len(got) == len(set(got)) and set(got) == days
    assert [(r["start_date"], r["end_date"]) for r in sorted(merged) if r["country"] == "E"] == [
        (D(2024, 3, 1), D(2024, 4, 2)), (D(2024, 4, 4), D(2024, 4, 4))]
    for r in merged:                                                                        # and none next to another
        assert (r["country"], r["start_date"] - dt.timedelta(days=1)) not in days
        assert (r["country"], r["end_date"] + dt.timedelta(days=1)) not in days
    assert holidays.merged_periods(df.where("false")).count() == 0


# ----------------------------------------------------------------------------- names by likeness

def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _pairs(t):
    t = f" {t} "
    return {t[i:i + 2] for i in range(len(t) - 1)}


COUNTRIES = {"austria": "AT", "australia": "AU", "germany": "DE", "france": "FR", "spain": "ES", "united kingdom": "GB",
             "united states": "US", "cote d ivoire": "CI", "niger": "NE", "nigeria": "NG", "iran": "IR", "iraq": "IQ", "chad": "TD"}


@pytest.mark.parametrize("least", [0.5, 0.7, 0.9])
def test_names_against_every_entry(spark, least):
    rnd = random.Random(7)
    asked = list(COUNTRIES) + ["", "q", "xyz"]
    for name in list(COUNTRIES) * 6:
        letters = list(name)
        for _ in range(rnd.randint(1, 3)):
            at = rnd.randrange(len(letters))
            letters[at:at + rnd.randint(0, 1)] = rnd.choice(["", "e", "x", "an"])
            letters = letters or ["a"]
        asked.append("".join(letters).strip())
    known = [(n, c) for n, c in COUNTRIES.items()] + [("austria", "ZZ"), ("spain", "AA"), ("", "QQ"), (None, "NN"), ("chad", None)]
    found = calendar.match_names(spark.createDataFrame([(a,) for a in asked] + [(None,)], "plain string"),
                                 spark.createDataFrame(known, "plain string, code string"), least)
    got = {r["plain"]: (r["code"], r["known"]) for r in found.collect()}
    first = {}
    for n, c in known:
        if n and c:
            first[n] = min(c, first.get(n, c))
    want = {}
    for a in set(asked) - {""}:
        ranked = sorted((-(1 - _edit(a, n) / max(len(a), len(n))), -len(_pairs(a) & _pairs(n)), n, c) for n, c in first.items())
        if -ranked[0][0] >= least:
            want[a] = (ranked[0][3], ranked[0][2])
    assert got == want and found.count() == len(want)
    plan = _plan(found)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_park_countries_of_marked_and_doubled_names(spark):
    parks = spark.createDataFrame([(1, "España"), (2, "Côte d'Ivoire"), (3, "GERMANY "), (4, "Germny"), (5, "Atlantis"), (6, None)],
                                  "park_id int, country string")
    aliases = spark.createDataFrame([("espana", "ES"), ("espana", "XX"), ("cote d'ivoire", "CI"), ("germany", "DE"),
                                     ("germany", "DE"), (None, "QQ")], "name_lower string, alpha2 string")
    rows = calendar.park_countries(parks, aliases).collect()
    assert sorted((r["park_id"], r["country_code"]) for r in rows) == [(1, "ES"), (2, "CI"), (3, "DE"), (4, "DE"), (5, None), (6, None)]
    assert {r["park_id"]: r["country"] for r in rows}[1] == "España"
    assert len(calendar._MARKED) == len(calendar._PLAIN)
    with pytest.raises(ValueError):
        calendar.match_names(parks, aliases, 0.4)


# ----------------------------------------------------------------------------- stored readings

READING = "ride_id string, slot timestamp, time_of_day string, queue_time int, is_closed int, date date"


def _readings(spark, n_days=10, per_day=30):
    rows = [(f"r{i % 6}", dt.datetime(2024, 1, 1 + d, 9) + dt.timedelta(minutes=i), "09:00", i, 0, D(2024, 1, 1 + d))
            for d in range(n_days) for i in range(per_day)]
    rides = spark.createDataFrame([(f"r{i}", str(i % 2), "x") for i in range(5)], PARK_INFO)        # r5 has no park
    return spark.createDataFrame(rows, READING), rides


def test_ingest_resumes_each_park(spark):
    path = os.path.join(tempfile.mkdtemp(), "queue_data")
    readings, rides = _readings(spark)
    sinks.create_tables(spark, path, path + "-rides")
    sinks.ingest_readings(readings.where("date <= '2024-01-04' or ride_id in ('r1', 'r3')"), rides, path)
    before = sinks.read_readings(spark, path).count()
    sinks.ingest_readings(readings, rides, path)
    stored = sinks.read_readings(spark, path)
    assert before < stored.count() == readings.count()
    sinks.ingest_readings(readings, rides, path)                    # nothing new, rides without a park included
    assert stored.count() == sinks.read_readings(spark, path).count()
    assert {(r["ride_id"], r["park_id"]) for r in stored.select("ride_id", "park_id").distinct().collect()} == \
        {(f"r{i}", str(i % 2)) for i in range(5)} | {("r5", None)}


def test_last_day_reads_no_column(spark):
    path = os.path.join(tempfile.mkdtemp(), "queue_data")
    readings, rides = _readings(spark)
    sinks.append_readings(readings.where("date <= '2024-01-06' or ride_id = 'r1'").join(rides.drop("ride_name"), "ride_id"), path)
    last = worklist.last_stored_day(sinks.read_readings(spark, path))
    assert "ReadSchema: struct<>" in _plan(last)
    by_scan = worklist.last_stored_day(sinks.read_readings(spark, path).drop("park_id"), rides)
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in by_scan.collect()} == {("0", D(2024, 1, 6)), ("1", D(2024, 1, 10))}


def test_only_the_requested_days_are_read(spark):
    path = os.path.join(tempfile.mkdtemp(), "queue_data")
    readings, rides = _readings(spark)
    sinks.append_readings(readings.join(rides.drop("ride_name"), "ride_id"), path)
    days = spark.createDataFrame([(D(2024, 1, 3),), (D(2024, 1, 8),), (D(2024, 1, 8),), (D(2025, 1, 1),), (None,)], "date date")
    for file in glob.glob(f"{path}/*/*/*.parquet"):
        if not any(f"date=2024-01-0{d}" in file for d in (3, 8)):
            with open(file, "wb") as f:                             # reading it would fail
                f.write(b"no parquet")
    got = sinks.readings_of_days(sinks.read_readings(spark, path), days)
    assert "dynamicpruning" in _plan(got)
    assert {r["date"]: r["count"] for r in got.groupBy("date").count().collect()} == {D(2024, 1, 3): 25, D(2024, 1, 8): 25}


def test_a_large_day_is_written_by_as_many_tasks_as_it_asks(spark):
    base = tempfile.mkdtemp()
    big = spark.range(0, 300_000, 1, 24).select(F.concat(F.lit("r"), F.col("id") % 3).alias("ride_id"), F.sha2(F.col("id").cast("string"), 256).alias("v"),
                                      F.lit("1").alias("park_id"), F.lit("2024-01-01").cast("date").alias("date"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {}
    try:
        for size in ("512k", "64m"):
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
            sinks.append_readings(big, f"{base}/{size}")
            files[size] = len(glob.glob(f"{base}/{size}/*/*/*.parquet"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert files["512k"] > 8 > files["64m"] == 1
    assert spark.read.parquet(f"{base}/512k").count() == 300_000


def test_catalog_tables_meet_without_moving_readings(spark):
    base = tempfile.mkdtemp()
    readings, rides = _readings(spark)
    names = ("catalog_test_readings", "catalog_test_rides")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for _ in range(2):
            catalog.create_tables(spark, base, 4, *names)
        catalog.insert(readings, names[0])
        arrived = rides.withColumn("date", F.lit(None).cast("date")).withColumn("pos", F.lit(0))
        for _ in range(2):
            catalog.insert_new_rides(arrived, names[1])
        assert spark.table(names[1]).count() == 5
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = labels.attach_park(spark.table(names[0]).select("ride_id", "date", "queue_time"), spark.table(names[1]))
        assert "Exchange" not in _plan(met) and "Bucketed: true" in _plan(met)
        means = labels.ride_day_mean(met)
        assert met.count() == readings.join(rides, "ride_id").count() and means.count() == 50
        catalog.insert(readings.where("date = '2024-01-02'").limit(7), names[0], overwrite=True)     # that day only
        days = {r["date"]: r["count"] for r in spark.table(names[0]).groupBy("date").count().collect()}
        assert days[D(2024, 1, 2)] == 7 and days[D(2024, 1, 3)] == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


# ----------------------------------------------------------------------------- counters, bands

def test_counters_come_from_the_job_that_writes(spark, tmp_path):
    rows = [("1", "2024/10/30", [("/parks/1/rides/42", "A", ["2024-10-30 10:02", "garbage", None, "2024-10-30 10:20"],
                                  [("Reported by park", [1, None, 3])])])]
    pages = spark.createDataFrame(rows, "park_id string, date string, panels array<struct<href:string,ride_name:string,"
                                        "labels:array<string>,datasets:array<struct<label:string,data:array<int>>>>>")
    seen, periods = Observation(), Observation()
    payload.flatten_payloads(pages, observed=seen).write.parquet(str(tmp_path / "points"))
    assert seen.get == {"texts": 3, "unparsed": 1, "unreported": 2}
    df = spark.createDataFrame([("A", "x", "2024-1-1", "2024-01-03"), ("A", "x", "2024-1-1", "junk"), ("A", "x", "2024-1-9", "2024-1-8")],
                               "country string, holiday_name string, start_date string, end_date string")
    holidays.school_holiday_days(df.observe(periods, *holidays.period_metrics())).write.parquet(str(tmp_path / "days"))
    assert periods.get == {"periods": 3, "unreadable": 1, "inverted": 1}
    assert spark.createDataFrame([("x",)], "t string").select(parse_reading_time("t")).first()[0] is None


def test_bands_of_rows(spark):
    rows = [("1", D(2024, 1, i + 1), v) for i, v in enumerate([0, 24, 25, 74, 75, 100, None])] + [("2", D(2024, 1, 1), 90)]
    got = report.band_rows(spark.createDataFrame(rows, "park_id string, date date, crowd_level int")).collect()
    assert sorted(tuple(r)[:6] + (round(r["share"], 3),) for r in got) == [
        ("1", 0, 25, "Quiet", 2, D(2024, 1, 1), 0.286), ("1", 25, 50, "Moderate", 1, D(2024, 1, 3), 0.143),
        ("1", 50, 75, "Busy", 1, D(2024, 1, 4), 0.143)]


def test_range_problems(spark):
    rows = [("2024/01/02", "2024/01/03"), ("2024/01/02", "2024/01/01"), ("2024-01-02", "2024/01/03"), ("2024/01/02", "junk"),
            ("2024/02/30", "2024/03/01"), (None, "2024/01/01"), ("2024/1/2", "2024/1/2")]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, e string").select(
        worklist.range_problem(F.col("s"), F.col("e"))).collect()]
    assert got == [None, "the range ends before it begins", "the start is no day", "the end is no day", "the start is no day",
                   "the start is no day", None]


def test_both_holiday_flags_at_once(spark):
    days = spark.createDataFrame([(D(2024, 1, i), str(p)) for i in range(1, 5) for p in range(4)] + [(None, "1"), (D(2024, 1, 1), None)],
                                 "date date, park_id string")
    countries = spark.createDataFrame([("0", "Spain", "ES"), ("1", "France", "FR"), ("2", "Nowhere", None)],
                                      "park_id string, country string, country_code string")
    bank = spark.createDataFrame([("ES", D(2024, 1, 1)), ("FR", D(2024, 1, 2))], "country_code string, date date")
    school = spark.createDataFrame([("Spain", D(2024, 1, 2)), ("Nowhere", D(2024, 1, 3))], "country string, date date")
    both = calendar.add_holidays(days, countries, bank, school)
    one = calendar.add_school_holidays(calendar.add_bank_holidays(days, countries, bank), countries, school)
    assert both.columns == one.columns
    assert sorted(map(str, both.collect())) == sorted(map(str, one.collect()))
