import datetime as dt

from pyspark.sql import functions as F

from crowdspark.functions import (clip, closed_flag, crowd_label, falsy_zero, leading_int, parse_day,
                                  parse_reading_time, round_half_even_int, wall_clock_hhmm)


def one(spark, expr, value, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("y")).first()["y"]


def test_parse_day_separators_and_padding(spark):
    assert one(spark, parse_day("x"), "2024/10/30") == dt.date(2024, 10, 30)
    assert one(spark, parse_day("x"), "2024-10-30") == dt.date(2024, 10, 30)
    assert one(spark, parse_day("x"), "1997-4-5") == dt.date(1997, 4, 5)
    assert one(spark, parse_day("x"), "junk") is None


def test_wall_clock_ignores_offset(spark):
    assert one(spark, wall_clock_hhmm("x"), "2024-02-01T10:00:00+01:00") == "10:00"
    assert one(spark, wall_clock_hhmm("x"), "2024-02-02T09:30:00Z") == "09:30"
    assert one(spark, wall_clock_hhmm("x"), "2024-02-02T00:30:00-05:00") == "00:30"
    assert one(spark, wall_clock_hhmm("x"), "closed") is None


def test_reading_time_browser_and_iso(spark):
    ts = one(spark, parse_reading_time("x"), "Wed Oct 30 2024 10:02:00 GMT+0000 (Coordinated Universal Time)")
    assert ts == dt.datetime(2024, 10, 30, 10, 2, 0)
    assert one(spark, parse_reading_time("x"), "2024-10-30 10:02:05") == dt.datetime(2024, 10, 30, 10, 2, 5)
    assert one(spark, parse_reading_time("x"), "not a time") is None


def test_half_even_and_clip(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-3.0,), (101.2,)], "x double")
    got = [r["y"] for r in df.select(round_half_even_int("x").alias("y")).collect()]
    assert got == [0, 2, 2, -3, 101]
    got = [r["y"] for r in df.select(clip("x").alias("y")).collect()]
    assert got == [0.5, 1.5, 2.5, 0.0, 100.0]


def test_labels_and_falsy(spark):
    df = spark.createDataFrame([(0,), (24,), (25,), (49,), (50,), (74,), (75,), (100,)], "x int")
    assert [r["y"] for r in df.select(crowd_label("x").alias("y")).collect()] == \
        ["Quiet", "Quiet", "Moderate", "Moderate", "Busy", "Busy", "Very Busy", "Very Busy"]
    df = spark.createDataFrame([(None,), (0,), (7,)], "x int")
    assert [tuple(r) for r in df.select(falsy_zero("x"), closed_flag("x")).collect()] == [(0, 0), (0, 1), (7, 0)]


def test_leading_int(spark):
    df = spark.createDataFrame([("09:30",), ("23:00",), ("x:10",), (None,)], "x string")
    assert [r["y"] for r in df.select(leading_int("x").alias("y")).collect()] == [9, 23, None, None]
    assert F is not None


def test_reading_times_of_every_shape(spark):
    at = dt.datetime(2024, 2, 3, 4, 5, 6)
    minute = at.replace(second=0)
    forms = {
        "2024-02-03T04:05:06Z": at, "2024/2/3 4:05:06": at, "2024-02-03 04:05": minute, "2024-02-03T04:05:06.123+01:00": at,
        " 2024-02-03 04:05:06 UTC ": at, "Feb 3 2024 04:05:06": at, "feb 3, 2024, 4:05": minute, "Saturday, Feb 03 2024 04:05:06": at,
        "Sat Feb 03 2024 04:05:06 GMT-0500 (Eastern Standard Time)": at, "3 Feb 2024 04:05:06": at, "Sat, 03 FEB 2024 04:05:06 GMT": at,
        "2/3/2024 04:05": minute, "02/03/2024, 4:05:06": at, "2024-02-30 04:05": None, "2024-13-01 04:05": None,
        "2024-02-03 24:05": None, "2024-02-03 04:65": None, "Fab 3 2024 04:05": None, "13/13/2024 04:05": None, "2/3/2024 4:05 PM": None,
        "Feb 3 2024 4:05am": None, "04:05": None, "2024-02-03": None, "": None, "Feb 2024 04:05": None, "20240203 04:05": None, None: None}
    df = spark.createDataFrame([(k,) for k in forms], "x string")
    got = {r["x"]: r["t"] for r in df.select("x", parse_reading_time("x").alias("t")).collect()}
    assert got == forms
