"""Holidays, schedules, opening hours, weather fallback, encoding - tiny hand-made frames."""

import datetime as dt

from crowdspark.operators import calendar, encode, opening, weather
from crowdspark.sources import directories, holidays, schedule

D = dt.date


def test_school_periods_padding_inversion_malformed(spark):
    p = spark.createDataFrame([
        ("AFRICA", "summer", "1996-07-01", "1996-07-03"),
        ("ASIA", "spring", "1997-4-5", "1997-04-06"),
        ("ASIA", "overlap", "1997-04-06", "1997-04-07"),
        ("EUROPE", "inverted", "1998-05-10", "1998-05-01"),
        ("EUROPE", "malformed", "junk", "1998-12-31"),
    ], "country string, holiday_name string, start_date string, end_date string")
    got = sorted((r["country"], r["date"]) for r in holidays.school_holiday_days(p).collect())
    assert got == [("AFRICA", D(1996, 7, 1)), ("AFRICA", D(1996, 7, 2)), ("AFRICA", D(1996, 7, 3)),
                   ("ASIA", D(1997, 4, 5)), ("ASIA", D(1997, 4, 6)), ("ASIA", D(1997, 4, 7))]


def test_public_holidays_need_a_date(spark):
    rows = spark.createDataFrame([("GB", "2024-01-01", "a"), ("GB", None, "b"), ("GB", "2024-01-01", "c")],
                                 "country_code string, date string, name string")
    assert [tuple(r) for r in holidays.public_holiday_days(rows).collect()] == [("GB", D(2024, 1, 1))]


def test_flags_and_unknown_country(spark):
    frame = spark.createDataFrame([(D(2024, 1, 1), "1"), (D(2024, 1, 2), "1"), (D(2024, 1, 1), "9")],
                                  "date date, park_id string")
    countries = spark.createDataFrame([("1", "Land", "LA")], "park_id string, country string, country_code string")
    days = spark.createDataFrame([("LA", D(2024, 1, 1))], "country_code string, date date")
    out = {(r["date"], r["park_id"]): r["is_bank_holiday"] for r in calendar.add_bank_holidays(frame, countries, days).collect()}
    assert out == {(D(2024, 1, 1), "1"): True, (D(2024, 1, 2), "1"): False, (D(2024, 1, 1), "9"): False}


def test_date_features_monday_first(spark):
    df = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 1, 7),), (None,)], "date date")
    r = calendar.add_date_features(df).collect()
    assert r[0]["day_of_week_1"] and r[0]["month_1"] and not r[0]["day_of_week_7"]
    assert r[1]["day_of_week_7"]
    assert not any(r[2][f"day_of_week_{i}"] for i in range(1, 8))   # NULL day -> all False


def _payload(spark, rows):
    return spark.createDataFrame(rows, "park_id string, year_month string, schedule array<struct<date:string,openingTime:string,closingTime:string>>")


def test_schedule_last_entry_wins_and_wall_clock(spark):
    p = _payload(spark, [("1", "2024-02", [("2024-02-01", "2024-02-01T10:00:00+01:00", "2024-02-01T18:00:00+01:00"),
                                           ("2024-02-02", "2024-02-02T09:30:00Z", "2024-02-02T17:00:00Z"),
                                           ("2024-02-02", "2024-02-02T19:00:00Z", "2024-02-02T23:00:00Z")]),
                         ("2", "2024-02", [("2024-02-01", "2024-02-01T11:00:00-05:00", "2024-02-02T00:30:00-05:00")])])
    got = sorted(tuple(r) for r in schedule.schedule_days(p).collect())
    assert got == [("1", D(2024, 2, 1), "10:00", "18:00"), ("1", D(2024, 2, 2), "19:00", "23:00"),
                   ("2", D(2024, 2, 1), "11:00", "00:30")]


def test_schedule_bad_entry_voids_month(spark):
    p = _payload(spark, [("1", "2024-02", [("2024-02-01", "2024-02-01T10:00:00Z", "2024-02-01T18:00:00Z"),
                                           ("2024-02-02", "TBD", "2024-02-02T17:00:00Z")]),
                         ("1", "2024-03", [("2024-03-01", "2024-03-01T10:00:00Z", "2024-03-01T18:00:00Z")])])
    assert [r["date"] for r in schedule.schedule_days(p).collect()] == [D(2024, 3, 1)]
    assert len(schedule.schedule_days(p, strict_month=False).collect()) == 2


def test_opening_history_else_schedule_per_day(spark):
    req = spark.createDataFrame([("1", D(2024, 2, 1)), ("1", D(2024, 2, 2)), ("1", D(2024, 2, 3)), ("1", D(2024, 2, 4))],
                                "park_id string, date date")
    hist = spark.createDataFrame([("1", D(2024, 2, 1), "09:15", None)],
                                 "park_id string, date date, opening_time string, closing_time string")
    sched = spark.createDataFrame([("1", D(2024, 2, 1), "08:00", "20:00"), ("1", D(2024, 2, 2), "19:00", "01:00"),
                                   ("1", D(2024, 2, 3), "x", "20:00")],
                                  "park_id string, date date, opening_time string, closing_time string")
    out = sorted(tuple(r) for r in opening.add_opening_hours(req, hist, sched).collect())
    # day 1 keeps its (partial) history -> dropped; day 2 past midnight; day 3 malformed; day 4 none
    assert out == [("1", D(2024, 2, 2), 19, 1, -18)]


def test_forecast_then_climatology(spark):
    req = spark.createDataFrame([(p, D(2001, 6, 1) + dt.timedelta(days=i)) for p in ("1", "3") for i in range(4)],
                                "park_id string, date date")
    payload = spark.createDataFrame(
        [("1", "out of allowed range from 2001-06-01 to 2001-06-02",
          (["2001-06-01", "2001-06-02", "2001-06-03"], [10.0, None, 12.0], [1.0, 1.0, 1.0], [2.0, 2.0, 2.0]))],
        "park_id string, reason string, daily struct<time:array<string>,temperature_2m_mean:array<double>,"
        "precipitation_sum:array<double>,windspeed_10m_mean:array<double>>")
    clim = spark.createDataFrame([("1", 6, 99.0, 9.0, 9.0), ("3", 6, 50.0, 5.0, 5.0)],
                                 "park_id string, month int, temperature_c double, precipitation_mm double, wind_speed_kmh double")
    out = {(r["park_id"], r["date"].day): r["temperature_c"]
           for r in weather.add_weather_forecast(req, payload, clim, "2001-06-01").collect()}
    assert out[("1", 1)] == 10.0 and out[("1", 2)] is None          # a NULL inside the forecast stays
    assert out[("1", 3)] == 99.0 and out[("1", 4)] == 99.0          # allowed end caps the forecast
    assert all(out[("3", d)] == 50.0 for d in range(1, 5))          # no forecast: climatology


def test_one_hot_string_order_and_align(spark):
    df = spark.createDataFrame([("1", 5), ("10", 6), ("2", 7), (None, 8)], "park_id string, v int")
    oh = encode.one_hot_parks(df)
    assert oh.columns == ["v", "park_1", "park_10", "park_2"]
    assert [tuple(r) for r in oh.orderBy("v").collect()][-1] == (8, 0, 0, 0)
    al = encode.align_columns(oh, ["park_2", "park_7", "v"])
    assert al.columns == ["park_2", "park_7", "v"] and al.orderBy("v").first()["park_7"] == 0


def test_directory_first_match_and_label(spark):
    doc = spark.createDataFrame([([("A", [(1, "One", "X", "1.5", "2.5"), (2, None, "Y", "bad", "0")]),
                                   ("B", [(1, "later", "Z", "0", "0")])],)],
                                "companies array<struct<company:string,parks:array<struct<id:int,name:string,"
                                "country:string,latitude:string,longitude:string>>>>")
    got = {r["park_id"]: (r["name"], r["country"], r["latitude"], r["label"])
           for r in directories.park_dimension(doc).collect()}
    assert got == {"1": ("One", "X", 1.5, "One (ID 1)"), "2": (None, "Y", None, "Park 2 (ID 2)")}


def test_late_training_range_raises_when_asked(spark):
    import datetime as dt

    import pytest
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    from crowdspark.operators import weather
    days = spark.createDataFrame([("1", dt.date(2024, 1, 1)), ("1", dt.date(2024, 1, 5)), ("2", dt.date(2024, 1, 1))],
                                 "park_id string, date date")
    w = spark.createDataFrame([("1", dt.date(2024, 1, 1), 1.0, 2.0, 3.0), ("2", dt.date(2024, 1, 1), 4.0, 5.0, 6.0)],
                              "park_id string, date date, tavg double, prcp double, wspd double")
    got = {(r["park_id"], r["date"].day): r["temperature_c"] for r in weather.add_weather_history(days, w, "2024-01-03").collect()}
    assert got == {("1", 1): None, ("1", 5): None, ("2", 1): 4.0}
    with pytest.raises((PySparkException, Py4JJavaError)):
        weather.add_weather_history(days, w, "2024-01-03", on_late="error").collect()
    assert weather.add_weather_history(days, w, "2024-02-03", on_late="error").count() == 3
