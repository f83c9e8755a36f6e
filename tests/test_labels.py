import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from crowdspark.operators import labels

D1, D2, D3 = dt.date(2024, 5, 1), dt.date(2024, 5, 2), dt.date(2024, 5, 3)


def readings(spark, rows):
    return spark.createDataFrame(rows, "date date, ride_id string, queue_time double, is_closed int")


def test_mean_of_means_unweighted(spark):
    r = readings(spark, [(D1, "a", 10.0, 0), (D1, "a", 20.0, 0), (D1, "a", 30.0, 0), (D1, "b", 100.0, 0),
                         (D1, "b", 999.0, 1)])
    pi = spark.createDataFrame([("a", "1", "A"), ("b", "1", "B")], "ride_id string, park_id string, ride_name string")
    m = labels.park_day_mean(labels.ride_day_mean(labels.attach_park(r.where("is_closed = 0"), pi))).first()
    assert m["avg_queue_time"] == 60.0          # (20 + 100) / 2, not 160 / 4


def test_percentile_rank_matches_pandas_average_rank(spark):
    rnd = random.Random(7)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), str(p), float(rnd.choice([1, 2, 2, 3, 5, 8, 8, 8, 13])))
            for p in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "date date, park_id string, avg_queue_time double")
    got = {(r["date"], r["park_id"]): r["crowd_level"] for r in labels.percentile_rank_level(df).collect()}
    pdf = pd.DataFrame(rows, columns=["date", "park_id", "v"])
    pdf["lvl"] = (pdf.groupby("park_id")["v"].rank(pct=True) * 100).round().astype(int)
    want = {(d, p): lv for d, p, lv in zip(pdf["date"], pdf["park_id"], pdf["lvl"])}
    assert got == want


def test_null_keys_dropped_and_coercion(spark):
    r = readings(spark, [(D1, "a", 10.0, 0), (None, "a", 50.0, 0), (D2, "x", 5.0, 0), (D3, "c", 7.0, 0)])
    pi = spark.createDataFrame([("a", "2.0", "A"), ("c", "junk", "C")], "ride_id string, park_id string, ride_name string")
    out = labels.crowd_levels(r, pi).collect()
    assert [(x["date"], x["park_id"], x["crowd_level"]) for x in out] == [(D1, "2", 100)]


def test_include_filter_scalar_and_list(spark):
    r = readings(spark, [(D1, "a", 10.0, 0), (D1, "b", 20.0, 0), (D1, "c", 30.0, 0)])
    pi = spark.createDataFrame([("a", "1", "A"), ("b", "2", "B"), ("c", "10", "C")],
                               "ride_id string, park_id string, ride_name string")
    assert {x["park_id"] for x in labels.crowd_levels(r, pi, 2).collect()} == {"2"}
    assert {x["park_id"] for x in labels.crowd_levels(r, pi, ["1", 10]).collect()} == {"1", "10"}


def test_ride_in_two_parks_raises(spark):
    r = readings(spark, [(D1, "a", 10.0, 0)])
    pi = spark.createDataFrame([("a", "1", "A"), ("a", "2", "A")], "ride_id string, park_id string, ride_name string")
    with pytest.raises((PySparkException, Py4JJavaError)):
        labels.crowd_levels(r, pi).collect()


def test_missing_means_take_no_rank(spark):
    rows = [(dt.date(2024, 1, i + 1), "1", v) for i, v in enumerate([None, None, 1.0, 2.0, 3.0, 3.0])]
    df = spark.createDataFrame(rows, "date date, park_id string, avg_queue_time double")
    got = [r["crowd_level"] for r in labels.percentile_rank_level(df).orderBy("date").collect()]
    want = (pd.Series([v for _, _, v in rows]).rank(pct=True) * 100).round()
    assert got == [None if pd.isna(w) else int(w) for w in want]


def test_mean_keeps_full_precision(spark):
    r = readings(spark, [(D1, "a", 1.234567, 0)])
    pi = spark.createDataFrame([("a", "1", "A")], "ride_id string, park_id string, ride_name string")
    assert labels.ride_day_mean(labels.attach_park(r, pi)).first()["avg_queue_time"] == 1.234567
