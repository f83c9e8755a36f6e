"""Payload flattening, work lists, sinks, streaming ingest."""

import datetime as dt
import os
import tempfile

import pytest

from crowdspark.operators import align, worklist
from crowdspark.sources import payload, sinks
from crowdspark.streaming import ingest

D = dt.date


def test_panel_validity_and_falsy_values(spark):
    rows = [("1", "2024/10/30", [
        ("/parks/1/rides/42", " Big One ", ["Wed Oct 30 2024 10:02:00 GMT+0000", "Wed Oct 30 2024 10:17:00 GMT+0000",
                                            "garbage"],
         [("Reported by visitors", [5, 5, 5]), ("Reported by park", [0, None])]),
        (None, "no link", ["Wed Oct 30 2024 10:02:00 GMT+0000"], [("Reported by park", [1])]),
        ("/parks/1/rides/", "no id", ["Wed Oct 30 2024 10:02:00 GMT+0000"], [("Reported by park", [1])]),
        ("/parks/1/rides/7", "no park set", ["Wed Oct 30 2024 10:02:00 GMT+0000"], [("Reported by visitors", [1])]),
    ])]
    df = spark.createDataFrame(rows, "park_id string, date string, panels array<struct<href:string,ride_name:string,"
                                     "labels:array<string>,datasets:array<struct<label:string,data:array<int>>>>>")
    got = [(r["ride_id"], r["ride_name"], r["time_of_day"], r["queue_time"], r["is_closed"])
           for r in payload.flatten_payloads(df).orderBy("pos").collect()]
    assert got == [("42", "Big One", "2024-10-30 10:02:00", 0, 1),
                   ("42", "Big One", "2024-10-30 10:17:00", 0, 0),
                   ("42", "Big One", None, 0, 0)]


def test_work_list_resume_and_guards(spark):
    parks = spark.createDataFrame([("1",), ("2",), ("3",)], "park_id string")
    last = spark.createDataFrame([("1", D(2024, 2, 27)), ("2", D(2023, 1, 1))], "park_id string, last_day date")
    wl = worklist.work_list(parks, "2024/02/26", "2024/03/02", exclude_months=[2], last_days=last)
    got = sorted((r["park_id"], r["date"]) for r in wl.collect())
    assert got == [(p, f"2024/03/0{d}") for p in ("1", "2", "3") for d in (1, 2)]
    assert wl.first()["url"].startswith("parks/")
    with pytest.raises(ValueError):
        worklist.work_list(parks, "2024/03/02", "2024/03/01")
    with pytest.raises(ValueError):
        worklist.work_list(parks, "2024-03-01", "2024/03/02")


def test_insert_or_ignore_first_wins(spark):
    existing = spark.createDataFrame([("a", "1", "old")], "ride_id string, park_id string, ride_name string")
    incoming = spark.createDataFrame([("a", "1", "new", D(2024, 1, 2), 0), ("b", "1", "second", D(2024, 1, 3), 0),
                                      ("b", "1", "first", D(2024, 1, 2), 5)],
                                     "ride_id string, park_id string, ride_name string, date date, pos int")
    got = [tuple(r) for r in sinks.insert_or_ignore(existing, incoming).collect()]
    assert got == [("b", "1", "first")]


def test_append_and_idempotent_day_overwrite(spark):
    path = os.path.join(tempfile.mkdtemp(), "readings")
    df = spark.createDataFrame([("a", 1, D(2024, 1, 1)), ("a", 2, D(2024, 1, 2))], "ride_id string, v int, date date")
    sinks.append_readings(df, path)
    sinks.append_readings(df, path)                       # no de-duplication
    assert spark.read.parquet(path).count() == 4
    sinks.overwrite_reading_days(df.where("v = 2"), path)  # only that day replaced
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 1, 2]


def test_streaming_ingest_matches_batch(spark):
    base = tempfile.mkdtemp()
    src = os.path.join(base, "raw")
    rows = []
    for i in range(400):
        t = dt.datetime(2024, 1, 1, 8, 0) + dt.timedelta(minutes=3 * i + (i % 7))
        rows.append((i, t.date(), f"r{i % 4}", t, i % 50, int(i % 9 == 0)))
    raw = spark.createDataFrame(rows, ingest.RAW_READING)
    for h in range(4):                                   # four landed files, one per micro-batch
        raw.where(f"id >= {h * 100} and id < {(h + 1) * 100}").coalesce(1).write.mode("append").parquet(src)
    out, ck = os.path.join(base, "table"), os.path.join(base, "ckpt")
    q = ingest.start_ingest(spark, src, out, ck, delay="30 minutes", files_per_trigger=1)
    q.awaitTermination(240)
    got = {(r["date"], r["ride_id"], r["slot"]): (r["queue_time"], r["is_closed"]) for r in spark.read.parquet(out).collect()}
    batch = {(r["date"], r["ride_id"], r["slot"]): (r["queue_time"], r["is_closed"]) for r in align.align_to_slots(raw).collect()}
    final_wm = max(k[2] for k in batch) - dt.timedelta(minutes=30)
    assert got                                            # the stream emitted final slots
    assert all(batch[k] == v for k, v in got.items())     # each equals the batch answer
    # every slot older than the final watermark has been emitted (the open tail may wait)
    assert {k for k in batch if k[2] < final_wm - dt.timedelta(minutes=15)} <= set(got)
