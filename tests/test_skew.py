"""A hot key: one ride holds a third of all readings; results stay whole and exact."""

import datetime as dt
import random

import pandas as pd

from crowdspark.operators import align, labels

from .test_align import brute_force


def test_hot_ride_levels_and_alignment(spark):
    rnd = random.Random(5)
    rows, rid = [], 0
    base = dt.datetime(2024, 6, 1, 8, 0)
    for day in range(6):
        for ride in range(9):
            n = 40 if ride else 200                    # ride 0: a third of the readings
            for _ in range(n):
                rid += 1
                t = base + dt.timedelta(days=day, seconds=rnd.randint(0, 10 * 3600))
                rows.append((rid, t.date(), f"r{ride}", t, rnd.randint(0, 90), 0))
    cols = "id long, date date, ride_id string, ts timestamp, queue_time int, is_closed int"
    df = spark.createDataFrame(rows, cols).repartition(4)
    pi = spark.createDataFrame([(f"r{i}", str(i % 2 + 1), f"R{i}") for i in range(9)],
                               "ride_id string, park_id string, ride_name string")

    got = {(r["date"], r["park_id"]): r["crowd_level"] for r in labels.crowd_levels(df, pi).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "date", "ride_id", "ts", "q", "c"])
    pdf["park_id"] = pdf["ride_id"].map({f"r{i}": str(i % 2 + 1) for i in range(9)})
    m = pdf.groupby(["date", "park_id", "ride_id"])["q"].mean().round(6).reset_index()
    m = m.groupby(["date", "park_id"])["q"].mean().round(6).reset_index()
    m["lvl"] = (m.groupby("park_id")["q"].rank(pct=True) * 100).round().astype(int)
    assert got == {(d, p): lv for d, p, lv in zip(m["date"], m["park_id"], m["lvl"])}

    aligned = align.align_to_slots(df.where("ride_id = 'r0'")).collect()
    got_a = {(r["date"], r["slot"]): (r["queue_time"], r["is_closed"]) for r in aligned}
    want = {}
    for day in sorted({r[1] for r in rows}):
        pts = [(r[3], r[4], r[5], r[0]) for r in rows if r[2] == "r0" and r[1] == day]
        want.update({(day, s): v for s, v in brute_force(pts).items()})
    assert got_a == want


def test_skew_settings_on(spark):
    from crowdspark.session import apply_defaults
    apply_defaults(spark)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
