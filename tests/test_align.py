"""15-minute alignment against a brute-force nearest search over the slot grid."""

import datetime as dt
import random

from crowdspark.operators import align

SLOT = dt.timedelta(minutes=15)
TOL = dt.timedelta(minutes=7.5)


def brute_force(points):
    """points: list of (ts, value, closed, id) of one ride-day -> {slot: (value, closed)}.
    Grid from floor(first) to the minute-based ceiling of the last reading (the next day's
    00:00 slot allowed), nearest reading per slot, ties to the earliest (then first id)."""
    pts = sorted(points, key=lambda p: (p[0], p[3]))
    start, end = pts[0][0], pts[-1][0]
    s = start.replace(minute=start.minute // 15 * 15, second=0, microsecond=0)
    m = (end.minute + 14) // 15 * 15
    e = end.replace(minute=0, second=0, microsecond=0) + dt.timedelta(minutes=m)
    out, cur = {}, s
    while cur <= e:
        best = min(pts, key=lambda p: abs(p[0] - cur))
        if abs(best[0] - cur) <= TOL:
            out[cur] = (best[1], best[2])
        cur += SLOT
    return out


def test_alignment_equals_brute_force(spark):
    rnd = random.Random(11)
    rows, expected = [], {}
    rid = 0
    for ride in range(60):
        day = dt.date(2024, 3, 1) + dt.timedelta(days=ride % 3)
        base = dt.datetime.combine(day, dt.time(0, 0))
        n = rnd.randint(1, 25)
        pts = []
        for _ in range(n):
            kind = rnd.random()
            if kind < 0.2:       # exactly 7.5 minutes after a slot: fills both neighbours
                t = base + dt.timedelta(minutes=15 * rnd.randint(0, 95) + 7, seconds=30)
            elif kind < 0.3:     # late evening: ceiling passes midnight
                t = base + dt.timedelta(hours=23, minutes=rnd.randint(40, 59), seconds=rnd.randint(0, 59))
            else:
                t = base + dt.timedelta(seconds=rnd.randint(0, 86399))
            rid += 1
            pts.append((t, rnd.randint(0, 90), rnd.randint(0, 1), rid))
        if rnd.random() < 0.2:   # duplicate timestamp with another value: first id wins
            rid += 1
            pts.append((pts[0][0], 999, 0, rid))
        for t, v, c, i in pts:
            rows.append((i, day, f"r{ride}", t, v, c))
        for slot, vc in brute_force(pts).items():
            expected[(day, f"r{ride}", slot)] = vc
    df = spark.createDataFrame(rows, "id long, date date, ride_id string, ts timestamp, queue_time int, is_closed int")
    got = {(r["date"], r["ride_id"], r["slot"]): (r["queue_time"], r["is_closed"])
           for r in align.align_to_slots(df).collect()}
    assert got == expected


def test_labels_are_wall_clock(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 3, 1), "a", dt.datetime(2024, 3, 1, 10, 2, 0), 5, 0)],
                               "id long, date date, ride_id string, ts timestamp, queue_time int, is_closed int")
    r = align.align_to_slots(df).collect()
    assert [(x["time_of_day"], x["queue_time"]) for x in r] == [("10:00", 5)]
