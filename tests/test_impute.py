import random

import numpy as np

from crowdspark.operators import impute


def test_exact_median(spark):
    rnd = random.Random(3)
    vals = [rnd.choice([rnd.random() * 100, 42.0, 42.0, float(rnd.randint(0, 9))]) for _ in range(5001)]
    vals += [None] * 50
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    want = float(np.median([v for v in vals if v is not None]))
    assert impute.exact_medians(df, ["x"])["x"] == want


def test_even_count_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,)], "x double")
    assert impute.exact_medians(df, ["x"])["x"] == 6.0


def test_hot_value(spark):
    vals = [7.0] * 400 + [float(i) for i in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert impute.exact_medians(df, ["x"])["x"] == float(np.median(vals))


def test_fill_and_drop(spark):
    df = spark.createDataFrame([(1, 1.0, None, "a"), (2, None, None, "b"), (3, 3.0, None, None)],
                               "k int, x double, allnull double, s string")
    out, med = impute.fill_with_median(df)
    assert med == {"x": 2.0, "allnull": None}
    assert out.count() == 0          # all-null column: nothing to fill, every row dropped
    c = impute.missing_counters(df, med).first()
    assert (c["rows_with_nulls_before"], c["rows_with_nulls_after"]) == (3, 3)
    df2 = df.drop("allnull")
    out2, _ = impute.fill_with_median(df2)
    assert sorted((r["k"], r["x"]) for r in out2.collect()) == [(1, 1.0), (2, 2.0)]


def test_several_columns(spark):
    rnd = random.Random(9)
    rows = [(rnd.random() * 10 if i % 7 else None, float(rnd.randint(0, 30)), rnd.randint(0, 4)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c int")
    want = {k: float(np.median([r[i] for r in rows if r[i] is not None])) for i, k in enumerate("abc")}
    assert impute.exact_medians(df, ["a", "b", "c"]) == want


def test_order_statistics_by_group_and_type(spark):
    rows = [(k, f"{(i * 37) % 101:03d}") for k in range(3) for i in range(50 + k)] + [(1, None)]
    df = spark.createDataFrame(rows, "k int, v string")
    from pyspark.sql import functions as F
    got = {(r["k"], r["rank"]): r["v"] for r in
           impute.order_statistics(df, F.array(F.lit(0), F.col("total") - 1, F.lit(7), F.lit(999))).collect()}
    for k in range(3):
        own = sorted(v for g, v in rows if g == k and v is not None)
        assert {r: v for (g, r), v in got.items() if g == k} == {0: own[0], len(own) - 1: own[-1], 7: own[7]}


def _median(values):
    own = [v for v in values if v is not None]
    return float(np.median(own)) if own else None


def test_brackets_narrow_and_widen(spark, monkeypatch):
    """A coarse sketch and a small bound on what is gathered: more rounds, the same medians."""
    rnd = random.Random(5)
    n = 4000
    cols = {
        "even": [float(i) for i in range(n)],
        "hot": [7.0 if rnd.random() < 0.4 else rnd.gauss(7, 3) for _ in range(n)],
        "two": [rnd.choice([1.0, 2.0]) for _ in range(n)],
        "half": [1.0] * (n // 2) + [2.0] * (n // 2),
        "sorted": sorted(rnd.expovariate(1) for _ in range(n)),
        "sparse": [rnd.random() if i % 50 == 0 else None for i in range(n)],
        "one": [3.5] + [None] * (n - 1),
        "none": [None] * n,
        "tiny": [rnd.choice([-1e-300, 0.0, 5e-324, 1e300]) for _ in range(n)],
    }
    rows = list(zip(*cols.values()))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(7)
    want = {c: _median([r[i] for r in rows]) for i, c in enumerate(cols)}
    assert impute.exact_medians(df, list(cols)) == want
    for accuracy, gathered in ((20, 100_000), (20, 10), (200, 20)):
        monkeypatch.setattr(impute, "ACCURACY", accuracy)
        monkeypatch.setattr(impute, "GATHERED", gathered)
        assert impute.exact_medians(df, list(cols)) == want


def test_small_frames(spark):
    rnd = random.Random(6)
    for n in (0, 1, 2, 3, 4, 5, 8, 9):
        vals = [rnd.choice([1.0, 2.0, 2.0, rnd.random()]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
        assert impute.exact_medians(df, ["x"]) == {"x": _median(vals)}
    assert impute.exact_medians(df, []) == {}


def test_scans_and_plan(spark):
    """Two scans for columns of any number, no cell as a row, nothing stored."""
    df = spark.range(2000).selectExpr("cast(id as double) a", "cast(id % 7 as double) b", "if(id % 3 = 0, null, id / 2) c")
    seen = []
    original = type(df).agg
    try:
        type(df).agg = lambda self, *a: seen.append(original(self, *a)) or seen[-1]
        got = impute.exact_medians(df, ["a", "b", "c"])
    finally:
        type(df).agg = original
    assert got == {"a": 999.5, "b": 3.0, "c": _median([i / 2 for i in range(2000) if i % 3])}
    assert len(seen) == 2
    for agg in seen:
        plan = agg._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_counters_come_with_the_result(spark):
    from pyspark.sql import Observation
    df = spark.createDataFrame([(1, 1.0, None, "a"), (2, None, 2.0, "b"), (3, 3.0, None, None), (4, 4.0, 1.0, "d")],
                               "k int, x double, y double, s string")
    seen = Observation()
    out, med = impute.fill_with_median(df, observed=seen)
    assert sorted(r["k"] for r in out.collect()) == [1, 2, 4]
    assert seen.get == {"rows_with_nulls_before": 3, "rows_with_nulls_after": 1, "rows_dropped": 1}
    assert impute.missing_counters(df, med).first().asDict() == seen.get
