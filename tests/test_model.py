"""Model operators: split sizes, folds, interval invariants, round trip, report tie-breaks."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from crowdspark.operators import model, report
from crowdspark.plans.frames import RunParams, inference_days, inference_frame, model_features, training_frame
from crowdspark.session import scratch_path

from .conftest import SF001

D = dt.date


@pytest.fixture(scope="module")
def frames(spark):
    p = RunParams()
    tf = training_frame(spark, SF001, p).cache()
    inf = inference_frame(spark, SF001, inference_days(spark, SF001, p), p).cache()
    return tf, inf, model_features(tf)


def test_holdout_exact_size(spark, frames):
    tf, _, _ = frames
    n = tf.count()
    s = model.holdout_split(tf)
    assert s.where("split = 'test'").count() == math.ceil(0.2 * n)
    assert s.count() == n
    again = model.holdout_split(tf)
    assert sorted(r["date"] for r in s.where("split='test'").collect()) == \
        sorted(r["date"] for r in again.where("split='test'").collect())


def test_expanding_folds_cut_at_day_starts(spark, frames):
    tf, _, _ = frames
    folds = model.expanding_folds(tf).orderBy("date").collect()
    n = sum(r["n_rows"] for r in folds)
    t = n // 6
    seq = [r["fold"] for r in folds]
    assert seq == sorted(seq) and set(seq) <= {-1, 0, 1, 2, 3, 4}
    for j in range(5):                       # fold j starts at the day holding row n-(5-j)*t
        cut = n - (5 - j) * t
        start = max(r["first_row"] for r in folds if r["first_row"] <= cut)
        assert all((r["fold"] >= j) == (r["first_row"] >= start) for r in folds)


def test_interval_invariants_and_roundtrip(spark, frames):
    tf, inf, feats = frames
    m = model.fit_forest(tf, feats, {"numTrees": 12, "maxDepth": 6})
    path = model.save_model(m, scratch_path(spark, "forest-test"))
    from crowdspark.operators.encode import align_columns
    x = align_columns(inf, feats, keep=["date", "park_id"])
    iv = model.ensemble_interval(spark, m, path, x, feats)
    pred = model.predict(m, x, feats).select("date", "park_id", F.col("prediction").alias("p"),
                                             F.col("prediction").alias("_"))
    raw = m.transform(model.cast_features(x, feats)).select("date", "park_id", F.col("prediction").alias("raw"))
    rows = iv.join(raw, ["date", "park_id"]).collect()
    assert rows and len(rows) == x.count()
    for r in rows:
        assert abs(r["mean_pred"] - r["raw"]) < 1e-9            # mean of trees = forest prediction
        assert 0 <= r["ci_lower"] <= r["crowd_level"] <= r["ci_upper"] <= 100
    loaded, cols = model.load_model(path)
    assert cols == feats
    a = {(r["date"], r["park_id"]): r["prediction"] for r in model.predict(loaded, x, cols).collect()}
    b = {(r["date"], r["park_id"]): r["p"] for r in pred.collect()}
    assert a == b


def test_band_of_a_hand_walked_forest(spark, frames):
    """Mean and sigma of every tree's own walk from root to leaf; one projection, no row per tree."""
    import numpy as np
    tf, inf, feats = frames
    m = model.fit_forest(tf, feats, {"numTrees": 25, "maxDepth": 8})
    path = model.save_model(m, scratch_path(spark, "forest-walk"))
    from crowdspark.operators.encode import align_columns
    x = model.cast_features(align_columns(inf, feats, keep=["date", "park_id"]), feats)
    trees = {}
    for r in spark.read.parquet(f"{path}/stages/*_{m.stages[-1].uid}/data").collect():
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]

    def walk(tree, row):
        node = tree[0]
        while node["leftChild"] >= 0:
            at = node["split"]
            assert at["numCategories"] == -1
            node = tree[node["leftChild"] if row[feats[at["featureIndex"]]] <= at["leftCategoriesOrThreshold"][0]
                        else node["rightChild"]]
        return node["prediction"]

    banded = model.ensemble_interval(spark, m, path, x, feats)
    plan = banded._jdf.queryExecution().executedPlan().toString()
    for word in ("Exchange", "Generate", "Join"):
        assert word not in plan.split("InMemoryRelation")[0]
    got = {(r["date"], r["park_id"]): r for r in banded.collect()}
    rows = x.collect()
    assert len(rows) == len(got) > 0
    for row in rows:
        own = [walk(trees[t], row) for t in sorted(trees)]
        mean, std = float(np.mean(own)), float(np.std(own))
        r = got[row["date"], row["park_id"]]
        assert r["mean_pred"] == pytest.approx(mean, abs=1e-9)
        assert (r["ci_lower"], r["crowd_level"], r["ci_upper"]) == (
            round(min(max(mean - std, 0), 100)), round(mean), round(min(max(mean + std, 0), 100)))


def test_min_split_is_a_limit_of_growing(spark, frames):
    """Without small splits: each tree, walked by hand, stops where the grown one has too few rows."""
    tf, _, feats = frames
    grown = model.fit_forest(tf, feats, {"numTrees": 6, "maxDepth": 8})
    x = grown.stages[0].transform(model.cast_features(tf, feats)).select("date", "park_id", "features").cache()

    def nodes(forest):
        path = scratch_path(spark, "forest-nodes")
        forest.write().overwrite().save(path)
        out = {}
        for r in spark.read.parquet(f"{path}/data").collect():
            out.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
        return out

    def walk(tree, v, least):
        node = tree[0]
        while node["leftChild"] >= 0 and node["rawCount"] >= least:
            s = node["split"]
            node = tree[node["leftChild"] if v[s["featureIndex"]] <= s["leftCategoriesOrThreshold"][0] else node["rightChild"]]
        return node["prediction"]

    whole = nodes(grown.stages[-1])
    for least in (5, 20, 10_000):
        cut = model.without_small_splits(grown.stages[-1], least, spark)
        small = nodes(cut)
        assert all(n["rawCount"] >= least for t in small.values() for n in t.values() if n["leftChild"] >= 0)
        lean = model._cut_predictions(grown.stages[-1], x.withColumn("crowd_level", F.lit(0.0)), least).collect()
        assert sorted(r["prediction"] for r in lean) == pytest.approx(sorted(r["prediction"] for r in cut.transform(x).collect()))
        assert cut.getNumTrees == 6 and (least < 10_000 or cut.totalNumNodes == 6)
        for r in cut.transform(x).collect():
            want = [walk(whole[t], r["features"], least) for t in sorted(whole)]
            assert r["prediction"] == pytest.approx(sum(want) / len(want), abs=1e-9)
    fitted = model.fit_forest(tf, feats, {"numTrees": 6, "maxDepth": 8, "minSplit": 20})
    again = model.without_small_splits(grown.stages[-1], 20, spark)
    assert fitted.stages[-1].totalNumNodes == again.totalNumNodes


def test_tree_band_by_value(spark):
    df = spark.createDataFrame([(1, [3.0, 5.0, 10.0]), (2, [4.0]), (3, []), (4, [1e9 + 1, 1e9 + 2])], "k int, t array<double>")
    got = {r["k"]: r["b"] for r in df.select("k", model.tree_band(F.col("t")).alias("b")).collect()}
    assert (got[1]["mean"], got[1]["std"]) == (6.0, pytest.approx(math.sqrt(26 / 3)))
    assert (got[2]["mean"], got[2]["std"]) == (4.0, 0.0)
    assert (got[3]["mean"], got[3]["std"]) == (None, None)
    assert got[4]["std"] == pytest.approx(0.5, abs=1e-6)


def test_densities_of_seen_values():
    """Against the textbook form: normal curves cut to the range, mixed with an even share."""
    space = (5, 30)
    seen = [7, 7, 20]
    width = max(1.0, 25 * 4 ** -0.5 / 2)

    def normal(x, c):
        return (1 + math.erf((x - c) / width / 2 ** 0.5)) / 2

    for v in range(5, 31):
        bells = [(normal(v + .5, c) - normal(v - .5, c)) / (normal(30.5, c) - normal(4.5, c)) for c in seen]
        assert model.density(v, seen, space) == pytest.approx((1 / 26 + sum(bells)) / 4)
    assert sum(model.density(v, seen, space) for v in range(5, 31)) == pytest.approx(1)
    assert model.density("sqrt", ["sqrt", "sqrt", "log2"], ("sqrt", "log2")) == 3 / 5


def _known(p):
    """A known function of the parameters: best at 250 trees, depth 9, 2 rows a leaf, log2."""
    return (((p["numTrees"] - 250) / 250) ** 2 + ((p["maxDepth"] - 9) / 25) ** 2 + ((p["minInstancesPerNode"] - 2) / 4) ** 2
            + 0.2 * (p["featureSubsetStrategy"] != "log2"))


def _sequential(seed, rounds=3):
    seen = [(p, _known(p)) for p in model.sample_params(8, seed)]
    for _ in range(rounds):
        seen += [(p, _known(p)) for p in model.next_round(seen, 4, seed)]
    return seen


def test_the_proposal_is_the_best_ratio_of_its_candidates():
    import random
    seen = [(p, _known(p)) for p in model.sample_params(8, 5)]
    ranked = [p for p, _ in sorted(seen, key=lambda t: t[1])]

    def ratio(p):
        out = 1.0
        for k, space in model.SEARCH_SPACE.items():
            out *= model.density(p[k], [r[k] for r in ranked[:2]], space) / model.density(p[k], [r[k] for r in ranked[2:]], space)
        return out

    chosen = [model.propose(seen, random.Random(i), n) for i in range(20) for n in (1, 32)]
    for one, best in zip(chosen[::2], chosen[1::2]):        # the first candidate of the same draw
        assert ratio(best) >= ratio(one)


def test_sequential_search_repeats_and_learns():
    assert _sequential(3) == _sequential(3)
    better = even = 0.0
    for seed in range(40):
        seen = _sequential(seed)
        assert all(p[k] in s if isinstance(s[0], str) else s[0] <= p[k] <= s[1]
                   for p, _ in seen for k, s in model.SEARCH_SPACE.items())
        better += min(v for _, v in seen)
        even += min(_known(p) for p in model.sample_params(20, seed))
    assert better < 0.8 * even                      # of 20 trials, summed over 40 seeds


def test_metrics_and_importances(spark, frames):
    tf, _, feats = frames
    m = model.fit_forest(tf, feats, {"numTrees": 8, "maxDepth": 4})
    imp = model.importances(spark, m, feats, top_n=5).collect()
    vals = [r["importance"] for r in imp]
    assert len(vals) == 5 and vals == sorted(vals)
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "crowd_level double, prediction double")
    r = model.regression_metrics(df).first()
    assert r["mse"] == pytest.approx(2 / 3) and r["mae"] == pytest.approx(2 / 3)
    assert r["r2"] == pytest.approx(1 - 2 / 8)


def test_search_ranks_trials(spark, frames):
    tf, _, feats = frames
    res = model.search(spark, tf, feats, n_iter=3, n_splits=2, parallelism=4, start=2, per_round=1).orderBy("trial").collect()
    assert sorted(r["rank"] for r in res) == [1, 2, 3] and [r["folds"] for r in res] == [2, 2, 2]
    names = list(model.SEARCH_SPACE)
    seen = [({k: r[k] for k in names}, r["mean_mse"]) for r in res]
    assert [p for p, _ in seen] == model.sample_params(2) + model.next_round(seen[:2], 1)
    assert all(50 <= r["numTrees"] <= 300 and 5 <= r["maxDepth"] <= 30 for r in res)


def test_summary_ties_to_earliest_day(spark):
    p = spark.createDataFrame([("1", D(2024, 1, 3), 10), ("1", D(2024, 1, 1), 10), ("1", D(2024, 1, 2), 90),
                               ("1", D(2024, 1, 4), 90), ("1", D(2024, 1, 5), 41)],
                              "park_id string, date date, crowd_level int")
    r = report.forecast_summary(p).first()
    assert (r["mean_level"], r["peak_level"], r["peak_minus_mean"]) == (48, 90, 42)
    assert (r["quietest_day"], r["busiest_day"]) == ("Mon 01 Jan", "Tue 02 Jan")


def test_metrics_of_constant_labels_and_no_rows(spark):
    df = spark.createDataFrame([(4.0, 4.0), (4.0, 4.0)], "crowd_level double, prediction double")
    assert model.regression_metrics(df).first()["r2"] == 1.0
    off = df.selectExpr("crowd_level", "prediction + 1 as prediction")
    assert model.regression_metrics(off).first()["r2"] == 0.0
    assert model.regression_metrics(df.where("false")).first().asDict() == {"mse": None, "rmse": None, "r2": None, "mae": None}


def test_search_leaves_out_empty_folds(spark):
    rows = [(D(2024, 1, 1), "1", float(i % 3), i % 5) for i in range(20)] + [(D(2024, 1, 2), "1", 1.0, 3)] * 4
    df = spark.createDataFrame(rows, "date date, park_id string, x double, crowd_level int")
    res = model.search(spark, df, ["x"], n_iter=1, parallelism=1).collect()
    assert res[0]["folds"] <= 1
    one_day = df.where("date = '2024-01-01'")
    assert model.search(spark, one_day, ["x"], n_iter=1).first()["mean_mse"] is None


def test_medians_of_the_training_part(spark):
    """fit_on='train' takes the medians from the training rows alone."""
    from crowdspark.operators import impute
    from crowdspark.plans.frames import training_plan
    from crowdspark.schema import FEATURE_COLS
    _, medians = training_frame(spark, SF001, RunParams(fit_on="train"), return_medians=True)
    rows = training_plan(spark, SF001, RunParams()).select("date", "park_id", *FEATURE_COLS)
    train = model.holdout_split(rows).where("split = 'train'")
    assert medians == impute.exact_medians(train, list(medians))
