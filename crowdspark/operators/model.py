"""Forest model operators: split, expanding folds, search, fit, predict, interval, metrics.

All fitting is Spark ML (``RandomForestRegressor``); the trials of a round of the search run as
concurrent driver threads, each fit distributed over the cluster.
"""

from __future__ import annotations

import json
import math
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clip, round_half_even_int
from ..session import scratch_path
from .impute import order_statistics

LABEL = "crowd_level"
# Fixed values of the expected behaviour: the seeds of the split / search and of the forest, the
# hold-out share, and the tuned ranges.
SEARCH_SEED, FOREST_SEED, TEST_FRACTION = 104, 42, 0.2
SEARCH_SPACE = {
    "numTrees": (50, 300),
    "maxDepth": (5, 30),
    "minSplit": (2, 10),
    "minInstancesPerNode": (1, 5),
    "featureSubsetStrategy": ("sqrt", "log2"),
}
ROWS_PER_PARTITION = 20_000          # of the search's cached frame
START_TRIALS, ROUND_TRIALS = 8, 4    # of the search: trials drawn evenly, then proposed per round
CANDIDATES = 32                      # drawn for each proposal


# ----------------------------------------------------------------------------- split / folds

def holdout_split(df: DataFrame, test_fraction: float = TEST_FRACTION, seed: int = SEARCH_SEED,
                  keys=("date", "park_id")) -> DataFrame:
    """Seeded, exact hold-out: the ceil(f * n) rows with the smallest md5 of seed and keys form
    the test part (``split`` = 'test'), the rest 'train'.  The cut is an exact order statistic
    found without a global sort; rows with equal keys stay together."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    hashed = df.withColumn("_h", h)
    rank = F.array(F.ceil(F.col("total") * F.lit(test_fraction)) - 1)
    cut = order_statistics(hashed.select(F.lit(0).alias("k"), F.col("_h").alias("v")), rank).first()
    if cut is None:
        return hashed.withColumn("split", F.lit("train")).drop("_h")
    return hashed.withColumn("split", F.when(F.col("_h") <= F.lit(cut["v"]), "test").otherwise("train")).drop("_h")


def expanding_folds(df: DataFrame, n_splits: int = 5, date_col: str = "date") -> DataFrame:
    """Per day: (date, n_rows, first_row, fold).  Rows ordered by day; test size n // (k+1);
    fold j tests [n - (k-j)*t, n - (k-1-j)*t) with cuts moved to the start of their day;
    fold -1 = only ever training.  Training rows of fold j are all rows of earlier days.

    One pass over the rows; the window runs over the day dimension (one row per day).
    """
    days = df.groupBy(date_col).agg(F.count("*").alias("n_rows"))
    w = Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = (days.withColumn("first_row", F.coalesce(F.sum("n_rows").over(w), F.lit(0)))
            .withColumn("_n", F.sum("n_rows").over(whole)))
    size = F.floor(F.col("_n") / (n_splits + 1))
    fold = F.lit(-1)
    for j in range(n_splits):
        days = days.withColumn(f"_c{j}", F.max(F.when(F.col("first_row") <= F.col("_n") - (n_splits - j) * size,
                                                      F.col("first_row"))).over(whole))
        fold = F.when(F.col("first_row") >= F.col(f"_c{j}"), F.lit(j)).otherwise(fold)
    return days.select(date_col, "n_rows", "first_row", fold.alias("fold"))


# ----------------------------------------------------------------------------- fit / predict

class ForestModel(RandomForestRegressionModel):
    """A fitted forest without a Python object per tree: Spark lists a model's parameters by looking
    at all its attributes, which would make them at every fit (half of its time at 150 trees)."""

    trees = None


class Forest(RandomForestRegressor):
    def _create_model(self, java_model) -> ForestModel:
        return ForestModel(java_model)


def forest(params: dict | None = None, seed: int = FOREST_SEED) -> Forest:
    p = dict(params or {})
    return Forest(featuresCol="features", labelCol=LABEL, seed=seed,
                  numTrees=int(p.get("numTrees", 100)), maxDepth=int(p.get("maxDepth", 10)),
                  minInstancesPerNode=int(p.get("minInstancesPerNode", 1)),
                  featureSubsetStrategy=str(p.get("featureSubsetStrategy", "sqrt")),
                  bootstrap=bool(p.get("bootstrap", True)),
                  # each row keeps the id of its current node instead of the
                  # growing forest being shipped to the executors every level;
                  # lineage is at most maxDepth levels, so no extra checkpoints
                  cacheNodeIds=True, checkpointInterval=-1,
                  # all nodes of a level in one pass instead of groups of them
                  maxMemoryInMB=1024)


def without_small_splits(forest_model: RandomForestRegressionModel, least: int, spark: SparkSession) -> ForestModel:
    """The forest with every node of fewer than ``least`` training rows made a leaf.

    Spark has no such limit while growing.  Afterwards it is the same: a node's rows only get fewer
    below it, so what hangs under a small node goes, and the other nodes stay as they are.  The
    saved node table is rewritten (a node stays if it is a root or its parent is large enough,
    numbered anew in its order) and loaded."""
    source, out = scratch_path(spark, "forest-grown"), scratch_path(spark, "forest-cut")
    forest_model.write().save(source)
    nodes = spark.read.parquet(f"{source}/data").select("treeID", "nodeData.*")
    large = (F.col("leftChild") >= 0) & (F.col("rawCount") >= least)
    children = nodes.where(large).select("treeID", F.explode(F.array("leftChild", "rightChild")).alias("id"))
    kept = nodes.where("id = 0").unionByName(nodes.join(children, ["treeID", "id"], "left_semi"))
    number = (F.row_number().over(Window.partitionBy("treeID").orderBy("id")) - 1).cast("int")
    kept = kept.withColumn("new", number).withColumn("inner", large)
    place = kept.select("treeID", "id", "new")
    for side in ("left", "right"):
        kept = kept.join(place.select("treeID", F.col("id").alias(f"{side}Child"), F.col("new").alias(side)),
                         ["treeID", f"{side}Child"], "left")
    no_split = F.struct(F.lit(-1).alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"),
                        F.lit(-1).alias("numCategories"))

    def if_inner(column: Column, leaf: Column) -> Column:
        return F.when(F.col("inner"), column).otherwise(leaf)

    kept.select("treeID", F.struct(
        F.col("new").alias("id"), "prediction", "impurity", "impurityStats", "rawCount",
        if_inner(F.col("gain"), F.lit(-1.0)).alias("gain"), if_inner(F.col("left"), F.lit(-1)).alias("leftChild"),
        if_inner(F.col("right"), F.lit(-1)).alias("rightChild"), if_inner(F.col("split"), no_split).alias("split")
    ).alias("nodeData")).write.parquet(f"{out}/data")
    spark.read.parquet(f"{source}/treesMetadata").write.parquet(f"{out}/treesMetadata")
    spark.read.text(f"{source}/metadata").write.text(f"{out}/metadata")
    return ForestModel(spark._jvm.org.apache.spark.ml.regression.RandomForestRegressionModel.load(out))


def grow(data: DataFrame, params: dict | None = None, seed: int = FOREST_SEED) -> ForestModel:
    """A forest fitted on (features, label) with ``params``; ``minSplit`` rows are needed to split."""
    fitted = forest(params, seed).fit(data)
    least = int((params or {}).get("minSplit", 2))
    return fitted if least <= 2 else without_small_splits(fitted, least, data.sparkSession)


def cast_features(df: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Booleans / ints -> DOUBLE so the assembler sees numbers."""
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) if c in feature_cols else F.col(f"`{c}`")
                       for c in df.columns])


def fit_forest(df: DataFrame, feature_cols: list[str], params: dict | None = None, seed: int = FOREST_SEED) -> PipelineModel:
    asm = VectorAssembler(inputCols=feature_cols, outputCol="features", handleInvalid="error")
    return PipelineModel([asm, grow(asm.transform(cast_features(df, feature_cols + [LABEL])), params, seed)])


def predict(model: PipelineModel, df: DataFrame, feature_cols: list[str], out: str = "prediction") -> DataFrame:
    """Forest prediction, half-even rounded to an int (extra columns pass through)."""
    p = model.transform(cast_features(df, feature_cols))
    return p.withColumn(out, round_half_even_int("prediction")).drop("features")


def regression_metrics(df: DataFrame, label: str = LABEL, pred: str = "prediction") -> DataFrame:
    """One row: mse, rmse, r2, mae (single pass).  Constant labels have no variance to explain:
    r2 is 1 when the predictions are exact, else 0; without rows all are NULL."""
    e = F.col(pred).cast("double") - F.col(label).cast("double")
    g = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(F.col(label).cast("double")).alias("var"))
    r2 = (F.when(F.col("var") > 0, F.lit(1.0) - F.try_divide("mse", "var"))
          .when(F.col("var").isNotNull(), F.when(F.col("mse") == 0, 1.0).otherwise(0.0)))
    return g.select("mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"), "mae")


# ----------------------------------------------------------------------------- search

def draw_params(rnd: random.Random) -> dict:
    """One set of parameters, uniformly from the ranges."""
    return {name: rnd.randint(*space) if isinstance(space[0], int) else rnd.choice(space)
            for name, space in SEARCH_SPACE.items()}


def sample_params(n_iter: int, seed: int = SEARCH_SEED) -> list[dict]:
    """The sets of parameters a search starts from."""
    rnd = random.Random(seed)
    return [draw_params(rnd) for _ in range(n_iter)]


def density(value, seen: list, space: tuple) -> float:
    """How often ``value`` is to be expected among values like ``seen``.

    A range of integers: the mean of normal curves around the seen values, each over the range
    itself, and of one even share over it; the curves get narrower the more is seen.  Names: the
    shares seen, each counted once more."""
    if not isinstance(space[0], int):
        return (seen.count(value) + 1) / (len(seen) + len(space))
    low, high = space
    even = 1 / (high - low + 1)
    width = max(1.0, (high - low) * (len(seen) + 1) ** -0.5 / 2)

    def bell(centre: int) -> float:
        def upto(x: float) -> float:
            return math.erf((x - centre) / (width * math.sqrt(2)))
        return (upto(value + 0.5) - upto(value - 0.5)) / (upto(high + 0.5) - upto(low - 0.5))

    return (even + sum(bell(c) for c in seen)) / (len(seen) + 1)


def propose(seen: list[tuple[dict, float]], rnd: random.Random, candidates: int = CANDIDATES) -> dict:
    """The next set of parameters to try: of ``candidates`` drawn ones, the one whose values stand
    out most among the best quarter of the trials seen against the others (the ratio of their
    densities).  ``seen``: (parameters, score, lower is better)."""
    ranked = [p for p, _ in sorted(seen, key=lambda t: t[1])]
    cut = -(-len(ranked) // 4)
    good, rest = ranked[:cut], ranked[cut:]

    def gain(p: dict) -> float:
        return sum(math.log(density(p[k], [g[k] for g in good], space) / density(p[k], [r[k] for r in rest], space))
                   for k, space in SEARCH_SPACE.items())

    drawn = []
    for _ in range(candidates):
        p = draw_params(rnd)
        if good and rnd.random() < 0.75:            # near one of the good ones, part by part
            near = rnd.choice(good)
            for k, space in SEARCH_SPACE.items():
                if isinstance(space[0], int):
                    step = round(rnd.gauss(0, max(1.0, (space[1] - space[0]) / 8)))
                    p[k] = min(max(near[k] + step, space[0]), space[1])
                else:
                    p[k] = near[k]
        drawn.append(p)
    return max(drawn, key=gain)


def next_round(seen: list[tuple[dict, float]], size: int, seed: int = SEARCH_SEED) -> list[dict]:
    """The sets of parameters of the next round, made to differ: each counts as a poor trial for
    those behind it.  Depends on nothing but ``seen`` and ``seed``."""
    rnd = random.Random(seed * 1_000_003 + len(seen))
    known = [t for t in seen if t[1] is not None]
    out: list[dict] = []
    for _ in range(size):
        out.append(propose(known + [(p, math.inf) for p in out], rnd))
    return out


def _cut_predictions(fitted: ForestModel, rows: DataFrame, least: int) -> DataFrame:
    """(label, prediction) as ``without_small_splits`` predicts, by the leaves' values alone: no
    other model is made for one use."""
    if least <= 2:
        return fitted.transform(rows)
    path = scratch_path(rows.sparkSession, "forest-tried")
    fitted.write().save(path)
    rf = fitted.copy()
    rf.setLeafCol("leaves")
    trees = tree_predictions(vector_to_array("leaves"), leaf_values(rows.sparkSession, f"{path}/data", least))
    return rf.transform(rows).select(LABEL, tree_band(trees)["mean"].alias("prediction"))


def search(spark: SparkSession, df: DataFrame, feature_cols: list[str], n_iter: int = 20, n_splits: int = 5,
           seed: int = SEARCH_SEED, parallelism: int = 8, start: int = START_TRIALS, per_round: int = ROUND_TRIALS) -> DataFrame:
    """Seeded sequential search over expanding day folds; score = mean fold MSE (lower is better).

    The first ``start`` trials are drawn evenly from the ranges; then each round proposes
    ``per_round`` trials from the scores of all rounds before it (``propose``) and fits them
    together: every (trial, fold) fit of a round is one task of a pool.  The features are
    assembled once and cached in partitions sized to the rows.  A fold without training or without
    test rows (few days, or one day with most rows) is left out for every trial and shows in
    ``folds``; with no fold left the scores are NULL and all trials are drawn as at the start.
    One row per trial: trial, parameters, folds, mean_mse, rank, in the order they were tried.
    """
    days = expanding_folds(df, n_splits)
    asm = VectorAssembler(inputCols=feature_cols, outputCol="features", handleInvalid="error")
    data = asm.transform(cast_features(df.join(days.select("date", "fold"), "date"), feature_cols + [LABEL])).select(
        "fold", "features", LABEL)
    sizes = {r["fold"]: r["n"] for r in days.groupBy("fold").agg(F.sum("n_rows").alias("n")).collect()}
    usable = [j for j in range(n_splits) if sizes.get(j, 0) and sum(n for f, n in sizes.items() if f < j)]
    data = data.repartition(max(1, -(-sum(sizes.values()) // ROWS_PER_PARTITION))).cache()

    def score(job):
        p, j = job
        fitted = forest(p).fit(data.where(F.col("fold") < j))
        return regression_metrics(_cut_predictions(fitted, data.where(F.col("fold") == j), p["minSplit"])).first()["mse"]

    seen: list[tuple[dict, float | None]] = []
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        while len(seen) < n_iter:
            size = min(start if not seen else per_round, n_iter - len(seen))
            trials = sample_params(size, seed) if not seen else next_round(seen, size, seed)
            jobs = [(i, p, j) for i, p in enumerate(trials) for j in usable]
            # the largest forests first, so that none of them runs alone at the end
            jobs.sort(key=lambda job: -job[1]["numTrees"] * job[1]["maxDepth"])
            done = list(pool.map(score, [job[1:] for job in jobs]))
            own = [[(job[2], mse) for job, mse in zip(jobs, done) if job[0] == i] for i in range(size)]
            seen += [(p, sum(m for _, m in sorted(o)) / len(o) if o else None) for p, o in zip(trials, own)]
    data.unpersist()
    rows = [(i, *(p[k] for k in SEARCH_SPACE), len(usable), None if mse is None else float(mse)) for i, (p, mse) in enumerate(seen)]
    res = spark.createDataFrame(rows, "trial int, numTrees int, maxDepth int, minSplit int, minInstancesPerNode int, "
                                      "featureSubsetStrategy string, folds int, mean_mse double")
    return res.withColumn("rank", F.rank().over(Window.orderBy(F.col("mean_mse").asc_nulls_last(), "trial")))


# ----------------------------------------------------------------------------- interpretation

def top_features(df: DataFrame, top_n: int = 10) -> DataFrame:
    """Of (feature, importance) the ``top_n`` largest (ties by name), ascending for display."""
    return df.orderBy(F.desc("importance"), "feature").limit(top_n).orderBy("importance", "feature")


def importances(spark: SparkSession, model: PipelineModel, feature_cols: list[str], top_n: int = 10) -> DataFrame:
    """Top-N features of a fitted forest by importance."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(feature_cols, [float(x) for x in imp])), "feature string, importance double")
    return top_features(df, top_n)


def leaf_values(spark: SparkSession, nodes_path: str, least: int = 2) -> list[list[float]]:
    """For each tree of a saved node table the values of its leaves in node-id order, which is the
    numbering of the ``leafCol`` output.  With ``least``, the value of the topmost node above a leaf
    that has fewer training rows, as if it had not been split (``without_small_splits``).  The
    driver reads the nodes of the forest, which it holds as the model anyway."""
    nodes = spark.read.parquet(nodes_path).select("treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild",
                                                  "nodeData.rawCount", "nodeData.prediction")
    trees: dict[int, list] = {}
    for r in sorted(map(tuple, nodes.collect())):
        trees.setdefault(r[0], []).append(r)
    out = []
    for _, tree in sorted(trees.items()):
        values, above = [], {}                      # above: what a node below a small one is worth
        for _, node, left, right, rows, value in tree:
            value = above.get(node, value)
            if left < 0:
                values.append(value)
            elif node in above or rows < least:
                above[left] = above[right] = value
        out.append(values)
    return out


def tree_predictions(leaves: Column, values: list[list[float]]) -> Column:
    """Each tree's prediction as an array, from the array of leaf numbers of a row.  The table of
    leaf values is one constant of the plan: no row per tree, no join."""
    table = F.from_json(F.lit(json.dumps(values)), "array<array<double>>")
    return F.transform(leaves, lambda leaf, tree: F.element_at(F.element_at(table, tree + 1), leaf.cast("int") + 1))


def tree_band(predictions: Column) -> Column:
    """(mean, std) of an array: the mean as the sum in order over the number, which is how the
    forest averages its trees, and the population standard deviation by running updates."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("m2"), F.lit(0).alias("n"))

    def add(acc, x):
        total, n = acc["sum"] + x, acc["n"] + 1
        m2 = F.when(acc["n"] == 0, F.lit(0.0)).otherwise(acc["m2"] + (x - acc["sum"] / acc["n"]) * (x - total / n))
        return F.struct(total.alias("sum"), m2.alias("m2"), n.alias("n"))

    return F.aggregate(predictions, start, add, lambda acc: F.struct(
        F.try_divide(acc["sum"], acc["n"]).alias("mean"), F.sqrt(F.try_divide(acc["m2"], acc["n"])).alias("std")))


def _band_columns(mean: Column, std: Column) -> list[Column]:
    return [mean.alias("mean_pred"), round_half_even_int(mean).alias("crowd_level"),
            round_half_even_int(clip(mean - std)).alias("ci_lower"), round_half_even_int(clip(mean + std)).alias("ci_upper")]


def interval(per_tree: DataFrame, keys=("date", "park_id")) -> DataFrame:
    """From (keys, tree_prediction): mean of the trees +/- their population standard deviation,
    clipped to 0..100 and half-even rounded, with the unrounded mean."""
    g = per_tree.groupBy(*keys).agg(F.avg("tree_prediction").alias("_mean"), F.stddev_pop("tree_prediction").alias("_std"))
    return g.select(*keys, *_band_columns(F.col("_mean"), F.col("_std")))


def interval_in_row(rows: DataFrame, predictions: Column, keys=("date", "park_id")) -> DataFrame:
    """``interval`` where each row holds its trees' predictions as an array: a projection."""
    banded = rows.select(*keys, tree_band(predictions).alias("_band"))
    return banded.select(*keys, *_band_columns(F.col("_band.mean"), F.col("_band.std")))


def ensemble_interval(spark: SparkSession, model: PipelineModel, model_path: str, df: DataFrame,
                      feature_cols: list[str], keys=("date", "park_id")) -> DataFrame:
    """``interval`` of every tree's prediction for each row of ``df``.

    The forest says which leaf of each tree a row reaches; the leaves' values are looked up in the
    row.  The plan is a projection of ``df``: no exchange, and no row per tree."""
    rf = model.stages[-1].copy()
    rf.setLeafCol("leaves")
    x = rf.transform(model.stages[0].transform(cast_features(df, feature_cols)))
    values = leaf_values(spark, f"{model_path}/stages/*_{model.stages[-1].uid}/data")
    return interval_in_row(x, tree_predictions(vector_to_array("leaves"), values), keys)


def save_model(model: PipelineModel, path: str) -> str:
    """Overwrite-save; the ordered feature list lives in the assembler stage."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> tuple[PipelineModel, list[str]]:
    m = PipelineModel.load(path)
    return m, list(m.stages[0].getInputCols())


def load_model_or_error(path: str) -> tuple[PipelineModel | None, list[str] | None, str | None]:
    """For interactive callers: (model, features, None), or (None, None, message) when the
    model or its feature list cannot be read, instead of raising."""
    try:
        m, cols = load_model(path)
        return m, cols, None
    except Exception as e:  # noqa: BLE001 - the message is the result
        return None, None, f"Model could not be loaded from {path}: {type(e).__name__}"
