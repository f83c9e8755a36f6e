"""Registered queries: composed frames, folds, model operators, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import round_half_even_int, round_to
from ..operators import encode, model
from ..schema import DAY_OF_WEEK_COLS, MONTH_COLS, WEATHER_COLS
from ..session import materialise, scratch_path
from ..sources import inputs, landed
from . import oracle_views as V
from .frames import RunParams, as_inputs, inference_days, inference_frame, model_features, training_frame
from .output import as_report
from .queries_features import _HIST, _SCHED, orders_levels
from .queries_ingest import _ALIGN
from .registry import register

P = RunParams(horizon_days=13)
MISSING_PARK, SHORT_PARK, SHORT_DAYS = "3", "2", 6      # forecasts of the mapping: none, and one that ends early
_EVENT_PARKS = ["1", "2", "3"]

_DOW = ", ".join(f"coalesce(isodow(x.date) - 1 = {i - 1}, false) as day_of_week_{i}" for i in range(1, 8))
_MON = ", ".join(f"coalesce(month(x.date) = {i}, false) as month_{i}" for i in range(1, 13))
_ONE_HOT = ", ".join(f"coalesce(cast(park_id = '{p}' as integer), 0) as park_{p}" for p in sorted(_EVENT_PARKS))
_FEATURES = ", ".join(DAY_OF_WEEK_COLS + MONTH_COLS + ["is_bank_holiday", "is_school_holiday",
                                                       "opening_hr", "closing_hr", "hours_open_for"])

_STORED = [V.R_E, V.P_E, "src as (select id, date, ride_id, ts, queue_time, is_closed from r_e)", _ALIGN,
           "stored as (select date, ride_id, strftime(slot, '%H:%M') as time_of_day, queue_time, is_closed from aligned)",
           V.LEVELS_O.replace("r_o", "stored").replace("p_o", "p_e"),
           V.COUNTRY, V.PUBLIC_HOLIDAYS, V.SCHOOL_DAYS,
           _HIST.replace("from r_e r", "from stored r"), _SCHED, V.W_E]


def _features_sql(frame: str) -> str:
    """Feature steps over the CTE ``frame`` (date, park_id) up to weather-less ``opened``."""
    return f"""base as (
  select x.date, x.park_id, {_DOW}, {_MON},
         coalesce(ph.country_code is not null, false) as is_bank_holiday,
         coalesce(sd.country is not null, false) as is_school_holiday,
         case when h.park_id is not null then h.opening_time else s.opening_time end as ot,
         case when h.park_id is not null then h.closing_time else s.closing_time end as ct
  from {frame} x
  left join park_country pc on pc.park_id = x.park_id
  left join public_holidays ph on ph.country_code = pc.alpha2 and ph.date = x.date
  left join directory d on d.park_id = x.park_id
  left join school_days sd on sd.country = d.country and sd.date = x.date
  left join hist h on h.park_id = x.park_id and h.date = x.date
  left join sched_last s on s.park_id = x.park_id and s.date = x.date),
feat as (
  select *, try_cast(split_part(ot, ':', 1) as integer) as o, try_cast(split_part(ct, ':', 1) as integer) as c from base),
opened as (
  select * exclude (ot, ct, o, c), o as opening_hr, c as closing_hr, c - o as hours_open_for
  from feat where o is not null and c is not null)"""


_FILL = ",\n".join([V.median_cte("m_t", "wx", "temperature_c"), V.median_cte("m_p", "wx", "precipitation_mm"),
                     V.median_cte("m_w", "wx", "wind_speed_kmh")]) + """,
med as (select m_t.m as mt, m_p.m as mp, m_w.m as mw from m_t, m_p, m_w),
final as (
  select wx.* replace (coalesce(temperature_c, mt) as temperature_c, coalesce(precipitation_mm, mp) as precipitation_mm,
                       coalesce(wind_speed_kmh, mw) as wind_speed_kmh)
  from wx, med
  where coalesce(temperature_c, mt) is not null and coalesce(precipitation_mm, mp) is not null
    and coalesce(wind_speed_kmh, mw) is not null)"""

_WX_ROUND = ", ".join(f"{V.r6(c)} as {c}" for c in WEATHER_COLS)

TRAINING_SQL = V.with_ctes(*_STORED, "lvl as (select date, park_id from levels)", _features_sql("lvl"), """wx as (
  select o.*, w.tavg as temperature_c, w.prcp as precipitation_mm, w.wspd as wind_speed_kmh
  from opened o left join w_e w on w.park_id = o.park_id and w.date = o.date)""", _FILL) + f"""
select cast(date as varchar) as date, park_id, {_FEATURES}, {_WX_ROUND}, crowd_level, {_ONE_HOT}
from (select f.*, l.crowd_level from final f left join levels l on l.date = f.date and l.park_id = f.park_id)"""

_AS = f"date '{P.as_of}'"
INFERENCE_SQL = V.with_ctes(*_STORED, f"""req as (
  select p.park_id, cast(unnest(generate_series({_AS}, {_AS} + {P.horizon_days}, interval 1 day)) as date) as date
  from (select distinct park_id from p_e) p)""", _features_sql("req"), f"""fc as (
  select * from w_e where date between {_AS} and {_AS} + 16 and park_id <> '{MISSING_PARK}'
     and not (park_id = '{SHORT_PARK}' and date > {_AS} + {SHORT_DAYS})),
fc_end as (select park_id, max(date) as fc_end from fc group by 1),
clim as (
  select park_id, month(date) as month, avg(tavg) as t, avg(prcp) as p, avg(wspd) as w from w_e
  where year(date) between year({_AS}) - 5 and year({_AS}) - 1 group by 1, 2),
wx as (
  select o.*,
    case when e.fc_end is not null and o.date <= e.fc_end then f.tavg else c.t end as temperature_c,
    case when e.fc_end is not null and o.date <= e.fc_end then f.prcp else c.p end as precipitation_mm,
    case when e.fc_end is not null and o.date <= e.fc_end then f.wspd else c.w end as wind_speed_kmh
  from opened o left join fc_end e on e.park_id = o.park_id
  left join fc f on f.park_id = o.park_id and f.date = o.date
  left join clim c on c.park_id = o.park_id and c.month = month(o.date))""", _FILL) + f"""
select cast(date as varchar) as date, park_id, {_FEATURES}, {_WX_ROUND}, {_ONE_HOT} from final"""


def inference(spark, source):
    data = as_inputs(spark, source)
    return inference_frame(spark, data, inference_days(spark, data, P), P)


def _rounded(df):
    return df.select(*[round_to(c).alias(c) if c in WEATHER_COLS else F.col(c) for c in df.columns])


@register("training_frame", TRAINING_SQL)
def training_frame_q(spark, sf_dir):
    """L11 C2 B8 A13 (+ every feature step): the model's training rows with target."""
    return as_report(_rounded(training_frame(spark, sf_dir, P)))


@register("inference_frame", INFERENCE_SQL)
def inference_frame_q(spark, sf_dir):
    """Horizon days x parks with forecast / climatology weather, batch medians."""
    return as_report(_rounded(inference(spark, sf_dir)))


def _folder(spark, sf_dir):
    """The mapped inputs written as stored tables and JSON documents, and read from there."""
    path = scratch_path(spark, "inputs")
    inputs.export_folder(spark, inputs.from_tables(spark, sf_dir), path, P.as_of)
    return inputs.from_folder(spark, path)


@register("training_frame_folder", TRAINING_SQL)
def training_frame_folder(spark, sf_dir):
    """The training rows from ingested tables and JSON documents in a folder."""
    return as_report(_rounded(training_frame(spark, _folder(spark, sf_dir), P)))


@register("inference_frame_folder", INFERENCE_SQL)
def inference_frame_folder(spark, sf_dir):
    """The inference rows from ingested tables and JSON documents in a folder."""
    return as_report(_rounded(inference(spark, _folder(spark, sf_dir))))


@register("expanding_folds", V.with_ctes("tf as (" + TRAINING_SQL + ")", """days as (
  select date, count(*) as n_rows from tf group by 1),
pos as (
  select date, n_rows,
         cast(coalesce(sum(n_rows) over (order by date rows between unbounded preceding and 1 preceding), 0) as bigint) as first_row
  from days),
tot as (select sum(n_rows) as n from days),
cuts as (select j, n - (5 - j) * (n // 6) as c from tot, range(5) t(j)),
moved as (select j, (select max(first_row) from pos where first_row <= c) as m from cuts)""") + """
select date, n_rows, first_row,
       cast(coalesce((select max(j) from moved where m is not null and pos.first_row >= m), -1) as integer) as fold
from pos""")
def expanding_folds(spark, sf_dir):
    """Five expanding time folds cut at day boundaries (day index, not row window)."""
    return as_report(model.expanding_folds(training_frame(spark, sf_dir, P)))


# md5 of seed and keys in order: the ceil(0.2 n) first rows are the test part
_SPLIT = """hashed as (
  select *, md5(concat_ws('|', '104', date, park_id)) as h from tf),
split as (
  select *, case when h <= (select h from hashed order by h limit 1 offset (select cast(ceil(count(*) * 0.2) as bigint) - 1 from hashed))
                 then 'test' else 'train' end as split from hashed)"""


@register("holdout_split", V.with_ctes("tf as (" + TRAINING_SQL + ")", _SPLIT) + """
select date, park_id, split from split""")
def holdout_split(spark, sf_dir):
    """L2: seeded exact 80/20 split by hashed key order."""
    tf = training_frame(spark, sf_dir, P)
    return as_report(model.holdout_split(tf).select("date", "park_id", "split"))


_MONTH_MEAN = V.with_ctes(V.R_O, V.P_O, V.LEVELS_O, """pm as (
  select *, avg(crowd_level) over (partition by park_id, month(date)) as m,
         stddev_pop(crowd_level) over (partition by park_id, month(date)) as s
  from levels)""")


def _month_baseline(spark, sf_dir):
    """Climatological forecast of the orders world: the park's mean level of that month
    (and its spread) stands in for a model prediction."""
    from pyspark.sql import Window
    lv = orders_levels(spark, sf_dir)
    w = Window.partitionBy("park_id", F.month("date"))
    return lv.withColumn("m", F.avg("crowd_level").over(w)).withColumn("s", F.stddev_pop("crowd_level").over(w))


@register("regression_metrics", _MONTH_MEAN + """
select floor(avg((m - crowd_level) * (m - crowd_level)) * 1e6 + 0.5) / 1e6 as mse,
       floor(sqrt(avg((m - crowd_level) * (m - crowd_level))) * 1e6 + 0.5) / 1e6 as rmse,
       floor((1 - avg((m - crowd_level) * (m - crowd_level)) / var_pop(crowd_level)) * 1e6 + 0.5) / 1e6 as r2,
       floor(avg(abs(m - crowd_level)) * 1e6 + 0.5) / 1e6 as mae
from pm""")
def regression_metrics(spark, sf_dir):
    """MSE, RMSE, R2, MAE of the month-mean baseline against the labels."""
    r = model.regression_metrics(_month_baseline(spark, sf_dir), pred="m")
    return r.select(*[round_to(c).alias(c) for c in r.columns])


def _fitted(spark, sf_dir, params=None):
    tf = materialise(training_frame(spark, sf_dir, P), "training-frame")
    feats = model_features(tf)
    split = model.holdout_split(tf)
    m = model.fit_forest(split.where(F.col("split") == "train"), feats, params)
    return feats, split, m


# A forest of one tree that sees every row and every column has a known answer: both engines look
# for the cuts that lower the variance of the label most, here two levels of them on the month and
# the weekday of the orders world's park-days.
ONE_TREE = {"numTrees": 1, "maxDepth": 2, "bootstrap": False, "featureSubsetStrategy": "all"}
_CALENDAR = ["month", "weekday"]


def _cuts(node: str, rows: str) -> str:
    """CTEs: the best cut of ``rows`` (month, weekday, y), as ``node`` (feature, at, gain of all its
    rows, rows); no row where no cut lowers the variance."""
    each = " union all ".join(f"select '{f}' as feature, {f} as v, y from {rows}" for f in _CALENDAR)
    return f"""{node}_v as (
  select feature, v, count(*) as n, sum(y) as s, sum(y * y) as q from ({each}) group by 1, 2),
{node}_c as (
  select feature, v, sum(n) over l as ln, sum(s) over l as ls, sum(q) over l as lq,
         sum(n) over w as n, sum(s) over w as s, sum(q) over w as q
  from {node}_v window w as (partition by feature),
       l as (partition by feature order by v rows between unbounded preceding and current row)),
{node} as (
  select feature, v as at, n, (q - s::double * s / n) - (lq - ls::double * ls / ln)
         - ((q - lq) - (s - ls)::double * (s - ls) / (n - ln)) as gain
  from {node}_c where ln < n qualify gain > 1e-9 and row_number() over (order by gain desc, feature, v) = 1)"""


def _side(node: str) -> str:
    return f"case {node}.feature when 'month' then month else weekday end <= {node}.at"


_TREE = V.with_ctes(V.R_O, V.P_O, V.LEVELS_O, """tf as (
  select date, park_id, crowd_level, month(date) as month, isodow(date) - 1 as weekday, crowd_level::bigint as y
  from levels where crowd_level is not null)""", """hashed as (
  select *, md5(concat_ws('|', '104', cast(date as varchar), park_id)) as h from tf),
split as (
  select *, case when h <= (select h from hashed order by h limit 1 offset (select cast(ceil(count(*) * 0.2) as bigint) - 1 from hashed))
                 then 'test' else 'train' end as split from hashed)""",
    "train as (select month, weekday, y from split where split = 'train')", _cuts("top", "train"),
    f"train_low as (select train.* from train, top where {_side('top')})",
    f"train_high as (select train.* from train, top where not ({_side('top')}))",
    _cuts("low", "train_low"), _cuts("high", "train_high"),
    f"""sides as (
  select month, weekday, {_side('top')} as a,
         case when {_side('top')} then coalesce({_side('low')}, true) else coalesce({_side('high')}, true) end as b
  from (select distinct month, weekday from tf) d left join top on true left join low on true left join high on true),
leaves as (
  select a, b, sum(y)::double / count(*) as value from train join sides using (month, weekday) group by 1, 2),
predicted as (
  select t.*, l.value from split t join sides s using (month, weekday) join leaves l on l.a is not distinct from s.a and l.b = s.b)""")


def calendar_frame(spark, sf_dir):
    """Park-days of the orders world: date, park_id, crowd_level, month, weekday (0 is Monday)."""
    lv = orders_levels(spark, sf_dir).where(F.col("crowd_level").isNotNull())
    return lv.withColumn("month", F.month("date")).withColumn("weekday", F.weekday("date"))


def _one_tree(spark, sf_dir):
    split = materialise(model.holdout_split(calendar_frame(spark, sf_dir)), "calendar-frame")
    return split, model.fit_forest(split.where(F.col("split") == "train"), _CALENDAR, ONE_TREE)


@register("fit_predict", _TREE + f"""
select cast(date as varchar) as date, park_id, crowd_level, {V.r6('value')} as mean, cast(round_even(value, 0) as integer) as prediction
from predicted where split = 'test'""")
def fit_predict(spark, sf_dir):
    """A forest fitted on the training part predicts the test part, by value: one
    tree on all rows and columns, whose cuts and leaf means SQL finds too."""
    split, m = _one_tree(spark, sf_dir)
    test = model.cast_features(split.where(F.col("split") == "test"), _CALENDAR)
    raw = m.transform(test).select("date", "park_id", "crowd_level", round_to("prediction").alias("mean"),
                                   round_half_even_int("prediction").alias("prediction"))
    return as_report(raw)


@register("holdout_metrics", _TREE + """
select count(*) as n_test, floor(avg((value - y) * (value - y)) * 1e6 + 0.5) / 1e6 as mse,
       floor(sqrt(avg((value - y) * (value - y))) * 1e6 + 0.5) / 1e6 as rmse,
       floor((1 - avg((value - y) * (value - y)) / var_pop(y)) * 1e6 + 0.5) / 1e6 as r2,
       floor(avg(abs(value - y)) * 1e6 + 0.5) / 1e6 as mae
from predicted where split = 'test'""")
def holdout_metrics(spark, sf_dir):
    """The fitted forest's metrics on the hold-out part, by value."""
    split, m = _one_tree(spark, sf_dir)
    test = m.transform(model.cast_features(split.where(F.col("split") == "test"), _CALENDAR))
    r = model.regression_metrics(test)
    return r.select(F.lit(test.count()).cast("bigint").alias("n_test"), *[round_to(c).alias(c) for c in r.columns])


_START = ", ".join(f"({i}, {p['numTrees']}, {p['maxDepth']}, {p['minSplit']}, {p['minInstancesPerNode']}, '{p['featureSubsetStrategy']}')"
                   for i, p in enumerate(model.sample_params(model.START_TRIALS)))
_PARAMS = ["numTrees", "maxDepth", "minSplit", "minInstancesPerNode", "featureSubsetStrategy"]


@register("search", V.with_ctes("tf as (" + TRAINING_SQL + ")") + f"""
select cast(i as integer) as trial, "numTrees", "maxDepth", "minSplit", "minInstancesPerNode", "featureSubsetStrategy",
       true as scored, true as in_ranges, true as rank_is_order, true as repeats
from range(20) r(i) left join (values {_START}) as t(trial, "numTrees", "maxDepth", "minSplit", "minInstancesPerNode", "featureSubsetStrategy")
     on trial = i
where (select count(distinct date) from tf) > 6""")
def search(spark, sf_dir):
    """L4 L3: seeded sequential search (20 trials x 5 expanding folds) on the training part.  The
    parameters of the first trials are those of the seed; a later round's are within the ranges,
    and the same when they are proposed again from the scores before it."""
    from pyspark.sql import Window
    tf = materialise(training_frame(spark, sf_dir, P), "training-frame")
    train = model.holdout_split(tf).where(F.col("split") == "train").drop("split")
    tried = model.search(spark, train, model_features(tf), n_iter=20, parallelism=8)
    rows = [r.asDict() for r in tried.orderBy("trial").collect()]
    seen = [({k: r[k] for k in _PARAMS}, r["mean_mse"]) for r in rows]
    again = model.sample_params(model.START_TRIALS)
    while len(again) < len(rows):
        again += model.next_round(seen[:len(again)], min(model.ROUND_TRIALS, len(rows) - len(again)))
    checked = spark.createDataFrame(
        [(r["trial"], p == q, all(p[k] in space if isinstance(space[0], str) else space[0] <= p[k] <= space[1]
                                  for k, space in model.SEARCH_SPACE.items()))
         for r, (p, _), q in zip(rows, seen, again)], "trial int, repeats boolean, in_ranges boolean")
    first = F.col("trial") < model.START_TRIALS
    return tried.join(checked, "trial").select(
        "trial", *[F.when(first, F.col(k)).alias(k) for k in _PARAMS], (F.col("mean_mse") >= 0).alias("scored"), "in_ranges",
        (F.col("rank") == F.count("*").over(Window.orderBy("mean_mse", "trial"))).alias("rank_is_order"), "repeats")


@register("importance", _TREE + """,
won as (
  select feature, sum(gain) as gain from (select * from top union all select * from low union all select * from high) group by 1)
select f.feature, floor(coalesce(gain / (select sum(gain) from won), 0) * 1e6 + 0.5) / 1e6 as importance
from (values ('month'), ('weekday')) as f(feature) left join won using (feature)""")
def importance(spark, sf_dir):
    """The fitted forest's importances by value: each column's share of the variance that its
    cuts take away (the cut to the top N is checked by value in ``top_importance``)."""
    split, m = _one_tree(spark, sf_dir)
    return model.importances(spark, m, _CALENDAR, top_n=10).select("feature", round_to("importance").alias("importance"))


@register("top_importance", """
select feature, importance from (
  select l_returnflag || '/' || cast(l_linenumber as varchar) as feature, floor(avg(l_quantity) * 1e6 + 0.5) / 1e6 as importance
  from lineitem group by 1) order by importance desc, feature limit 10""")
def top_importance(spark, sf_dir):
    """The top-N cut and its tie rule by value, over table-derived shares."""
    li = landed.table(spark, sf_dir, "lineitem")
    shares = li.groupBy(F.concat_ws("/", "l_returnflag", F.col("l_linenumber").cast("string")).alias("feature")).agg(
        round_to(F.avg("l_quantity")).alias("importance"))
    return model.top_features(shares, 10)


_INF = "inf as (" + INFERENCE_SQL + ")"


@register("ensemble_interval", V.with_ctes(_INF) + """
select date, park_id, true as mean_is_forest, true as band_holds_level, true as band_in_bounds from inf""")
def ensemble_interval(spark, sf_dir):
    """Per-tree band on the inference frame.  The mean of the trees' values is what the
    forest itself predicts, and lower <= level <= upper within 0..100 (a hand-walked forest is
    held against it by value in the tests, the arithmetic by SQL in ``interval_in_row``)."""
    feats, split, m = _fitted(spark, sf_dir)
    path = model.save_model(m, scratch_path(spark, "forest"))
    inf = materialise(encode.align_columns(inference(spark, sf_dir), feats, keep=["date", "park_id"]), "inference-frame")
    iv = model.ensemble_interval(spark, m, path, inf, feats)
    own = m.transform(model.cast_features(inf, feats)).select("date", "park_id", F.col("prediction").alias("own"))
    return as_report(iv.join(own, ["date", "park_id"]).select(
        "date", "park_id", (F.abs(F.col("mean_pred") - F.col("own")) <= 1e-9).alias("mean_is_forest"),
        F.col("crowd_level").between(F.col("ci_lower"), F.col("ci_upper")).alias("band_holds_level"),
        ((F.col("ci_lower") >= 0) & (F.col("ci_upper") <= 100)).alias("band_in_bounds")))


@register("interval_in_row", f"""
with g as (
  select l_orderkey, avg(l_quantity * 2) as m, stddev_pop(l_quantity * 2) as s from lineitem group by 1)
select l_orderkey as order_id, {V.r6('m')} as mean_pred, cast(round_even(m, 0) as integer) as crowd_level,
       cast(round_even(greatest(0, least(100, m - s)), 0) as integer) as ci_lower,
       cast(round_even(greatest(0, least(100, m + s)), 0) as integer) as ci_upper
from g""")
def interval_in_row(spark, sf_dir):
    """The band of trees that stand side by side in a row, by value: an order's line
    items stand in for the trees."""
    li = landed.table(spark, sf_dir, "lineitem")
    trees = li.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity") * 2).cast("double").alias("v")))).alias("t"))
    banded = model.interval_in_row(trees, F.col("t.v"), keys=["order_id"])
    return banded.withColumn("mean_pred", round_to("mean_pred"))


@register("interval_bands", """
with t as (
  select cast(ts as date) as d, cast(user_id % 3 + 1 as varchar) as park_id, value / 4 as p from events),
g as (select d, park_id, avg(p) as m, stddev_pop(p) as s from t group by 1, 2)
select cast(d as varchar) as date, park_id, cast(round_even(m, 0) as integer) as crowd_level,
       cast(round_even(greatest(0, least(100, m - s)), 0) as integer) as ci_lower,
       cast(round_even(greatest(0, least(100, m + s)), 0) as integer) as ci_upper
from g""")
def interval_bands(spark, sf_dir):
    """The band arithmetic by value, each event standing in for a tree."""
    e = landed.table(spark, sf_dir, "events")
    trees = e.select(F.col("ts").cast("date").alias("date"), (F.col("user_id") % 3 + 1).cast("string").alias("park_id"),
                     (F.col("value") / 4).alias("tree_prediction"))
    return as_report(model.interval(trees).drop("mean_pred"))


@register("model_roundtrip", _TREE + """,
days as (
  select park_id, cast(unnest(generate_series(hi + 1, hi + 28, interval 1 day)) as date) as date
  from (select distinct park_id from tf), (select max(date) as hi from tf))
select cast(d.date as varchar) as date, d.park_id, cast(round_even(l.value, 0) as integer) as prediction
from days d join sides s on s.month = month(d.date) and s.weekday = isodow(d.date) - 1
     join leaves l on l.a is not distinct from s.a and l.b = s.b""")
def model_roundtrip(spark, sf_dir):
    """The forest is saved and loaded with its columns, the requested days (the four
    weeks after the last one) are aligned to them, and the loaded forest's predictions are those of
    SQL's tree by value."""
    split, m = _one_tree(spark, sf_dir)
    loaded, cols = model.load_model(model.save_model(m, scratch_path(spark, "forest")))
    hi = split.agg(F.max("date").alias("hi")).first()["hi"]
    days = split.select("park_id").distinct().select("park_id", F.explode(F.sequence(
        F.date_add(F.lit(hi), 1), F.date_add(F.lit(hi), 28))).alias("date"))
    asked = days.withColumn("weekday", F.weekday("date")).withColumn("not_known", F.lit(1)).withColumn("month", F.month("date"))
    return as_report(model.predict(loaded, encode.align_columns(asked, cols, keep=["date", "park_id"]), cols)
                     .select("date", "park_id", "prediction"))
