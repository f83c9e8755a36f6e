"""Composed training and inference frames (events world).

Training: raw readings -> 15-minute alignment (the stored table) -> crowd level -> target set
aside -> calendar, public / school holidays, opening hours, weather -> exact batch medians
-> target re-attached -> park one-hots.  Inference: a (date, park_id) frame for a horizon
runs the same feature steps with forecast + climatology weather and its own medians.

The date column is kept (folds are cut by day); the model's feature list excludes it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar, encode, impute, labels, model, opening, weather
from ..schema import FEATURE_COLS
from ..session import materialise
from ..sources import directories, holidays, inputs, schedule


@dataclass
class RunParams:
    """Run parameters (as_of is always explicit so results repeat).

    ``keep_incomplete`` keeps rows without opening hours or with a NULL feature instead of
    dropping them; ``strict_schedule_month`` voids a month's schedule for one unreadable entry;
    ``fit_on`` = 'train' takes the medians from the training part only ('all': every row).
    """
    include_park_ids: list[int] | None = None
    as_of: str = "2024-01-17"              # first predicted day of the events world
    horizon_days: int = 14
    strict_schedule_month: bool = True
    keep_incomplete: bool = False
    fit_on: str = "all"

    def __post_init__(self):
        ids = self.include_park_ids
        if ids is not None and not isinstance(ids, list):
            self.include_park_ids = [int(ids)]


def as_inputs(spark: SparkSession, source: inputs.Inputs | str) -> inputs.Inputs:
    """The inputs themselves, or those of a folder of the driver's tables."""
    return source if isinstance(source, inputs.Inputs) else inputs.from_tables(spark, source)


def _feature_steps(data: inputs.Inputs, frame: DataFrame, readings: DataFrame, params: RunParams) -> DataFrame:
    parks = directories.parks_from_directory(data.parks)
    countries = calendar.park_countries(parks, data.aliases)
    f = calendar.add_date_features(frame)
    f = calendar.add_holidays(f, countries, holidays.public_holiday_days(data.public_holidays),
                              holidays.school_holiday_days(data.school_holidays))
    hist = opening.first_last_times(readings, data.park_info)
    sched = schedule.schedule_days(data.schedule, params.strict_schedule_month)
    return opening.opening_hour_features(opening.opening_times(f, hist, sched), drop_missing=not params.keep_incomplete)


def training_plan(spark: SparkSession, source: inputs.Inputs | str, params: RunParams) -> DataFrame:
    """The training rows before imputation, as one plan."""
    data = as_inputs(spark, source)
    readings = data.readings()
    target = labels.crowd_levels(readings, data.park_info, params.include_park_ids)
    # The target rides along through the left joins (none of them multiplies rows) instead of
    # being set aside and joined back; it is kept out of imputation and of the NULL drop.
    f = _feature_steps(data, target, readings, params)
    f = weather.add_weather_history(f, data.weather)
    return f.select("date", "park_id", *FEATURE_COLS, "crowd_level")


def training_frame(spark: SparkSession, source: inputs.Inputs | str, params: RunParams | None = None,
                   return_medians: bool = False):
    """``source``: inputs, or a folder of the driver's tables."""
    params = params or RunParams()
    f = materialise(training_plan(spark, source, params), "features")
    feats = f.drop("crowd_level")
    if params.fit_on == "train":
        feats = model.holdout_split(feats).where("split = 'train'").drop("split")
    medians = impute.exact_medians(feats, impute.numeric_columns_with_nulls(feats))
    f, _ = impute.fill_with_median(f, medians, drop_remaining=False)
    if not params.keep_incomplete:
        f = f.na.drop("any", subset=["date", "park_id", *FEATURE_COLS])
    out = encode.one_hot_parks(f, keep_source=True)
    return (out, medians) if return_medians else out


def inference_days(spark: SparkSession, source: inputs.Inputs | str, params: RunParams) -> DataFrame:
    """(date, park_id) for every park of the ride dimension and every day of the horizon."""
    start = F.to_date(F.lit(params.as_of))
    parks = as_inputs(spark, source).park_info.select("park_id").distinct()
    if params.include_park_ids is not None:
        parks = parks.where(F.col("park_id").cast("int").isin(params.include_park_ids))
    return parks.select(F.explode(F.sequence(start, F.date_add(start, params.horizon_days))).alias("date"),
                        F.col("park_id").cast("string").alias("park_id"))


def park_days(spark: SparkSession, dates: list[str], park_id) -> DataFrame:
    """(date, park_id) of one park on the given days ('YYYY-MM-DD')."""
    return spark.createDataFrame([(d, str(park_id)) for d in dates], "date string, park_id string").select(
        F.to_date("date").alias("date"), "park_id")


def inference_plan(spark: SparkSession, source: inputs.Inputs | str, day_df: DataFrame | None,
                   params: RunParams) -> DataFrame:
    """The requested days with their features before imputation, as one plan."""
    if day_df is None:
        raise ValueError("inference needs the requested days")
    if "park_id" not in day_df.columns:
        raise ValueError("the requested days need a park_id for each day")
    data = as_inputs(spark, source)
    day_df = day_df.withColumn("park_id", F.col("park_id").cast("string"))
    f = _feature_steps(data, day_df, data.readings(day_df), params)
    f = weather.add_weather_forecast(f, data.forecast(params.as_of), weather.climatology(data.weather, params.as_of),
                                     params.as_of)
    return f.select("date", "park_id", *FEATURE_COLS)


def inference_frame(spark: SparkSession, source: inputs.Inputs | str, day_df: DataFrame | None,
                    params: RunParams | None = None, medians: dict | None = None) -> DataFrame:
    """``medians``: those of the training frame, else the requested days' own."""
    params = params or RunParams()
    f = materialise(inference_plan(spark, source, day_df, params), "features")
    f, _ = impute.fill_with_median(f, medians, drop_remaining=not params.keep_incomplete)
    return encode.one_hot_parks(f, keep_source=True)


def model_features(df: DataFrame) -> list[str]:
    """Feature list in frame order: everything but keys and target."""
    return [c for c in df.columns if c not in ("date", "park_id", "crowd_level")]
