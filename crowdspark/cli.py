"""Command-line entry points: ingest, train, predict.

    python -m crowdspark.cli ingest  --data DIR --out DIR [--config run.yml]
    python -m crowdspark.cli train   --data DIR --model DIR [--config run.yml]
    python -m crowdspark.cli predict --data DIR --model DIR --out DIR [--as-of YYYY-MM-DD --horizon N --park ID]

``--data`` is a folder of stored tables and JSON documents (``sources.inputs.from_folder``), or
with ``--mapped`` a folder of the driver's tables.  Ingest reads raw readings: ``readings/``
Parquet (id, date, ride_id, ts, queue_time, is_closed) and ``park_info/``, or the mapped events.
Outputs are tables (Parquet / CSV folders) written by Spark; nothing is collected to the driver
except small reports (metrics, the top importances).  Config: see ``config``.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import functions as F

from . import config
from .operators import align, encode, model, report, worklist
from .plans.frames import RunParams, inference_frame, model_features, park_days, training_frame
from .schema import PARK_INFO
from .session import apply_defaults, build_session, materialise
from .sources import inputs, landed, sinks


def _inputs(spark, args):
    return inputs.from_tables(spark, args.data) if args.mapped else inputs.from_folder(spark, args.data)


def cmd_ingest(spark, args, cfg):
    """Align raw readings and append those not stored yet, by day; keep the ride table by
    insert-or-ignore; list the days still to collect per park.  Running it again adds nothing."""
    readings_path, rides_path = (os.path.join(args.out, t) for t in ("queue_data", "park_info"))
    sinks.create_tables(spark, readings_path, rides_path)
    if args.mapped:
        raw, rides = landed.events_readings(spark, args.data), landed.events_park_info(spark, args.data)
    else:
        raw = spark.read.parquet(os.path.join(args.data, "readings"))
        rides = spark.read.schema(PARK_INFO).parquet(os.path.join(args.data, "park_info"))
    existing = spark.read.schema(PARK_INFO).parquet(rides_path)
    rides = rides.withColumn("date", F.lit(None).cast("date")).withColumn("pos", F.lit(0))
    new = materialise(sinks.insert_or_ignore(existing, rides).select(*PARK_INFO.fieldNames()), "rides")
    new.write.mode("append").parquet(rides_path)
    known = spark.read.schema(PARK_INFO).parquet(rides_path)
    sinks.ingest_readings(align.align_to_slots(raw), known, readings_path)
    last = worklist.last_stored_day(sinks.read_readings(spark, readings_path), known)
    parks = known.select("park_id")
    if cfg.get("park_ids"):                     # configured parks count even before their first row
        parks = parks.unionAll(spark.createDataFrame([(str(p),) for p in cfg["park_ids"]], "park_id string"))
    wl = worklist.work_list(parks, cfg.get("start_date", "2024/01/01"), cfg.get("end_date", "2024/03/31"),
                            cfg["exclude_months"], last_days=last)
    wl.write.mode("overwrite").parquet(os.path.join(args.out, "work_list"))


def cmd_train(spark, args, cfg):
    params = RunParams(include_park_ids=cfg["include_park_ids"])
    tf = materialise(training_frame(spark, _inputs(spark, args), params), "training-frame")
    feats = model_features(tf)
    split = model.holdout_split(tf)
    train = split.where("split = 'train'")
    trials = model.search(spark, train, feats, n_iter=int(cfg["n_iter"]))
    best = trials.orderBy("rank").first().asDict()
    fitted = model.fit_forest(train, feats, best)
    test = model.cast_features(split.where("split = 'test'"), feats)
    metrics = model.regression_metrics(fitted.transform(test)).first().asDict()
    model.save_model(fitted, args.model)
    print(json.dumps({"best": best, "metrics": metrics}, default=str))
    model.importances(spark, fitted, feats, 10).show(truncate=False)


def cmd_predict(spark, args, cfg):
    params = RunParams(as_of=args.as_of or cfg.get("as_of", RunParams.as_of),
                       horizon_days=int(args.horizon or cfg["horizon_days"]))
    days = park_days(spark, config.requested_dates({**cfg, "horizon_days": params.horizon_days}, params.as_of),
                     args.park or cfg["park_id"])
    fitted, cols, err = model.load_model_or_error(args.model)
    if err:
        raise SystemExit(err)
    inf = encode.align_columns(inference_frame(spark, _inputs(spark, args), days, params), cols, keep=["date", "park_id"])
    preds = model.ensemble_interval(spark, fitted, args.model, inf, cols).drop("mean_pred")
    warning = report.empty_result_warning(preds)
    if warning:
        print(warning)
    preds.write.mode("overwrite").parquet(os.path.join(args.out, "predictions"))
    report.forecast_summary(preds).write.mode("overwrite").parquet(os.path.join(args.out, "summary"))
    sinks.export_csv(report.display_table(preds), os.path.join(args.out, "display_csv"))


def main(argv=None):
    ap = argparse.ArgumentParser(prog="crowdspark")
    ap.add_argument("command", choices=["ingest", "train", "predict"])
    ap.add_argument("--data", required=True)
    ap.add_argument("--model")
    ap.add_argument("--out")
    ap.add_argument("--config")
    ap.add_argument("--as-of")
    ap.add_argument("--horizon")
    ap.add_argument("--park")
    ap.add_argument("--mapped", action="store_true", help="--data holds the driver's tables")
    ap.add_argument("--master", default=os.environ.get("SPARK_MASTER", "local[*]"))
    args = ap.parse_args(argv)
    spark = build_session(master=args.master)
    apply_defaults(spark)
    cfg = config.load(args.config, args.command)
    {"ingest": cmd_ingest, "train": cmd_train, "predict": cmd_predict}[args.command](spark, args, cfg)
    spark.stop()


if __name__ == "__main__":
    main()
