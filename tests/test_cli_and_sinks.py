"""Table creation, model load errors, empty-result warning, and the command line."""

import json
import os
import tempfile

from crowdspark import cli
from crowdspark.operators import model, report
from crowdspark.sources import sinks
from crowdspark.schema import PARK_INFO

from .conftest import SF001


def test_create_tables_once(spark):
    base = tempfile.mkdtemp()
    r, p = os.path.join(base, "queue_data"), os.path.join(base, "park_info")
    sinks.create_tables(spark, r, p)
    sinks.create_tables(spark, r, p)                    # second call leaves them alone
    assert spark.read.schema(PARK_INFO).parquet(p).count() == 0
    assert sinks.read_readings(spark, r).count() == 0


def test_model_load_error_text(spark):
    m, cols, err = model.load_model_or_error(os.path.join(tempfile.mkdtemp(), "missing"))
    assert m is None and cols is None and "could not be loaded" in err


def test_empty_result_warning(spark):
    empty = spark.createDataFrame([], "date date, crowd_level int")
    assert report.empty_result_warning(empty)
    assert report.empty_result_warning(spark.createDataFrame([(None, 1)], "date date, crowd_level int")) is None


def test_cli_ingest_train_predict(spark, capsys):
    base = tempfile.mkdtemp()
    cfg = os.path.join(base, "cfg.json")
    with open(cfg, "w") as fh:
        json.dump({"n_iter": 1, "start_date": "2024/01/01", "end_date": "2024/02/10", "exclude_months": [12]}, fh)
    run = [("ingest", ["--out", os.path.join(base, "ing")]), ("ingest", ["--out", os.path.join(base, "ing")]),
           ("train", ["--model", os.path.join(base, "model")]),
           ("predict", ["--model", os.path.join(base, "model"), "--out", os.path.join(base, "pred")])]
    orig_stop = spark.stop
    try:
        spark.stop = lambda: None                       # the CLI stops its session; keep the test one
        for cmd, extra in run:
            cli.main([cmd, "--data", SF001, "--config", cfg, "--master", "local[4]", "--mapped", *extra])
    finally:
        spark.stop = orig_stop
    out = capsys.readouterr().out
    assert '"metrics"' in out
    preds = spark.read.parquet(os.path.join(base, "pred", "predictions")).collect()
    assert preds and all(0 <= r["ci_lower"] <= r["crowd_level"] <= r["ci_upper"] <= 100 for r in preds)
    assert spark.read.parquet(os.path.join(base, "ing", "work_list")).count() > 0
    # the second ingest added nothing
    from crowdspark.operators import align
    from crowdspark.sources import landed
    stored = sinks.read_readings(spark, os.path.join(base, "ing", "queue_data"))
    assert stored.count() == align.align_to_slots(landed.events_readings(spark, SF001)).count()


def test_config_shapes(tmp_path):
    from crowdspark import config
    nested = {"scraper": {"start_date": "2021/04/01", "end_date": "2025/10/31", "park_ids": [1, 2]},
              "models": {"crowd-level": {"train": {"include_park_ids": None}, "inference": {"park_id": 3, "horizon_days": 5}}}}
    cfg = config.flatten(nested)
    assert (cfg["start_date"], cfg["park_ids"], cfg["park_id"], cfg["horizon_days"]) == ("2021/04/01", [1, 2], 3, 5)
    assert cfg["include_park_ids"] is None and cfg["exclude_months"] == [] and config.flatten({})["horizon_days"] == 14
    assert config.requested_dates(cfg, "2024-02-27")[-1] == "2024-03-03" and len(config.requested_dates(cfg, "2024-02-27")) == 6
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"scraper": {"start_date": "2021/04/01"}}))
    import pytest
    with pytest.raises(ValueError, match="end_date"):
        config.load(str(path), "ingest")
