"""Run parameters from a config file: nested sections or flat keys."""

from __future__ import annotations

import datetime as dt
import json

# Where each run parameter stands in a nested config.
SECTIONS = {
    "start_date": ("scraper", "start_date"),
    "end_date": ("scraper", "end_date"),
    "exclude_months": ("scraper", "exclude_months"),
    "park_ids": ("scraper", "park_ids"),
    "include_park_ids": ("models", "crowd-level", "train", "include_park_ids"),
    "train_model_name": ("models", "crowd-level", "train", "model_name"),
    "model_name": ("models", "crowd-level", "inference", "model_name"),
    "park_id": ("models", "crowd-level", "inference", "park_id"),
    "horizon_days": ("models", "crowd-level", "inference", "horizon_days"),
    "dates": ("models", "crowd-level", "inference", "dates"),
}
DEFAULTS = {"exclude_months": [], "include_park_ids": None, "train_model_name": "crowd-level-model",
            "model_name": "crowd-level-model", "park_id": 2, "horizon_days": 14, "dates": [], "n_iter": 20}
REQUIRED = {"ingest": ("start_date", "end_date"), "train": (), "predict": ()}


def flatten(config: dict) -> dict:
    """Flat run parameters: a nested value wins over a flat key, a default fills the rest."""
    out = {k: v for k, v in config.items() if k not in ("scraper", "models")}
    for key, path in SECTIONS.items():
        node = config
        for part in path:
            node = node.get(part) if isinstance(node, dict) else None
        if node is not None:
            out[key] = node
    return {**DEFAULTS, **{k: v for k, v in out.items() if v is not None or k not in DEFAULTS}}


def load(path: str | None, command: str = "predict") -> dict:
    """The parameters of a JSON or YAML file, or the defaults; a missing required one raises."""
    raw: dict = {}
    if path:
        with open(path) as fh:
            if path.endswith((".yml", ".yaml")):
                import yaml
                raw = yaml.safe_load(fh) or {}
            else:
                raw = json.load(fh)
    cfg = flatten(raw)
    missing = [k for k in REQUIRED[command] if path and not cfg.get(k)]
    if missing:
        raise ValueError(f"{path}: {command} needs {', '.join(missing)}")
    return cfg


def requested_dates(cfg: dict, as_of: str) -> list[str]:
    """The days asked for: ``dates`` if given, else ``as_of`` and the horizon's days after it."""
    if cfg["dates"]:
        return [str(d).replace("/", "-") for d in cfg["dates"]]
    first = dt.date.fromisoformat(as_of)
    return [(first + dt.timedelta(days=i)).isoformat() for i in range(int(cfg["horizon_days"]) + 1)]
