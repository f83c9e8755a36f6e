"""Text column expressions and the fixed labels of the report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import col_

# Fixed values of the expected output: crowd labels and their upper bounds.
CROWD_BANDS = [(25, "Quiet"), (50, "Moderate"), (75, "Busy"), (101, "Very Busy")]
PARK_DATASET_LABEL = "Reported by park"
UNKNOWN_RIDE_NAME = "Unknown"


def crowd_label(level) -> Column:
    """<25 Quiet, <50 Moderate, <75 Busy, else Very Busy."""
    c = col_(level)
    return (F.when(c < 25, "Quiet").when(c < 50, "Moderate").when(c < 75, "Busy").otherwise("Very Busy"))


def last_path_part(c) -> Column:
    """'/parks/1/rides/42' -> '42'; '' when the text ends with a slash."""
    return F.element_at(F.split(col_(c), "/"), -1)


def park_label(name, park_id) -> Column:
    """'{name} (ID {id})' with 'Park {id}' as the default name."""
    pid = col_(park_id).cast("string")
    return F.format_string("%s (ID %s)", F.coalesce(col_(name), F.concat(F.lit("Park "), pid)), pid)


def same_text_ci(a, b) -> Column:
    return F.lower(col_(a)) == F.lower(col_(b))
