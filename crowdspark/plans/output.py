"""Final projection for reported results: dates and timestamps as fixed-format text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_report(df: DataFrame) -> DataFrame:
    """DATE -> 'YYYY-MM-DD', TIMESTAMP -> 'YYYY-MM-DD HH:MM:SS'; other columns unchanged."""
    cols = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        if dtype == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif dtype.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(name))
    return df.select(*cols)
