"""Park one-hot encoding and alignment to a stored training column list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def park_values(df: DataFrame, col: str = "park_id") -> list[str]:
    """Distinct park ids, string-sorted ('1' < '10' < '2').  They become column names, so the
    driver holds exactly as many as the result has columns."""
    d = df.select(F.col(col).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct()
    return sorted(r["v"] for r in d.collect())


def one_hot_parks(df: DataFrame, values: list[str] | None = None, col: str = "park_id",
                  prefix: str = "park", keep_source: bool = False) -> DataFrame:
    """park_<id> INT columns replacing ``col`` (kept as a key with ``keep_source``); a NULL
    park gives all zeros."""
    values = park_values(df, col) if values is None else values
    p = F.col(col).cast("string")
    flags = [F.coalesce((p == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values]
    return df.select(*[c for c in df.columns if c != col or keep_source], *flags)


def align_columns(df: DataFrame, columns: list[str], fill=0, keep: list[str] | None = None) -> DataFrame:
    """Reorder to ``columns``: missing ones added as ``fill``, extras dropped (``keep`` first)."""
    have = set(df.columns)
    sel = [F.col(f"`{k}`") for k in (keep or [])]
    sel += [F.col(f"`{c}`") if c in have else F.lit(fill).alias(c) for c in columns]
    return df.select(*sel)
