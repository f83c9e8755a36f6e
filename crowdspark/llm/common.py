"""Shared helpers: stored intermediates in the cluster's shared folder, input columns, regexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdspark.session import scratch_path

# White space as the contracts define it: space and the bytes 09 to 0D.
BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and return the table read back.

    Cuts the lineage: what follows reads files every executor can see, so a lost executor
    costs a re-read and not a recomputation, and row numbers given before stay as they are.
    The write's own shuffle files go as soon as it ends; ``df`` is not used again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(row_key, doc_id, text, ...) of any table: only the named columns, so that other columns
    with the names used inside an operator cannot clash.  A null text counts as empty.
    ``row_key`` tells repeated rows apart; it is fixed for a stored table."""
    return docs.select(F.monotonically_increasing_id().alias("row_key"),
                       F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
