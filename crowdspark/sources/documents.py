"""JSON documents -> typed rows: the shapes the services answer with, one fixed schema each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

# kind of document -> its schema; kinds that answer with a list have one row per element
KINDS: dict[str, T.StructType] = {
    "parks": S.PARK_DIRECTORY,
    "destinations": S.DESTINATION_DIRECTORY,
    "public_holidays": S.PUBLIC_HOLIDAY,
    "school_holidays": S.SCHOOL_PERIOD,
    "schedule": S.SCHEDULE_PAYLOAD,
    "forecast": S.FORECAST_PAYLOAD,
    "weather": S.DAILY_WEATHER,
    "pages": S.CHART_PAYLOAD,
}


BROKEN = "_corrupt_record"


def _parsed(texts: DataFrame, kind: str, body: str) -> DataFrame:
    """(d, good): each JSON object of the texts; not good where the text is no JSON of the kind."""
    text = F.col(body)
    # an array is taken apart as text first, so that each element is judged by itself
    each = F.when(F.ltrim(text).startswith("["), F.coalesce(F.from_json(text, T.ArrayType(T.StringType())), F.array(text)))
    one = texts.select(F.explode(F.coalesce(each, F.array(text))).alias("text"))
    schema = T.StructType([*KINDS[kind].fields, T.StructField(BROKEN, T.StringType())])
    doc = one.select(F.from_json("text", schema, {"columnNameOfCorruptRecord": BROKEN}).alias("d"))
    some = F.greatest(F.lit(False), *[F.col(f"d.{f.name}").isNotNull() for f in KINDS[kind].fields])
    return doc.withColumn("good", F.coalesce(some & F.col(f"d.{BROKEN}").isNull(), F.lit(False)))


def parse_documents(texts: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """Rows of one ``kind`` from JSON text: an object is one row, an array a row per element.
    Text that is not JSON of the kind gives no rows (``unreadable`` counts it)."""
    return _parsed(texts, kind, body).where("good").select(*[F.col(f"d.{f.name}").alias(f.name) for f in KINDS[kind].fields])


def unreadable(texts: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """One row: objects found in the texts, and how many of them cannot be read."""
    return _parsed(texts, kind, body).agg(F.count("*").alias("documents"), F.count_if(~F.col("good")).alias("unreadable"))


def read_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Documents of a file or folder, a whole JSON text per file or one per line."""
    whole = spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "body")
    # a file of one document a line is split at line ends; a document spread over lines is not
    lines = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")
    each = F.forall(lines, lambda x: F.ltrim(x).rlike(r"^[{\[].*[}\]]\s*$"))
    return parse_documents(whole.select(F.explode(F.when(each, lines).otherwise(F.array("body"))).alias("body")), kind)
