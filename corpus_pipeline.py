"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller writes as
Parquet and reads back as the next stage's ``docs``; all but the last return the columns of
``docs``.  Decisions are tied to rows by their number in that stored table, so repeated and
null ids and clashing column names are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdspark.llm.common import WORDS, stored, table
from crowdspark.llm.exact_dedup import exact_dedup
from crowdspark.llm.langid import held_out, identify_language
from crowdspark.llm.mixing import mix_sources
from crowdspark.llm.packing import pack_documents
from crowdspark.llm.simhash import simhash_groups

LEAST_SCORE = 0.5           # language ID: below this the prediction counts as a rejection
LETTER = r"\p{L}"          # what language ID counts as one


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the operators' row_key under a name that no column has."""
    name = "row_number_"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def _keep(docs: DataFrame, decided: DataFrame, condition: Column) -> DataFrame:
    rows, key = _numbered(docs)
    kept = decided.where(condition).select(F.col("row_key").alias(key))
    return rows.join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: text without letters and undecided texts go.

    Where no row that may be learned from has a language there is nothing to judge by, and only
    text without letters goes."""
    if docs.where(~held_out() & F.col("lang").isNotNull()).isEmpty():
        return docs.where(F.col("text").rlike(LETTER))
    return _keep(docs, identify_language(docs), (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the smallest doc_id."""
    return _keep(docs, exact_dedup(docs), F.col("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest doc_id."""
    return _keep(docs, simhash_groups(docs), F.col("kept"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once per whole time the mix takes it, and the document on a source's cut
    once more with its words up to the cut; documents behind the cut go, and those without words,
    of which there is nothing to take."""
    rows, key = _numbered(docs)
    while any(f"{key}{part}" in docs.columns for part in ("size", "taken", "part")):
        rows, key = rows.withColumnRenamed(key, f"{key}_"), f"{key}_"
    taken = (mix_sources(docs).where("taken > 0")
             .select(F.col("row_key").alias(key), F.col("size").alias(f"{key}size"), F.col("taken").alias(f"{key}taken")))
    size, took, part = F.col(f"{key}size"), F.col(f"{key}taken"), f"{key}part"
    words = F.explode(F.transform(F.sequence(F.lit(0), F.ceil(took / size) - 1),
                                  lambda i: F.least(size, took - i * size)))
    rows = rows.join(taken, key).withColumn(part, words)
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), F.lit(1), F.col(part).cast("int")), " ")
    text = F.when(F.col(part) >= size, F.col("text")).otherwise(cut)
    return rows.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their sequence and place."""
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

# Language scores, SimHash and the packing search have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
