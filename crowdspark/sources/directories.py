"""Flatten nested directory documents into park dimensions (first match by position)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import park_label


def parks_from_directory(directory: DataFrame) -> DataFrame:
    """companies[] -> parks[] -> one row per park id: park_id, name, country, latitude, longitude.

    A park id listed more than once keeps its first entry in document order (company
    position, then park position).  Coordinates are text in the document -> DOUBLE.
    """
    c = directory.select(F.posexplode("companies").alias("cpos", "company"))
    p = c.select("cpos", F.posexplode("company.parks").alias("ppos", "park"))
    first = (p.where(F.col("park.id").isNotNull())
             .groupBy(F.col("park.id").alias("pid"))
             .agg(F.min_by("park", F.struct("cpos", "ppos")).alias("park")))
    return first.select(
        F.col("pid").cast("string").alias("park_id"), F.col("park.name").alias("name"),
        F.col("park.country").alias("country"),
        F.col("park.latitude").try_cast("double").alias("latitude"),
        F.col("park.longitude").try_cast("double").alias("longitude"))


def destination_parks(destinations: DataFrame) -> DataFrame:
    """destinations[] -> parks[] -> (name_lower, external_id, pos) for name matching."""
    d = destinations.select(F.posexplode("destinations").alias("dpos", "dest"))
    p = d.select("dpos", F.posexplode("dest.parks").alias("ppos", "park"))
    return p.select(F.lower("park.name").alias("name_lower"), F.col("park.id").alias("external_id"),
                    F.struct("dpos", "ppos").alias("pos"))


def external_ids(parks: DataFrame, destinations: DataFrame) -> DataFrame:
    """park_id -> external id by case-insensitive name, first destination match wins."""
    dest = (destination_parks(destinations).where(F.col("name_lower").isNotNull())
            .groupBy("name_lower").agg(F.min_by("external_id", "pos").alias("external_id")))
    return (parks.select("park_id", F.lower("name").alias("name_lower"))
            .join(dest, "name_lower", "left").select("park_id", "external_id"))


def park_dimension(directory: DataFrame, destinations: DataFrame | None = None) -> DataFrame:
    """Park dimension with display label (and external id when a destination list is given)."""
    parks = parks_from_directory(directory)
    out = parks.withColumn("label", park_label("name", "park_id"))
    if destinations is not None:
        out = out.join(external_ids(parks, destinations), "park_id", "left")
    return out
