"""Calendar and holiday features for a (date, park_id) frame.

The frame is park-days (already aggregated) and the holiday tables are country x day, so
the joins carry no hint: adaptive execution broadcasts whichever side is small at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import day_of_week_flags, month_flags
from ..functions.dates import col_

LEAST_LIKE = 0.7                # likeness of two names from which on they are taken for the same


def add_date_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """day_of_week_1..7 (Monday first) and month_1..12 booleans."""
    return df.select("*", *day_of_week_flags(date_col), *month_flags(date_col))


# Latin letters with marks and the letters they stand for.
_MARKED = "àáâãäåāăąçćĉċčďđèéêëēĕėęěĝğġģĥìíîïĩīĭįıĵķĺļľłñńņňòóôõöøōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_PLAIN = "aaaaaaaaacccccddeeeeeeeeegggghiiiiiiiiijkllllnnnnooooooooorrrssssttuuuuuuuuuuwyyyzzz"


def plain_name(c) -> Column:
    """A name as it is compared: lower case, letters without marks, anything else one blank."""
    return F.trim(F.regexp_replace(F.translate(F.lower(col_(c)), _MARKED, _PLAIN), r"[^\p{L}\p{N}]+", " "))


def _bigrams(name: Column) -> Column:
    """The distinct pairs of neighbouring characters, with a blank before and behind."""
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))


def match_names(names: DataFrame, known: DataFrame, least: float = LEAST_LIKE) -> DataFrame:
    """(plain, code, known, likeness): for each distinct ``plain`` of ``names`` the entry of ``known``
    (plain, code) that is most like it, if its likeness is at least ``least``.

    Likeness is 1 - edit distance / length of the longer name; ties go to more shared pairs of
    letters, then to the smaller known name, then to the smaller code, so doubled and contradictory
    entries give one row.  Equal names need no search.  Others are compared only with entries that
    share a pair of letters: from a likeness of one half on every match does, as each edit spoils at
    most two of the pairs, one more than the name has letters."""
    if least < 0.5:
        raise ValueError("names that share no pair of letters are not compared: least must be 0.5 or more")
    names = names.where(F.col("plain") != "").select("plain").distinct()
    known = known.where((F.col("plain") != "") & F.col("code").isNotNull()).groupBy(F.col("plain").alias("known")).agg(
        F.min("code").alias("code"))
    exact = names.join(known, names["plain"] == known["known"]).select("plain", "code", "known", F.lit(1.0).alias("likeness"))
    left = names.join(known, names["plain"] == known["known"], "left_anti")
    pairs = (left.select("plain", F.explode(_bigrams(F.col("plain"))).alias("pair"))
             .join(known.select("known", "code", F.explode(_bigrams(F.col("known"))).alias("pair")), "pair")
             .groupBy("plain", "known", "code").agg(F.count("*").alias("shared")))
    like = 1 - F.levenshtein("plain", "known") / F.greatest(F.length("plain"), F.length("known"))
    best = (pairs.withColumn("likeness", like).where(F.col("likeness") >= least).groupBy("plain")
            .agg(F.min(F.struct(-F.col("likeness"), -F.col("shared"), "known", "code", "likeness")).alias("b")))
    return exact.unionByName(best.select("plain", "b.code", "b.known", "b.likeness"))


def park_countries(parks: DataFrame, aliases: DataFrame, least: float = LEAST_LIKE) -> DataFrame:
    """park_id -> country name and two-letter code, one row per row of ``parks`` whatever ``aliases``
    holds (one lookup per country name, not per park).

    Names are found as ``match_names`` says: misspelt and accented ones too.  An unknown park or
    country gives a NULL code, so the flags below come out False.
    """
    asked = parks.select("park_id", "country", plain_name("country").alias("plain"))
    found = match_names(asked, aliases.select(plain_name("name_lower").alias("plain"), F.col("alpha2").alias("code")), least)
    return (asked.join(found.select("plain", "code"), "plain", "left")
            .select("park_id", "country", F.col("code").alias("country_code")))


def unknown_parks(df: DataFrame, countries: DataFrame) -> DataFrame:
    """One row: rows whose park has no country code (their flags are False), and how many parks."""
    known = countries.where(F.col("country_code").isNotNull()).select("park_id").distinct()
    lost = df.groupBy("park_id").agg(F.count("*").alias("n")).join(known, "park_id", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_without_country"), F.count("*").alias("parks_without_country"))


def add_bank_holidays(df: DataFrame, countries: DataFrame, holiday_days: DataFrame) -> DataFrame:
    """is_bank_holiday: the day is in the public-holiday set of the park's country."""
    flags = holiday_days.select("country_code", "date", F.lit(True).alias("_hol"))
    out = (df.join(countries.select("park_id", "country_code"), "park_id", "left")
           .join(flags, ["country_code", "date"], "left"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_hol", F.lit(False)).alias("is_bank_holiday"))


def add_school_holidays(df: DataFrame, countries: DataFrame, school_days: DataFrame) -> DataFrame:
    """is_school_holiday: the day lies in any school period of the park's country."""
    flags = school_days.select("country", "date", F.lit(True).alias("_sch"))
    out = (df.join(countries.select("park_id", F.col("country").alias("_country")), "park_id", "left")
           .join(flags.withColumnRenamed("country", "_country"), ["_country", "date"], "left"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_sch", F.lit(False)).alias("is_school_holiday"))


def add_holidays(df: DataFrame, countries: DataFrame, holiday_days: DataFrame, school_days: DataFrame) -> DataFrame:
    """``add_bank_holidays`` and ``add_school_holidays`` with the parks' countries looked up once."""
    of_park = countries.select("park_id", F.col("country_code").alias("_code"), F.col("country").alias("_country"))
    bank = holiday_days.select(F.col("country_code").alias("_code"), "date", F.lit(True).alias("_hol"))
    school = school_days.select(F.col("country").alias("_country"), "date", F.lit(True).alias("_sch"))
    out = df.join(of_park, "park_id", "left").join(bank, ["_code", "date"], "left").join(school, ["_country", "date"], "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_hol", F.lit(False)).alias("is_bank_holiday"),
                      F.coalesce("_sch", F.lit(False)).alias("is_school_holiday"))
