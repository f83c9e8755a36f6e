"""Mixing sources to target weights.

Every row gets a hash-random key.  Within its source the key's range index is the first sort
level: word counts are summed per (source, range), the sums before each range come from a
window over the ranges, and only inside a range are rows ordered by key.  These are the
distributed prefix sums at which a source's budget is cut exactly; whole epochs come first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORDS, partitions, stored, text_rows

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = 17


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
                   most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources by code point, null last, weigh ``weights`` in turn.  ``share`` of all sizes is dealt
    by weight; no source gets over ``most`` times its size, and what it cannot take goes to the
    others by weight until none is above.  That fixed point caps the sources in order of
    size / weight, so one window over the per-source sums finds it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = (per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                            (turn % len(weights) + 1).cast("int")))
           .withColumn("cap", F.col("source_size").cast("double") * most))
    up_to = (Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
             .rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (per.withColumn("cap_sum", F.sum("cap").over(up_to)).withColumn("w_sum", F.sum("w").over(up_to))
           .withColumn("all_w", F.sum("w").over(whole))
           .withColumn("goal", F.sum("source_size").over(whole).cast("double") * share))
    capped = F.col("cap_sum") + F.col("cap") / F.col("w") * (F.col("all_w") - F.col("w_sum")) < F.col("goal")
    per = (per.withColumn("capped", capped)
           .withColumn("rest", F.col("goal") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(whole))
           .withColumn("free_w", F.sum(F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("w"))).over(whole)))
    level = F.col("rest") / F.nullif(F.col("free_w"), F.lit(0.0)) * F.col("w")
    return per.select("source", "source_size",
                      F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), level)).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: int = SEED,
                ranges: int | None = None) -> DataFrame:
    """row_key, doc_id, size, source_size, target, taken of every row.

    A size is the text's number of words (null: 0).  ``taken`` counts the words the mix takes of
    the row: its size once per whole epoch, and in the last, partial epoch what lies before the
    cut in key order; the row on the cut gives just its words up to it.  So the words taken of a
    source are its target to the nearest word.  The key hashes id and text, so null and repeated
    ids spread; only rows equal in both tie, and they are ordered by place.  Same input, same mix.
    """
    spark = docs.sparkSession
    ranges = ranges or max(64, 4 * partitions(spark))
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text")))
    rows = stored(text_rows(docs, id_col, text_col, F.col(source_col).cast("string").alias("source")).select(
        "row_key", "doc_id", "source", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("size"),
        key.alias("key")), "mix-sizes")
    # the first 8 hex digits as a fraction of 2^32 give the range: same order as the key
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("range", F.shiftright(place * F.lit(ranges), 32))
    targets = source_targets(rows, weights, share, most)
    sums = (rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
            .withColumn("base", F.coalesce(F.sum("n").over(
                Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    t = targets.alias("t")
    cuts = (sums.alias("s").join(t, F.col("s.source").eqNullSafe(F.col("t.source")))
            .select(F.col("s.source").alias("cut_source"), F.col("s.range").alias("cut_range"),
                    "base", "source_size", "target"))
    inside = (Window.partitionBy("source", "range").orderBy("key", "doc_id", "row_key")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("range") == F.col("cut_range")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    budget = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + F.lit(0.5))
    left = F.col("budget") - F.col("base") - F.col("inside")
    return (joined.withColumn("epochs", epochs.cast("long")).withColumn("budget", budget.cast("long"))
            .select("row_key", "doc_id", "size", "source_size", "target",
                    (F.col("epochs") * F.col("size")
                     + F.greatest(F.lit(0), F.least(left, F.col("size")))).cast("long").alias("taken")))
