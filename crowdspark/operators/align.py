"""Align raw readings to the 15-minute grid: nearest reading per slot, within 7.5 minutes.

No slot grid is joined against readings (that would be slots x readings per ride).  A slot
can only take a reading within 7.5 minutes of it, so each reading proposes the slot nearest to
it, and both neighbours only when it lies exactly between them.  A hash aggregate keeps, per
(ride-day, slot), the reading with the smallest distance, ties to the earliest reading: the
order (distance, side, id) is one fixed-width decimal, which hash aggregation can update in
place (a struct or text order would force a sort of all readings).  Slots between the first and
last reading that no reading reaches stay absent, as do slots outside that range (they are
always farther than 7.5 minutes from every reading).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import SLOT_MICROS, TOLERANCE_MICROS, hhmm, micros, slot_floor_micros, timestamp_from_micros


def slot_candidates(readings: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Each reading with its nearest slot (microseconds) and absolute distance, and with both
    neighbours when it lies exactly between them (the tolerance is inclusive)."""
    us = micros(ts_col)
    floor = slot_floor_micros(us)
    past = F.col("_us") - floor
    low, high = floor, floor + F.lit(SLOT_MICROS)
    near = (F.when(past < TOLERANCE_MICROS, F.array(low)).when(past > TOLERANCE_MICROS, F.array(high))
            .otherwise(F.array(low, high)))
    c = (readings.where(F.col(ts_col).isNotNull()).withColumn("_us", us)
         .withColumn("slot_us", F.explode(near)))
    return c.withColumn("_diff", F.abs(F.col("_us") - F.col("slot_us")))


def nearest_order(id_col: str = "id") -> F.Column:
    """(distance, earlier side first, id) as one DECIMAL(38).

    The distance is at most 450,000,000 microseconds and doubled below 2^30; ids are shifted to
    0 .. 2^64 - 1.  The largest value is below 2^94 < 10^29, so the packing cannot overflow; a
    NULL id comes first, like the smallest one."""
    side = F.when(F.col("_us") > F.col("slot_us"), 1).otherwise(0)
    wide = (F.col("_diff") * 2 + side).cast("decimal(10,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)")
    own = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    return (wide + (own.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)"))).cast("decimal(38,0)")


def align_to_slots(readings: DataFrame, keys=("date", "ride_id"), ts_col: str = "ts",
                   order_col: str = "id", values=("queue_time", "is_closed")) -> DataFrame:
    """Per (keys, slot): the nearest reading's values; ties -> earliest time, then ``order_col``.

    Output: keys, slot (TIMESTAMP), time_of_day ('HH:MM'), values.  A reading after 23:52:30
    may fill the 00:00 slot of the next day (kept under its own day key).
    """
    c = slot_candidates(readings, ts_col).withColumn("_order", nearest_order(order_col))
    g = c.groupBy(*keys, "slot_us").agg(*[F.min_by(v, "_order").alias(v) for v in values])
    slot = timestamp_from_micros(F.col("slot_us"))
    return g.select(*keys, slot.alias("slot"), hhmm(slot).alias("time_of_day"), *values)


def slot_grid(first_ts, last_ts) -> F.Column:
    """Standalone grid from floor(first) to ceil(last) every 15 minutes (array of TIMESTAMP)."""
    lo = timestamp_from_micros(slot_floor_micros(micros(first_ts)))
    hi_us = micros(F.date_trunc("minute", last_ts))        # the ceiling ignores seconds
    hi = timestamp_from_micros(F.when(F.pmod(hi_us, F.lit(SLOT_MICROS)) == 0, hi_us)
                               .otherwise(slot_floor_micros(hi_us) + F.lit(SLOT_MICROS)))
    return F.sequence(lo, hi, F.expr("INTERVAL 15 MINUTES"))
