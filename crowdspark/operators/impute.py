"""Exact median imputation in two scans, without funnelling a column into one task.

``F.median`` over a whole column is one group: every distinct value meets in a single final
task.  Here the first scan keeps a mergeable quantile sketch per column, which brackets the
column's middle; the second counts what lies below the bracket and on its ends and gathers only
the values strictly inside, a bounded few.  Counts decide, so the result is exact whatever the
sketch says: a bracket that misses the middle is widened and looked at again, and one that holds
too many values to gather is bracketed once more inside.  All columns go together, in one row of
partial results per task: no cell becomes a row, nothing is stored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import materialise


def order_statistics(values: DataFrame, ranks: Column) -> DataFrame:
    """(k, rank, v): for each group ``k`` of ``values`` (k, v) the values at the 0-based
    ``ranks``, an array expression over ``total`` (the group's number of values); NULLs skipped."""
    counted = values.where(F.col("v").isNotNull()).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    dealt = materialise(counted.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()), "ordered")
    parts = dealt.groupBy("k", "part").agg(F.sum("n").alias("n"))
    up_to = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = (parts.withColumn("before", F.sum("n").over(up_to) - F.col("n"))
             .withColumn("total", F.sum("n").over(Window.partitionBy("k"))))
    wanted = (parts.withColumn("rank", F.explode(ranks))
              .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
              .select("k", "part", "rank", "before"))
    inside = Window.partitionBy("k", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    # only the partitions that hold a wanted rank are read further
    held = dealt.join(wanted.select("k", "part").distinct(), ["k", "part"], "left_semi")
    running = held.withColumn("upto", F.sum("n").over(inside))
    found = running.join(wanted, ["k", "part"]).where(F.col("rank") < F.col("before") + F.col("upto"))
    return found.groupBy("k", "rank").agg(F.min("v").alias("v"))


ACCURACY = 10_000               # of the sketch: ranks are right to this part of the values
GATHERED = 100_000              # values of a column gathered at most


class _Bracket:
    """Where the middle values of a column are known to be: between ``lo`` and ``hi``."""

    def __init__(self, name: str) -> None:
        self.name, self.lo, self.hi, self.n = name, None, None, None
        self.below = 0                              # values up to and including lo
        self.held = None                            # values strictly between lo and hi
        self.margin = 2 / ACCURACY
        self.found: dict[int, float] = {}           # rank: value

    @property
    def ranks(self) -> list[int]:
        """Ranks of the one or two middle values not found yet."""
        return [r for r in sorted({(self.n - 1) // 2, self.n // 2}) if r not in self.found] if self.n else []

    @property
    def median(self) -> float | None:
        return sum(self.found.values()) / len(self.found) if self.found else None

    def inside(self) -> Column:
        v = F.col(f"`{self.name}`").cast("double")
        conditions = [v.isNotNull()] + [v > self.lo] * (self.lo is not None) + [v < self.hi] * (self.hi is not None)
        return F.when(reduce(and_, conditions), v)

    def sketch(self) -> list[Column]:
        """Number of values inside, and the ends of a narrower bracket."""
        v = self.inside()
        middle = [0.5] if self.held is None else [(r - self.below + 0.5) / self.held for r in self.ranks]
        ends = [max(0.0, middle[0] - self.margin), min(1.0, middle[-1] + self.margin)]
        return [F.count(v), F.percentile_approx(v, ends, ACCURACY)]

    def count(self, ends: list[float]) -> list[Column]:
        """Values below, on and between the ends, and those between if they are few."""
        v, (a, b) = self.inside(), ends
        between = (v > a) & (v < b)
        few = self.held * (2 * self.margin + 2 / ACCURACY) + 2 <= GATHERED
        return [F.count_if(v < a), F.count_if(v == a), F.count_if(between), F.count_if((v == b) & (v != a)),
                F.array_sort(F.collect_list(F.when(between, v))) if few else F.lit(None).cast("array<double>")]

    def settle(self, ends: list[float], below: int, on_a: int, between: int, on_b: int, values: list[float] | None) -> None:
        """Record the middle values that the counts give; else say where to look next."""
        for r in self.ranks:
            at = r - self.below - below
            if 0 <= at < on_a:
                self.found[r] = ends[0]
            elif on_a + between <= at < on_a + between + on_b:
                self.found[r] = ends[1]
            elif on_a <= at < on_a + between and values is not None:
                self.found[r] = values[at - on_a]
        left = [r - self.below - below for r in self.ranks]
        if left and on_a <= left[0] and left[-1] < on_a + between:
            self.lo, self.hi, self.held, self.below = *ends, between, self.below + below + on_a
            self.margin = 2 / ACCURACY
        elif left:                                  # the bracket missed one
            self.margin *= 8


def _settle_all(df: DataFrame, brackets: list[_Bracket]) -> None:
    """Find the middle values of all columns; a round is one aggregate for the sketches of the
    columns still open and one for their counts."""
    while brackets := [b for b in brackets if b.n is None or b.ranks]:
        got = df.agg(*[c.alias(f"s{i}_{k}") for i, b in enumerate(brackets) for k, c in enumerate(b.sketch())]).first()
        ends = []
        for i, b in enumerate(brackets):
            b.held = got[f"s{i}_0"]
            b.n = b.held if b.n is None else b.n
            ends.append(got[f"s{i}_1"])
        open_ = [(b, e) for b, e in zip(brackets, ends) if b.ranks]
        if open_:
            got = df.agg(*[c.alias(f"c{i}_{k}") for i, (b, e) in enumerate(open_) for k, c in enumerate(b.count(e))]).first()
            for i, (b, e) in enumerate(open_):
                b.settle(e, *[got[f"c{i}_{k}"] for k in range(5)])


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact (interpolated) median of each column, NULLs skipped; NULL for an empty column."""
    brackets = [_Bracket(c) for c in cols]
    _settle_all(df, brackets)
    return {b.name: b.median for b in brackets}


NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


def numeric_columns_with_nulls(df: DataFrame) -> list[str]:
    """Numeric columns holding a NULL, from one aggregate."""
    num = [n for n, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]
    if not num:
        return []
    r = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n_{i}") for i, c in enumerate(num)]).first()
    return [c for i, c in enumerate(num) if r[f"n_{i}"] > 0]


def _any_null(cols) -> Column:
    return F.greatest(F.lit(False), *[c.isNull() for c in cols])


def _filled(df: DataFrame, medians: dict[str, float | None]) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`"), F.lit(medians[c]).cast("double")).alias(c) if medians.get(c) is not None
            else F.col(f"`{c}`") for c in df.columns]


def missing_metrics(df: DataFrame, medians: dict[str, float | None]) -> list[Column]:
    """Rows with any NULL before imputation, after it, and dropped (= after), as aggregates."""
    before = F.count_if(_any_null([F.col(f"`{c}`") for c in df.columns]))
    after = F.count_if(_any_null(_filled(df, medians)))
    return [before.alias("rows_with_nulls_before"), after.alias("rows_with_nulls_after"), after.alias("rows_dropped")]


def missing_counters(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """One row: ``missing_metrics`` of a frame that nothing else is done with."""
    return df.agg(*missing_metrics(df, medians))


def fill_with_median(df: DataFrame, medians: dict[str, float | None] | None = None, drop_remaining: bool = True,
                     observed: Observation | None = None) -> tuple[DataFrame, dict[str, float | None]]:
    """Fill NULLs of numeric columns with this frame's exact medians (or given ones, e.g.
    stored training medians), then drop rows that still hold a NULL anywhere.

    ``observed`` gets ``missing_metrics`` from the job that reads the result: no scan of its own."""
    if medians is None:
        medians = exact_medians(df, numeric_columns_with_nulls(df))
    out = df if observed is None else df.observe(observed, *missing_metrics(df, medians))
    out = out.select(*_filled(df, medians))
    if drop_remaining:
        out = out.na.drop("any")
    return out, medians
