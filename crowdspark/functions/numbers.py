"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import col_


def round_half_even_int(c) -> Column:
    """Banker's rounding to an INT (``round`` in Spark is half-up; ``rint`` is half-even)."""
    return F.rint(col_(c)).cast("int")


def clip(c, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col_(c)))


def nan_to_null(c) -> Column:
    """NaN -> NULL and cast to DOUBLE, so averages and medians skip it like pandas does."""
    x = col_(c).cast("double")
    return F.when(~F.isnan(x), x)


def leading_int(text, sep: str = ":") -> Column:
    """Integer before the first separator ('09:30' -> 9); NULL when it is not a number."""
    return F.split(col_(text), sep, 2).getItem(0).try_cast("int")


def falsy_zero(c) -> Column:
    """NULL / missing -> 0 (a missing reading becomes an open zero wait)."""
    return F.coalesce(col_(c), F.lit(0))


def closed_flag(c) -> Column:
    """1 only when the value is exactly 0; NULL -> 0."""
    return F.coalesce((col_(c) == 0).cast("int"), F.lit(0))


def round_to(c, digits: int = 6) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same IEEE steps in every engine, so equal inputs give
    equal outputs even on an exact decimal tie (engines' ``round`` differ there)."""
    f = float(10 ** digits)
    return F.floor(col_(c) * F.lit(f) + F.lit(0.5)) / F.lit(f)


def exact_mean(c, scale: int = 2) -> Column:
    """Mean of values with at most ``scale`` decimals from an exact integer sum.

    A sum of doubles depends on the order the partitions are added in; the sum of the values
    in units of 10^-scale is exact, so the mean is the same on every run and layout.  NULLs
    are skipped; no value gives NULL.
    """
    f = float(10 ** scale)
    units = F.floor(col_(c) * F.lit(f) + F.lit(0.5))
    return F.try_divide(F.sum(units), F.count(col_(c))) / F.lit(f)
