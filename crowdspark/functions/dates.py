"""Date / time column expressions (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_MICROS = 15 * 60 * 1_000_000          # the 15-minute grid
TOLERANCE_MICROS = 450 * 1_000_000         # 7.5 minutes, inclusive


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_day(c) -> Column:
    """Text day with '/' or '-' separators (padded or not) -> DATE; junk -> NULL."""
    return F.try_to_date(F.translate(col_(c), "/", "-"), "yyyy-M-d")


def day_text(c, sep: str = "-") -> Column:
    """DATE -> 'YYYY-MM-DD' (or with '/' like the readings writer)."""
    return F.date_format(col_(c), f"yyyy{sep}MM{sep}dd")


def monday_weekday(c) -> Column:
    """0 = Monday .. 6 = Sunday (``dayofweek`` is Sunday-first)."""
    return F.weekday(col_(c))


def day_of_week_flags(c) -> list[Column]:
    """day_of_week_1..7 (1 = Monday); a NULL day compares False, not NULL."""
    wd = monday_weekday(c)
    return [F.coalesce(wd == (i - 1), F.lit(False)).alias(f"day_of_week_{i}") for i in range(1, 8)]


def month_flags(c) -> list[Column]:
    m = F.month(col_(c))
    return [F.coalesce(m == i, F.lit(False)).alias(f"month_{i}") for i in range(1, 13)]


def wall_clock_hhmm(iso_text) -> Column:
    """Local wall-clock 'HH:MM' of an ISO-8601 string, offset ignored (no zone shift).

    '2024-02-01T10:00:00+01:00' -> '10:00', '...T09:30:00Z' -> '09:30'. Anything that is
    not a full ISO date-time gives NULL.
    """
    s = col_(iso_text)
    ok = s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$")
    return F.when(ok, F.substring(s, 12, 5))


# Shapes of reading times: the day, the clock with optional seconds, and what may follow
# (fractions of a second, Z, an offset or a zone name: the wall-clock is kept), each with how it
# is written as year, month, day and clock.  A clock with am or pm has none of the shapes.
_CLOCK = r"([0-9]{1,2}:[0-9]{2})(:[0-9]{2})?(?:[.,][0-9]+)?\s*(?:Z|UTC|GMT.*|[+-][0-9]{2}:?[0-9]{2})?(?:\s*\(.*\))?$"
TIME_SHAPES = (
    (r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})[T ]+" + _CLOCK, "$1-$2-$3 $4$5"),
    (r"^(?:[A-Za-z]{3,9},? )?([A-Za-z]{3}) ([0-9]{1,2}),? ([0-9]{4}),? " + _CLOCK, "$3-$1-$2 $4$5"),
    (r"^(?:[A-Za-z]{3,9},? )?([0-9]{1,2}) ([A-Za-z]{3}) ([0-9]{4}),? " + _CLOCK, "$3-$2-$1 $4$5"),
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}),? " + _CLOCK, "$3-$1-$2 $4$5"),
)
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"


def parse_reading_time(c) -> Column:
    """Free-form reading time -> TIMESTAMP, keeping the wall-clock of the text.

    ISO-like text with '-' or '/', a blank or T, with or without seconds, fractions, Z or an
    offset; month-name text ('Oct 30 2024 10:02:00', '30 Oct 2024 10:02', browser strings with
    weekday and zone); and '10/30/2024 10:02' (month first).  A twelve-hour clock and anything
    else give NULL.  One pattern says the shape and puts the parts in order, a cast reads them.
    """
    s = F.trim(col_(c))
    text = F.lit(None).cast("string")
    for shape, order in reversed(TIME_SHAPES):
        text = F.when(s.rlike(shape), F.regexp_replace(s, shape, order)).otherwise(text)
    at = F.instr(F.lit(_MONTHS), F.lower(F.substring(text, 6, 3)))
    named = F.when(at > 0, F.concat(F.substring(text, 1, 5), ((at + 3) / 4).cast("int").cast("string"),
                                    F.substring(text, 9, 20)))
    return F.when(F.substring(text, 6, 1).rlike("[0-9]"), text).otherwise(named).try_cast("timestamp")


def time_metrics(c: str = "time") -> list[Column]:
    """Aggregates: texts, and how many of them (NULL aside) are not a time."""
    return [F.count(c).alias("texts"), F.count_if(F.col(c).isNotNull() & parse_reading_time(c).isNull()).alias("unparsed")]


def unparsed_times(df, c: str = "time"):
    """One row: ``time_metrics`` of a frame that nothing else is done with."""
    return df.agg(*time_metrics(c))


def micros(ts) -> Column:
    """Microseconds since epoch of a TIMESTAMP / TIMESTAMP_NTZ column (session zone UTC)."""
    return F.unix_micros(col_(ts).cast("timestamp"))


def slot_floor_micros(us) -> Column:
    return col_(us) - F.pmod(col_(us), F.lit(SLOT_MICROS))


def timestamp_from_micros(us) -> Column:
    return F.timestamp_micros(col_(us))


def hhmm(ts) -> Column:
    return F.date_format(col_(ts), "HH:mm")


def wall_clock_text(ts) -> Column:
    """'YYYY-MM-DD HH:MM:SS' with zero padding."""
    return F.date_format(col_(ts), "yyyy-MM-dd HH:mm:ss")


def date_days(start, end) -> Column:
    """Inclusive day sequence; an inverted range gives an empty array instead of raising."""
    s, e = col_(start), col_(end)
    return F.when(s <= e, F.sequence(s, e, F.expr("INTERVAL 1 DAY"))).otherwise(F.array().cast("array<date>"))


def year_month(c) -> Column:
    return F.date_format(col_(c), "yyyy-MM")
