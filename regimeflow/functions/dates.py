"""Date recognition, parsing and cyclical date features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The date used when nothing earlier parses, and the two periods of the cyclical features.
FALLBACK_DATE = "2000-01-01"
DAYS_PER_YEAR = 365
MONTHS_PER_YEAR = 12

NATIVE, COMPACT, GENERIC, EPOCH_NANOS = "native", "yyyymmdd", "generic", "epoch_nanos"


def is_native_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def parse_compact(c: Column) -> Column:
    """``yyyyMMdd`` held in an integer or a string; anything else is null."""
    return F.try_to_date(c.cast("string"), "yyyyMMdd")


#: What text with year, month and day may look like: a pattern it must match as a whole, and how to read it (None: ISO).
GENERIC_FORMATS = (
    (r"\d{4}-\d{1,2}-\d{1,2}([T ].*)?", None),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy"),
)


def parse_generic(c: Column) -> Column:
    """ISO dates and timestamps and the formats above; clock times, bare years and anything else are null."""
    text = F.trim(c.cast("string"))
    return F.coalesce(*[F.when(text.rlike(f"^({pattern})$"), text.try_cast("timestamp").cast("date") if form is None else F.try_to_date(text, form))
                        for pattern, form in GENERIC_FORMATS])


def parse_epoch_nanos(c: Column) -> Column:
    """A number read as nanoseconds since 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c.cast("double") / 86_400e9).cast("int"))


def parse_date(c: Column, date_format: str) -> Column:
    if date_format == NATIVE:
        return c.cast("date")
    if date_format == COMPACT:
        return parse_compact(c)
    if date_format == EPOCH_NANOS:
        return parse_epoch_nanos(c)
    return parse_generic(c)


def parse_any(c: Column, dtype: T.DataType) -> Column:
    """Report dates: native dates as they are, everything else as ``yyyyMMdd``."""
    return c.cast("date") if is_native_date(dtype) else parse_compact(c)


def cyclical_features(date: Column, year_min: Column, year_max: Column) -> list[Column]:
    """sin/cos of day-of-year, sin/cos of month, and the year scaled into [0, 1]."""
    day = F.lit(2 * math.pi) * F.dayofyear(date) / F.lit(DAYS_PER_YEAR)
    month = F.lit(2 * math.pi) * F.month(date) / F.lit(MONTHS_PER_YEAR)
    year = (F.year(date) - year_min) / (year_max - year_min + F.lit(1e-6))
    return [F.sin(day), F.cos(day), F.sin(month), F.cos(month), year]


CYCLICAL_SUFFIXES = ("sin_doy", "cos_doy", "sin_month", "cos_month", "year_norm")


def week_ending_sunday(date: Column) -> Column:
    """The Sunday that closes the week; a Sunday is its own label."""
    return F.next_day(F.date_sub(date, 1), "SU")
