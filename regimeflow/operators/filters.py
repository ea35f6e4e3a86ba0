"""Row filters and train / inference splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimeflow.functions.dates import is_native_date, parse_any, parse_compact, parse_generic
from regimeflow.operators.quantiles import cut_at_rank, orderable

HIGH_SHOCK, TIMELINE_SHOCK = 0.8, 0.75  # fixed values


def filter_group(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def split_by_date(df: DataFrame, time_col: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(before ``cutoff``, from ``cutoff`` on); ``cutoff`` is ``yyyyMMdd``.

    The literal takes the column's type, so both sides push down.  Text is parsed first (``yyyyMMdd`` or any accepted
    date format); text that is no date is on neither side, like null.
    """
    if time_col not in df.columns:
        raise ValueError(f"no column {time_col!r}")
    dtype = df.schema[time_col].dataType
    if is_native_date(dtype):
        limit = F.to_date(F.lit(cutoff), "yyyyMMdd").cast(dtype)
    elif isinstance(dtype, T.StringType):
        date, limit = F.coalesce(parse_compact(F.col(time_col)), parse_generic(F.col(time_col))), parse_compact(F.lit(cutoff))
        return df.where(date < limit), df.where(date >= limit)
    else:
        limit = F.lit(int(cutoff)).cast(dtype)
    return df.where(F.col(time_col) < limit), df.where(F.col(time_col) >= limit)


def split_by_fraction(df: DataFrame, order_cols: list[str], fraction: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """First ``int(n * fraction)`` rows in time order, and the rest, without sorting: both sides are filters of the scan.

    The row at the cut is found by counting.  Rows equal in ``order_cols`` are told apart by their other columns; rows
    equal in all of them are interchangeable, so of those the side before the cut gets the number that it lacks.
    """
    n_rows = df.count()
    cut = math.floor(n_rows * fraction)
    if cut <= 0 or cut >= n_rows:
        return df.limit(0) if cut <= 0 else df, df if cut <= 0 else df.limit(0)
    others = [c for c in orderable(df) if c not in order_cols]
    before, behind, on, left = cut_at_rank(df, [*order_cols, *others], cut, n_rows)
    if not left:
        return df.where(before), df.where(behind | on)
    alike = df.where(on)  # interchangeable rows; normally there is none to divide
    first = alike.limit(left)
    rest = alike.limit(1).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(alike.count() - left)))).drop("_copy")
    return df.where(before).unionByName(first), df.where(behind).unionByName(rest)


def after_key(df: DataFrame, order_cols: list[str], key: list[str | None]) -> Column:
    """Whether a row comes after the row with this order key (its columns as text; nulls come first)."""
    behind, alike = F.lit(False), F.lit(True)
    for c, text in zip(order_cols, key, strict=True):
        if text is None:
            larger, equal = F.col(c).isNotNull(), F.col(c).isNull()
        else:
            value = F.lit(text).cast(df.schema[c].dataType)
            larger, equal = F.col(c) > value, F.col(c) == value
        behind, alike = behind | (alike & larger), alike & equal
    return F.coalesce(behind, F.lit(False))


def drop_bad_dates(df: DataFrame, time_col: str, into: str = "date") -> DataFrame:
    parsed = df.withColumn(into, parse_any(F.col(time_col), df.schema[time_col].dataType))
    return parsed.where(F.col(into).isNotNull())


def is_high(score: Column, threshold: float = HIGH_SHOCK) -> Column:
    return score > F.lit(threshold)
