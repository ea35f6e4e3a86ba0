"""Calendar roll-ups of the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimeflow.functions.dates import week_ending_sunday
from regimeflow.operators.filters import TIMELINE_SHOCK, drop_bad_dates, is_high
from regimeflow.scratch import materialize

DAY, WEEK, AUTO = "day", "week", "auto"
DAILY_LIMIT = 2000  # fixed value: with ``AUTO`` a longer calendar is shown by week


def timeline_daily(scored: DataFrame, time_col: str) -> DataFrame:
    """Per day the highest score and the most common regime (the lowest one on ties)."""
    return _top_and_mode(drop_bad_dates(scored, time_col), F.col("date"))


def _top_and_mode(df: DataFrame, period: Column) -> DataFrame:
    """Counted per period and regime first: a busy day shrinks to one row per regime before it is shuffled."""
    per_regime = df.groupBy(period.alias("date"), "regime").agg(
        F.max("shock_score").alias("top"), F.count("regime").alias("n"))
    return per_regime.groupBy("date").agg(
        F.max("top").alias("shock_score"), F.max_by("regime", F.struct("n", -F.col("regime"))).alias("regime"))


def timeline_weekly(daily: DataFrame) -> DataFrame:
    """Weeks labelled by their Sunday, from the daily table; a week without days has a null score and regime 0."""
    weeks = _top_and_mode(daily, week_ending_sunday(F.col("date")))
    calendar = weeks.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(
        F.explode(F.expr("sequence(lo, hi, interval 7 days)")).alias("date")
    )
    return calendar.join(weeks, "date", "left").fillna(0, ["regime"])


def timeline(scored: DataFrame, time_col: str, grain: str = DAY) -> DataFrame:
    """Per day or week, with the high-shock flag; the grain follows the calendar's length only where ``AUTO`` is asked for."""
    if grain not in (DAY, WEEK, AUTO):
        raise ValueError(f"grain {grain!r} is none of {DAY}, {WEEK}, {AUTO}")
    rolled = timeline_daily(scored, time_col)
    if grain != DAY:
        rolled = materialize(rolled, "daily")  # a row per day: read by the count and twice by the weeks
        if grain == WEEK or rolled.count() > DAILY_LIMIT:
            rolled = timeline_weekly(rolled)
    return rolled.withColumn("high_shock", is_high(F.col("shock_score"), TIMELINE_SHOCK)).orderBy("date")
