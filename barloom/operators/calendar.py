"""Trading calendars: spines, special sessions, neighbours, snapping and quarter arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import as_of


def spine(bars: DataFrame) -> DataFrame:
    """Distinct dates of all tickers."""
    return bars.select("date").distinct()


def within(days: DataFrame, start: str, stop: str) -> DataFrame:
    """Trading days from start to stop, both included."""
    return days.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") <= F.lit(stop).cast("date")))


def regular(days: DataFrame, special: DataFrame) -> DataFrame:
    """Trading days that are not special sessions."""
    return days.join(special.select("date"), "date", "left_anti")


def flagged(days: DataFrame, special: DataFrame) -> DataFrame:
    """Adds ``is_special``."""
    s = special.select("date", F.lit(True).alias("_s")).distinct()
    return days.join(s, "date", "left").withColumn("is_special", F.col("_s").isNotNull()).drop("_s")


def neighbours(dates: DataFrame, days: DataFrame) -> DataFrame:
    """dates with ``next_day`` strictly after and ``prev_day`` strictly before, among the trading days."""
    after = days.select(F.col("date").alias("next_day"))
    before = days.select(F.col("date").alias("prev_day"))
    return as_of(as_of(dates, after, "date", "next_day", strict=True, forward=True), before, "date", "prev_day", strict=True)


def snapped(dates: DataFrame, days: DataFrame) -> DataFrame:
    """dates with ``on_or_before`` and ``on_or_after``, the nearest trading days including the date itself."""
    before = days.select(F.col("date").alias("on_or_before"))
    after = days.select(F.col("date").alias("on_or_after"))
    return as_of(as_of(dates, before, "date", "on_or_before"), after, "date", "on_or_after", forward=True)


def statistics(days: DataFrame, special: DataFrame) -> DataFrame:
    """n_days, n_special, first_day, last_day."""
    return flagged(days, special).agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if("is_special").alias("n_special"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
    )


def date_range(bounds: DataFrame) -> DataFrame:
    """All calendar dates of each row's [first, last]."""
    return bounds.select(F.explode(F.sequence("first", "last")).alias("date"))


def project_weekdays(starts: DataFrame, special: DataFrame, n: int) -> DataFrame:
    """date, projected: the n-th weekday after each date that is no special session."""
    far = F.date_add("date", 2 * n + 60)
    ahead = starts.select("date", F.explode(F.sequence(F.date_add("date", 1), far)).alias("day")).where(F.weekday("day") < 5)
    ahead = ahead.join(special.select(F.col("date").alias("day")), "day", "left_anti")
    w = Window.partitionBy("date").orderBy("day")
    return ahead.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == n).select("date", F.col("day").alias("projected"))
