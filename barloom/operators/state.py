"""Daily state of a running portfolio as idempotent table jobs: ledgers, cadence, regime labels and overview tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import as_of

CHOPPY = 0.03


def replace_dates(stored: DataFrame, new: DataFrame, key: str = "date") -> DataFrame:
    """``stored`` with all rows of the keys that ``new`` holds replaced by it: the table form of an overwrite by partition."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def pending_days(days: DataFrame, runs: DataFrame) -> DataFrame:
    """Trading days without a successful run."""
    return days.join(runs.where("status = 'SUCCESS'").select(F.col("run_date").alias("date")), "date", "left_anti")


def latest_by(df: DataFrame, key: str) -> DataFrame:
    """The rows of the largest key."""
    return df.join(df.agg(F.max(key).alias(key)), key)


def runs_between(runs: DataFrame, after: str, upto: str) -> DataFrame:
    return runs.where((F.col("run_date") > F.lit(after).cast("date")) & (F.col("run_date") <= F.lit(upto).cast("date")))


def cadence(positions: DataFrame, runs: DataFrame, today: str, every: int = 20) -> DataFrame:
    """newest_entry, days_since, due: runs after the newest entry up to today that were no holiday, and today itself."""
    t = F.lit(today).cast("date")
    newest = positions.agg(F.max("entry_date").alias("newest_entry"))
    past = runs.where((F.col("run_date") < t) & (F.col("status") != "HOLIDAY")).select("run_date")
    counted = newest.join(past, F.col("run_date") > F.col("newest_entry"), "left")
    n = (F.count("run_date") + 1).alias("days_since")
    return counted.groupBy("newest_entry").agg(n).withColumn("due", F.col("newest_entry").isNull() | (F.col("days_since") >= every))


def regime_label(vol_regime: Column, above: Column, ret60: Column) -> Column:
    """choppy for small or contradictory moves; otherwise bulls by volatility, and bears of high volatility."""
    up = ret60 > 0
    return (
        F.when(vol_regime.isNull() | above.isNull() | ret60.isNull() | F.isnan(ret60), "unknown")
        .when(F.abs(ret60) < CHOPPY, "choppy")
        .when((above == 1) != up, "choppy")
        .when(up & (vol_regime == 0), "calm_bull")
        .when(up, "trending_bull")
        .when(vol_regime == 2, "high_vol_bear")
        .otherwise("choppy")
    )


def regime_inputs(features: DataFrame, index: DataFrame) -> DataFrame:
    """date, vol_regime, above, ret60 as known before each date: the first known values of the latest earlier date."""
    daily = features.groupBy(F.col("date").alias("seen")).agg(
        F.min_by("vol_regime", F.when(F.col("vol_regime").isNotNull(), F.col("ticker"))).alias("vol_regime"), F.max("above").alias("above")
    )
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    ret = index.select(F.col("date").alias("seen"), (F.try_divide("index_close", F.lag("index_close", 60).over(w)) - 1).alias("ret60"))
    days = features.select("date").distinct()
    return as_of(days, daily.join(ret, "seen", "left"), "date", "seen", strict=True)


def value_curve(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored values, then the live ones strictly after the stored end, with their origin and whether they are still to come."""
    end = stored.groupBy("series").agg(F.max("date").alias("_end"))
    newer = live.join(end, "series", "left").where(F.col("_end").isNull() | (F.col("date") > F.col("_end"))).drop("_end")
    return stored.withColumn("origin", F.lit("stored")).unionByName(newer.withColumn("origin", F.lit("live")))


def todays_basket(positions: DataFrame, picks: DataFrame) -> DataFrame:
    """Positions with the rank their ticker had when it entered, unranked last."""
    r = picks.select(F.col("date").alias("entry_date"), "ticker", "rank")
    return positions.join(r, ["entry_date", "ticker"], "left").orderBy(F.col("rank").asc_nulls_last(), "ticker")


def last_window(rebalances: DataFrame, values: DataFrame) -> DataFrame:
    """start, stop and each series' return between the last two rebalances; nothing unless every series has both values."""
    last = rebalances.select("date").distinct().orderBy(F.col("date").desc()).limit(2)
    ends = last.agg(F.min("date").alias("start"), F.max("date").alias("stop"), F.count(F.lit(1)).alias("n")).where("n = 2")
    v = values.join(F.broadcast(ends), (F.col("date") == F.col("start")) | (F.col("date") == F.col("stop")))
    per = v.groupBy("series", "start", "stop").agg(F.count(F.lit(1)).alias("n"), (F.max_by("total_value", "date") / F.min_by("total_value", "date") - 1).alias("ret"))
    all_ = values.select("series").distinct().join(per, "series", "left")
    known = F.min(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(1)))  # one row per series
    return all_.withColumn("_k", known).where("_k = 2").select("series", "start", "stop", "ret")


def rank_movement(predictions: DataFrame, today: str) -> DataFrame:
    """ticker, rank, previous_rank, delta between today's predictions and those of the date before; null for new tickers."""
    t = F.lit(today).cast("date")
    w = Window.partitionBy("date").orderBy(F.col("score").desc(), "ticker")
    ranked = predictions.where("score IS NOT NULL").withColumn("rank", F.row_number().over(w))
    before = predictions.where(F.col("date") < t).agg(F.max("date").alias("date"))
    old = ranked.join(before, "date").select("ticker", F.col("rank").alias("previous_rank"))
    now = ranked.where(F.col("date") == t).select("ticker", "rank")
    return now.join(old, "ticker", "left").withColumn("delta", F.col("previous_rank") - F.col("rank"))


def chart_window(values: DataFrame, days: int | None) -> DataFrame:
    """Values of the last days before the latest date, or all."""
    if days is None:
        return values
    end = values.agg(F.max("date").alias("_end"))
    return values.join(F.broadcast(end), F.col("date") >= F.date_sub("_end", days)).drop("_end")
