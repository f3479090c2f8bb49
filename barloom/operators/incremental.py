"""The feature table kept up to date: new dates are computed from the rows they look back on and from the state of recursions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import per_ticker
from ..functions.smoothers import COLUMNS, STATE, resumed
from ..sources.runs import SUCCESS, RunTables
from ..sources.scratch import discarded, materialise
from .cross_section import market_returns, with_beta
from .pipeline import METADATA, assembled, closure
from .regime import mean_correlation, regime
from .windows import change

#: Sums without a bound, which go on from their last value.
CARRIED = ("obv", "accum_dist_line", "consecutive_days_above_sma50")
WHOLE = ("vol_regime", "trend_aligned_5_20_50", "momentum_div_flag", "volume_trend_alignment", "trend_strength_smoothed", "nifty_above_sma_200", "up_streak_length", "consecutive_days_above_sma50")
FEATURES = "date date, ticker string, " + ", ".join(f"{name} {'long' if name in WHOLE else 'double'}" for name, *_ in METADATA)
SMOOTHED = "date date, ticker string, " + ", ".join(f"{name} double" for name in COLUMNS)
#: A ticker's recursions and sums after its last bar, and the date from which on its next bars look back.
ENDS = f"date date, ticker string, state {STATE}, obv double, accum_dist_line double, consecutive_days_above_sma50 long, back_to date"
LEVELS = "date date, index_close double, vix double"
TABLES = {"features": FEATURES, "smoothed": SMOOTHED, "ends": ENDS, "levels": LEVELS}
#: How many rows of a ticker the features of its next row need: the longest closure of look-backs.
LOOK_BACK = max(closure(name) for name, *_ in METADATA)


def update(bars: DataFrame, special: DataFrame, store: RunTables, run: str, look_back: int = LOOK_BACK) -> int:
    """Write the features of the dates of ``bars`` after the last one that ``store`` holds; the number of dates written.

    ``bars`` (with sector) is a table whose scan can be pruned by date: of the past only the last ``look_back`` rows of each
    ticker are read, counted in its own rows whatever days lie between, from the date that the last update noted. That is as far as
    windows reach, windows of features included. Recursions go on from their state, unbounded sums from their last values, and
    past recursive columns are read back. So the table equals a recomputation of everything, column by column.
    Cross-sections and regimes are made of the new dates only; index levels are one row a date and kept.

    Features, recursions, ends and levels of a run are written by partition overwrite of the new dates and become visible
    together. A run that fails is repeated without a trace. Dates come whole: bars of dates that are written already are not
    looked at. A range that has no single move in all rows looked back on counts as directionless.
    """
    spark, market_of = bars.sparkSession, bars.select("date", "ticker", "sector", "open", "high", "low", "close", "volume", "adj_close")
    with discarded(spark):
        ends = store.read("ends", ENDS)
        last = ends.groupBy("ticker").agg(F.max_by(F.struct(*[f for f in ends.columns if f != "ticker"]), "date").alias("e")).select("ticker", "e.*")
        last = materialise(last.withColumnRenamed("date", "last_date"))
        known, begin = store.visible().agg(F.max("date")).first()[0], last.agg(F.min("back_to")).first()[0]
        near = market_of if known is None else market_of.where(F.col("date") >= F.lit(begin))
        fresh = F.lit(True) if known is None else F.col("date") > F.lit(known)
        near = near.withColumn("is_new", fresh)
        new = materialise(near.where("is_new"))
        dates = materialise(new.select("date").distinct())
        n = dates.count()
        if not n:
            return 0
        made = materialise(resumed(new, last.select("ticker", "state")))
        place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))
        old = near.where("NOT is_new").withColumn("_place", place).where(F.col("_place") <= look_back)
        seed = F.when(F.col("_place") == 1, F.struct(*CARRIED)).alias("seed")
        old = old.join(last.select("ticker", *CARRIED), "ticker", "left").select(*near.columns, seed)
        old = old.join(store.read("smoothed", SMOOTHED).where(F.col("date") >= F.lit(begin)) if known else store.read("smoothed", SMOOTHED), ["date", "ticker"], "left")
        both = materialise(old.unionByName(made.drop("state").withColumn("seed", F.lit(None).cast(old.schema["seed"].dataType))))
        levels = materialise(_levels(both, store.read("levels", LEVELS)))
        special = materialise(special)
        regimes = regime(levels, levels.where("index_close IS NOT NULL"), levels).join(mean_correlation(both), "date", "left").join(dates, "date", "left_semi")
        market = materialise(market_returns(levels.select("date", "index_close")))
        wide = materialise(with_beta(per_ticker(both), market).where("is_new").drop("is_new", "seed"))
        rows = assembled(wide, materialise(regimes), special)
        tables = {
            "features": rows.select([F.col(x.split()[0]).cast(x.split()[1]) for x in FEATURES.split(", ")]),
            "smoothed": made.select("date", "ticker", *COLUMNS),
            "ends": _ends(both, made, wide.select("date", "ticker", *CARRIED), look_back),
            "levels": levels.join(dates, "date", "left_semi"),
        }
        store.replace(run, tables, dates.withColumn("status", F.lit(SUCCESS)))
        return n


def _levels(both: DataFrame, stored: DataFrame) -> DataFrame:
    """The levels of all dates: those stored, and of the new ones the index and the deviation of returns."""
    moved = both.withColumn("r", change(F.col("adj_close"), 1)).where("is_new")
    index = (F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("index_close")
    return stored.unionByName(moved.groupBy("date").agg(index, F.stddev_samp("r").alias("vix")))


def _ends(both: DataFrame, made: DataFrame, sums: DataFrame, look_back: int) -> DataFrame:
    """A row for each ticker with new bars: its state and sums after the last of them, and the date of its last row but ``look_back``."""
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))
    back = both.select("ticker", "date", place.alias("_place")).where(F.col("_place") <= look_back).groupBy("ticker").agg(F.min("date").alias("back_to"))
    ended = made.where("state IS NOT NULL").select("date", "ticker", "state")
    return ended.join(sums, ["date", "ticker"]).join(back, "ticker").select([x.split()[0] for x in ENDS.split(", ")])
