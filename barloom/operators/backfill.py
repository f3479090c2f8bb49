"""Backfill of a running portfolio: predictions, picks, positions, state and run rows of all missing days at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.runs import SUCCESS, RunTables
from ..sources.scratch import discarded, materialise
from .intervals import points_in
from .portfolio import rebalance, schedule, scores_as_of, top_picks
from .state import regime_label
from .windows import as_of

PREDICTIONS = "date date, ticker string, score double, score_date date"
PICKS = "date date, ticker string, rank int, score double"
STATE = "date date, total_value double, cash double, n_positions long, gross_value double, regime_label string, source string"
POSITIONS = "date date, ticker string, qty double, entry_date date, entry_price double, current_mark double, mtm_value double"
SCHEMAS = {"predictions": PREDICTIONS, "picks": PICKS, "state": STATE, "positions": POSITIONS}


def daily_positions(trades: DataFrame, bars: DataFrame, days: DataFrame) -> DataFrame:
    """strategy_id, date, ticker, qty, entry_date, entry_price, current_mark, mtm_value on each of ``days`` from the first rebalance on.

    A rebalance enters all it holds anew; on the days up to the next one quantity and entry are carried and the mark is that
    of the day's bar, or the last one known. Each holding is laid out over its days by a join of intervals.
    """
    starts = trades.select("strategy_id", "k", F.col("date").alias("entry_date")).distinct()
    held = trades.where("value_after > 0").select("strategy_id", "k", "ticker", (F.col("value_after") / F.col("price")).alias("qty"), F.col("price").alias("entry_price"))
    rows = laid_out(starts, days, "entry_date").join(held, ["strategy_id", "k"])
    prices = bars.select("ticker", F.col("date").alias("_seen"), F.coalesce("adj_close", "close").alias("_price")).where("_price IS NOT NULL")
    marked = as_of(rows, prices, "date", "_seen", by=["ticker"])
    mark = F.coalesce("_price", "entry_price")
    return marked.select("strategy_id", "date", "ticker", "qty", "entry_date", "entry_price", mark.alias("current_mark"), (F.col("qty") * mark).alias("mtm_value"))


def laid_out(starts: DataFrame, days: DataFrame, start: str) -> DataFrame:
    """Each of ``starts`` (strategy_id, k, start) with the days from it to the one before the strategy's next start."""
    until = F.lead(start).over(Window.partitionBy("strategy_id").orderBy("k"))
    last = F.coalesce(F.date_sub(until, 1), F.lit("9999-12-31").cast("date"))
    return points_in(days.select("date").distinct(), starts.withColumn("_last", last), "date", start, "_last").drop("_last")


def daily_state(trades: DataFrame, positions: DataFrame, days: DataFrame, labels: DataFrame, source: str) -> DataFrame:
    """STATE of each day from the first rebalance on: cash of the last rebalance, positions at their marks, the day's regime."""
    cash = trades.select("strategy_id", "k", F.col("date").alias("_start"), F.col("cash_after").alias("cash")).distinct()
    spans = laid_out(cash, days, "_start").select("date", "cash")
    gross = positions.groupBy("date").agg(F.sum("mtm_value").alias("gross_value"), F.count(F.lit(1)).alias("n_positions"))
    known = spans.join(gross, "date", "left").join(labels.select("date", F.col("label").alias("regime_label")), "date", "left")
    worth = F.coalesce("gross_value", F.lit(0.0))
    return known.select(
        "date", (F.col("cash") + worth).alias("total_value"), "cash", F.coalesce("n_positions", F.lit(0)).cast("long").alias("n_positions"),
        worth.alias("gross_value"), F.coalesce("regime_label", F.lit("unknown")).alias("regime_label"), F.lit(source).alias("source"),
    )


def backfill(
    bars: DataFrame, scores: DataFrame, inputs: DataFrame, store: RunTables, run: str, start: str, end: str, every: int = 20, top: int = 10, capital: float = 1_000_000.0
) -> int:
    """Write the tables of every trading day in [start, end] that ``store`` has no run of; the number of days written.

    Scores are those of the latest date before a day; every ``every``-th day is a rebalance into the ``top`` best, whose
    trades follow from those before, so the path is computed once over all days and the missing ones are written together: four
    tables by partition overwrite, then a ledger row for each day. Where the store is empty, a seed row with the capital
    in cash stands on the day before the first. A second call finds no missing day and writes nothing. ``scores`` is (date,
    ticker, score), ``inputs`` (date, vol_regime, above, ret60) of ``regime_inputs``.
    """
    spark = bars.sparkSession
    days = bars.select("date").distinct().where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    with discarded(spark):
        missing = materialise(store.unrun(days))
        n = missing.count()
        if not n:
            return 0
        rebalances = materialise(schedule(days, every))
        picks = materialise(top_picks(scores_as_of(rebalances, scores), top).select("k", "date", "ticker", "rank", "score"))
        scenario = spark.createDataFrame([("live", top, 0.0, 1.0)], "strategy_id string, n_positions int, brokerage double, slip_scale double")
        trades = materialise(rebalance(picks.select(F.lit("live").alias("strategy_id"), "k", "date", "ticker"), bars, scenario, capital))
        positions = materialise(daily_positions(trades, bars, missing))
        labels = inputs.select("date", regime_label(F.col("vol_regime"), F.col("above"), F.col("ret60")).alias("label"))
        state = daily_state(trades, positions, missing, labels, "BACKTEST")
        done = missing.join(picks.groupBy("date").agg(F.count(F.lit(1)).alias("n_picks")), "date", "left")
        done = done.select("date", F.lit(SUCCESS).alias("status"), F.coalesce("n_picks", F.lit(0)).cast("int").alias("n_picks"), F.lit("BACKTEST").alias("source"))
        predictions = scores_as_of(missing.withColumn("k", F.lit(0)), scores).where("score IS NOT NULL").select("date", "ticker", "score", "score_date")
        if store.ledger().isEmpty():
            seed = days.agg(F.date_sub(F.min("date"), 1).alias("date"))
            money = [F.lit(capital).alias("total_value"), F.lit(capital).alias("cash"), F.lit(0).cast("long").alias("n_positions"), F.lit(0.0).alias("gross_value")]
            state = state.unionByName(seed.select("date", *money, F.lit("choppy").alias("regime_label"), F.lit("BACKTEST").alias("source")))
            done = done.unionByName(seed.select("date", F.lit(SUCCESS).alias("status"), F.lit(0).alias("n_picks"), F.lit("BACKTEST").alias("source")))
        tables = {"predictions": predictions, "picks": picks.join(missing, "date", "left_semi").select("date", "ticker", "rank", "score"), "state": state, "positions": positions}
        store.replace(run, {name: rows.select([x.split()[0] for x in SCHEMAS[name].split(", ")]) for name, rows in tables.items()}, done)
        return n
