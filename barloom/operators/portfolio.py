"""Rebalanced top-N portfolios: schedules, picks, costs, slippage, the recursion over rebalances, and daily values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import points_in
from .windows import as_of, full

#: Rates of a delivery trade: fixed values.
STT_SELL = 0.001
EXCHANGE = 0.0000345
GST = 0.18
SEBI = 0.000001
STAMP_BUY = 0.00015
#: Slippage: largest share of daily turnover, basis points; beyond the last share the worst holds, and is flagged.
SLIPPAGE = ((0.001, 5.0), (0.005, 10.0), (0.01, 20.0))
WORST_BPS = 50.0


def schedule(days: DataFrame, every: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """k, date: every n-th trading day from the first day on or after ``start``."""
    d = days.select("date").distinct()
    if start:
        d = d.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        d = d.where(F.col("date") <= F.lit(end).cast("date"))
    n = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")) - 1  # one row per date
    return d.withColumn("_n", n).where(F.col("_n") % every == 0).select((F.col("_n") / every).cast("int").alias("k"), "date")


def adv(bars: DataFrame, n: int = 20) -> DataFrame:
    """date, ticker, adv: the mean traded value of the last n rows."""
    return bars.select("date", "ticker", full(F.avg, F.col("close") * F.col("volume"), n).alias("adv"))


def scores_as_of(rebalances: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores (date, ticker, score) of the latest date strictly before each rebalance: k, date, score_date, ticker, score."""
    days = scores.select(F.col("date").alias("score_date")).distinct()
    at = as_of(rebalances, days, "date", "score_date", strict=True)
    s = scores.select(F.col("date").alias("score_date"), "ticker", "score")
    return at.join(s, "score_date").select("k", "date", "score_date", "ticker", "score")


def missing_scores(found: DataFrame, tickers: DataFrame) -> DataFrame:
    """k, ticker: tickers of the universe without a score at a rebalance.

    Scores are counted first, and the universe is laid out only for the rebalances that fall short of it.
    """
    universe = tickers.select("ticker").distinct()
    known = found.join(universe, "ticker", "left_semi").groupBy("k").agg(F.countDistinct(F.when(F.col("score").isNotNull(), F.col("ticker"))).alias("n"))
    size = universe.agg(F.count(F.lit(1)).alias("size"))
    at_all = found.select("k").distinct().join(known, "k", "left")
    short = at_all.join(F.broadcast(size), F.coalesce("n", F.lit(0)) < F.col("size")).select("k")
    return short.join(universe).join(found.where("score IS NOT NULL"), ["k", "ticker"], "left_anti")


def top_picks(found: DataFrame, n: int) -> DataFrame:
    """The n best scores of each rebalance with their rank, ties by ticker."""
    w = Window.partitionBy("k").orderBy(F.col("score").desc(), "ticker")
    return found.where("score IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def trade_costs(value: Column, side: Column, brokerage: float | Column = 0.0) -> dict[str, Column]:
    """The charges of one leg by name, and their ``total``."""
    fee = brokerage if isinstance(brokerage, Column) else F.lit(float(brokerage))
    exchange = value * EXCHANGE
    parts = {
        "brokerage": fee,
        "stt": F.when(side == "sell", value * STT_SELL).otherwise(0.0),
        "exchange_charges": exchange,
        "gst": (fee + exchange) * GST,
        "sebi_charges": value * SEBI,
        "stamp_duty": F.when(side == "buy", value * STAMP_BUY).otherwise(0.0),
    }
    total = F.lit(0.0)
    for x in parts.values():
        total = total + x
    return parts | {"total": total}


def slippage_bps(value: Column, turnover: Column) -> Column:
    """Basis points by the trade's share of daily turnover: below the first bound, then up to each bound; worst without turnover."""
    share = F.try_divide(value, turnover)
    (a, low), (b, mid), (c, high) = SLIPPAGE
    known = F.when(share < a, low).when(share <= b, mid).when(share <= c, high).otherwise(WORST_BPS)
    return F.when(turnover.isNull() | (turnover <= 0), WORST_BPS).otherwise(known)


def legs(picks: DataFrame, bars: DataFrame) -> DataFrame:
    """All that the recursion needs of each rebalance: the new picks and those of the rebalance before, with growth and turnover.

    ``picks`` is (strategy_id, k, date, ticker). Prices are the last known at a date.
    """
    dates = picks.select("strategy_id", "k", "date").distinct()
    w = Window.partitionBy("strategy_id").orderBy("k")
    dates = dates.withColumns({"next_k": F.lead("k").over(w), "next_date": F.lead("date").over(w), "prev_date": F.lag("date").over(w)})
    now = picks.select("strategy_id", "k", "date", "ticker", F.lit(1).alias("is_pick"), F.lit(0).alias("was_pick"))
    held = picks.join(dates.where("next_k IS NOT NULL").drop("date", "prev_date"), ["strategy_id", "k"]).select(
        "strategy_id", F.col("next_k").alias("k"), F.col("next_date").alias("date"), "ticker", F.lit(0).alias("is_pick"), F.lit(1).alias("was_pick")
    )
    both = now.unionByName(held).groupBy("strategy_id", "k", "date", "ticker").agg(F.max("is_pick").alias("is_pick"), F.max("was_pick").alias("was_pick"))
    both = both.join(dates.select("strategy_id", "k", "prev_date"), ["strategy_id", "k"])
    prices = bars.select("ticker", F.col("date").alias("price_date"), F.col("adj_close").alias("price"))
    prices = prices.join(adv(bars).select("ticker", F.col("date").alias("price_date"), "adv"), ["ticker", "price_date"])
    both = as_of(both, prices, "date", "price_date", by=["ticker"])
    before = prices.select("ticker", F.col("price_date").alias("before_date"), F.col("price").alias("before"))
    both = as_of(both, before, "prev_date", "before_date", by=["ticker"])
    growth = F.when(F.col("was_pick") == 1, F.coalesce(F.try_divide("price", "before"), F.lit(1.0))).otherwise(1.0)
    return both.select("strategy_id", "k", "date", "ticker", "is_pick", "was_pick", growth.alias("growth"), F.coalesce("adv", F.lit(0.0)).alias("adv"), "price")


#: What one rebalance leaves of each leg.
TRADE = "strategy_id string, k int, date date, ticker string, side string, trade_value double, cost double, slip_bps double, flag boolean, value_after double, cash_after double, equity_before double, price double"
#: Columns of the legs that the fold reads.
FOLDED = ("strategy_id", "k", "date", "ticker", "is_pick", "growth", "adv", "price", "n_positions", "brokerage", "slip_scale")


def _total(x: np.ndarray) -> float:
    """The sum in order."""
    return float(np.cumsum(x)[-1]) if len(x) else 0.0


class Fold:
    """The cash and the held values of the strategy that is at hand, from rebalance to rebalance; no history is kept."""

    def __init__(self, capital: float):
        self.capital = capital
        self.strategy: str | None = None

    def step(self, legs: pa.Table) -> pa.RecordBatch:
        """Trades of one rebalance: its equity, the legs' goals, costs and slippage, what is held and left in cash."""
        strategy, ticker = legs["strategy_id"][0].as_py(), legs["ticker"].to_pylist()
        if strategy != self.strategy:
            self.strategy, self.cash, self.held = strategy, self.capital, {}
        growth, adv = (legs[c].to_numpy() for c in ("growth", "adv"))
        pick = legs["is_pick"].to_numpy() == 1
        n, fee, scale = (float(legs[c][0].as_py()) for c in ("n_positions", "brokerage", "slip_scale"))
        now = np.array([self.held.get(t, 0.0) for t in ticker]) * growth
        equity = self.cash + _total(now)
        goal = np.where(pick, equity / n, 0.0)
        size = np.where(np.abs(goal - now) >= 1.0, np.abs(goal - now), 0.0)
        traded, buy = size > 0.0, goal > now
        share = np.divide(size, adv, out=np.full(len(size), np.inf), where=adv > 0)
        (a, low), (b, mid), (c, high) = SLIPPAGE
        bps = np.select([share < a, share <= b, share <= c], [low, mid, high], WORST_BPS) * scale * traded
        slip = size * bps / 1e4
        exchange = size * EXCHANGE
        charges = fee + np.where(buy, 0.0, size * STT_SELL) + exchange + (fee + exchange) * GST + size * SEBI + np.where(buy, size * STAMP_BUY, 0.0)
        # slippage counts twice: in the price of the trade and as a cost beside the charges
        cost = np.where(traded, charges + slip, 0.0)
        held = np.where(pick, np.where(traded, goal, now), 0.0)
        self.cash = equity - _total(cost + slip + held)
        self.held = dict(zip(ticker, held.tolist(), strict=True))
        m = len(ticker)
        side = pa.array(np.where(buy, "buy", "sell").tolist(), pa.string(), mask=~traded)
        columns = [legs[x].combine_chunks() for x in ("strategy_id", "k", "date", "ticker")]
        columns += [side, *(pa.array(x) for x in (size, cost, bps, traded & (bps >= WORST_BPS * scale), held, np.full(m, self.cash), np.full(m, equity)))]
        return pa.RecordBatch.from_arrays([*columns, legs["price"].combine_chunks()], [x.split()[0] for x in TRADE.split(", ")])


def _rebalances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The legs of one rebalance after the other, of rows sorted by strategy and rebalance: batches may end anywhere."""
    waiting: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        k, strategy = table["k"].to_numpy(), np.array(table["strategy_id"].to_pylist(), object)
        cuts = [0, *(1 + np.flatnonzero((k[1:] != k[:-1]) | (strategy[1:] != strategy[:-1]))).tolist(), len(k)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            part = table.slice(i, j - i)
            if waiting and (waiting[0]["k"][0] != part["k"][0] or waiting[0]["strategy_id"][0] != part["strategy_id"][0]):
                yield pa.concat_tables(waiting)
                waiting = []
            waiting.append(part)
    if waiting:
        yield pa.concat_tables(waiting)


def _folded(capital: float):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold(capital)
        for legs_of_one in _rebalances(batches):
            yield fold.step(legs_of_one)

    return each


def rebalance(picks: DataFrame, bars: DataFrame, scenarios: DataFrame, capital: float = 1_000_000.0) -> DataFrame:
    """The legs of every rebalance of every strategy with side, value, cost and what is held and left in cash after it.

    A rebalance splits the equity evenly over ``n_positions``; gaps under 1 are left alone, and what remains of a
    dropped name then is taken as cash. Prices, growth and turnover of all legs are joins and windows; what is left
    is a recursion in the equity of a strategy, as its value at one rebalance follows from that before. Legs are dealt by strategy
    and sorted by rebalance, and one pass over each partition folds them: it holds the legs of the current rebalance
    and the values of the one before, so that a strategy of thousands of tickers over decades takes no more memory than one of its
    rebalances. Strategies run in parallel. ``scenarios`` has strategy_id, n_positions, brokerage and slip_scale.
    """
    rows = legs(picks, bars).join(scenarios.select("strategy_id", "n_positions", "brokerage", "slip_scale"), "strategy_id")
    kept = rows.select(*FOLDED).withColumns({"strategy_id": F.col("strategy_id").cast("string"), "k": F.col("k").cast("int"), "growth": F.col("growth").cast("double")})
    return kept.repartition("strategy_id").sortWithinPartitions("strategy_id", "k", "ticker").mapInArrow(_folded(float(capital)), TRADE)


def daily_values(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """strategy_id, date, total_value, cash, n_positions, gross_value on each trading day from the first rebalance on.

    Each day is valued with the holdings of the latest rebalance and the last known price of each of them.
    """
    days = bars.select("date").distinct()
    starts = trades.select("strategy_id", "k", F.col("date").alias("start")).distinct()
    until = F.lead("start").over(Window.partitionBy("strategy_id").orderBy("k"))
    last = F.coalesce(F.date_sub(until, 1), F.lit("9999-12-31").cast("date"))
    spans = points_in(days, starts.withColumn("last", last), "date", "start", "last")
    held = trades.where("value_after > 0").select("strategy_id", "k", "ticker", "value_after", F.col("price").alias("price_then"))
    rows = spans.select("strategy_id", "k", "date").join(held, ["strategy_id", "k"])
    prices = bars.select("ticker", F.col("date").alias("price_date"), F.col("adj_close").alias("price_now"))
    rows = as_of(rows, prices, "date", "price_date", by=["ticker"])
    value = F.col("value_after") * F.coalesce(F.try_divide("price_now", "price_then"), F.lit(1.0))
    gross = rows.groupBy("strategy_id", "k", "date").agg(F.sum(value).alias("gross_value"), F.count(F.lit(1)).alias("n_positions"))
    cash = trades.select("strategy_id", "k", F.col("cash_after").alias("cash")).distinct()
    return (
        spans.select("strategy_id", "k", "date")
        .join(gross, ["strategy_id", "k", "date"], "left")
        .join(cash, ["strategy_id", "k"])
        .select(
            "strategy_id", "date", (F.coalesce("gross_value", F.lit(0.0)) + F.col("cash")).alias("total_value"), "cash",
            F.coalesce("n_positions", F.lit(0)).alias("n_positions"), F.coalesce("gross_value", F.lit(0.0)).alias("gross_value"),
        )
    )


def rebalance_log(trades: DataFrame) -> DataFrame:
    """strategy_id, k, date, n_picks, picks, n_trades, n_problematic_trades, total_cost: one row per rebalance."""
    held = F.col("value_after") > 0
    return trades.groupBy("strategy_id", "k", "date").agg(
        F.count_if(held).alias("n_picks"),
        F.array_sort(F.collect_list(F.when(held, F.col("ticker")))).alias("picks"),
        F.count("side").alias("n_trades"),
        F.count_if("flag").alias("n_problematic_trades"),
        F.sum("cost").alias("total_cost"),
    )


def rebased(index: DataFrame, column: str, capital: float = 1_000_000.0) -> DataFrame:
    """date, total_value: an index in units of the capital on its first date."""
    first = F.first(column).over(Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return index.select("date", (capital * F.col(column) / first).alias("total_value"))


def returns(values: DataFrame, by: Sequence[str] = ("series",)) -> DataFrame:
    """Adds ``ret``: the change of total_value against the date before."""
    return values.withColumn("ret", F.try_divide("total_value", F.lag("total_value").over(Window.partitionBy(*by).orderBy("date"))) - 1)


def held_positions(previous: DataFrame, prices: DataFrame, today: str) -> DataFrame:
    """Positions carried over to a day without rebalance: mark and value renewed, the last mark kept where no price is.

    ``previous`` is (ticker, qty, entry_date, entry_price, current_mark); ``prices`` is (ticker, adj_close, close).
    """
    p = prices.select("ticker", F.coalesce("adj_close", "close").alias("_price"))
    mark = F.coalesce("_price", "current_mark")
    return previous.join(p, "ticker", "left").select(
        F.lit(today).cast("date").alias("date"), "ticker", "qty", "entry_date", "entry_price", mark.alias("current_mark"), (F.col("qty") * mark).alias("mtm_value")
    )


def live_index(index: DataFrame, anchor: DataFrame) -> DataFrame:
    """date, total_value after the anchor (date, total_value: one row), growing from it as the index does."""
    a = index.join(anchor.select("date", F.col("total_value").alias("_value")), "date").select(
        F.col("date").alias("_day"), "_value", F.col("index_close").alias("_level")
    )
    return index.join(a, F.col("date") > F.col("_day")).select("date", (F.col("_value") * F.col("index_close") / F.col("_level")).alias("total_value"))


def complete_days(bars: DataFrame, universe: int) -> DataFrame:
    """Dates on which at least ``universe`` tickers have a bar."""
    return bars.groupBy("date").agg(F.countDistinct("ticker").alias("n")).where(F.col("n") >= universe).select("date")
