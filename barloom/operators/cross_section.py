"""Per-date cross-sections of a panel: percentile ranks, winsorised scores, sector comparisons and market beta."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import average_rank, change, dealt, full


def percentile_rank(x: Column, by: Sequence[str] = ("date",)) -> Column:
    """(average rank - 1) / (n - 1) among the n non-null values; null where n is at most 1."""
    n = F.count(x).over(Window.partitionBy(*by))
    return F.when(n > 1, (average_rank(x, by) - 1) / (n - 1))


def winsorised_score(df: DataFrame, x: str, out: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Adds ``out``: x against mean and deviation of the values clipped to their quantiles of the date.

    A null value enters mean and deviation as the lower quantile, and its own score is null; null if all are equal. The
    quantiles, the values at index round((n - 1) q) of the sorted known ones, are picked by their place in the order of the date:
    one sort, whatever the number of tickers, and no date is gathered.
    """
    day = Window.partitionBy("date")
    df = df.withColumns({"_place": F.row_number().over(day.orderBy(F.col(x).asc_nulls_last())), "_known": F.count(x).over(day)})
    at = {name: F.max(F.when(F.col("_place") == F.round((F.col("_known") - 1) * q) + 1, F.col(x))).over(day) for name, q in (("_a", low), ("_b", high))}
    df = df.withColumns(at).withColumn("_cut", F.least(F.greatest(x, "_a"), "_b"))
    df = df.withColumns({"_mu": F.avg("_cut").over(day), "_sd": F.stddev_samp("_cut").over(day)})
    score = F.when(F.col("_sd") > 0, (F.col(x) - F.col("_mu")) / F.col("_sd"))
    return df.withColumn(out, score).drop("_place", "_known", "_a", "_b", "_cut", "_mu", "_sd")


def sector_comparison(df: DataFrame, x: str, rank_as: str, distance_as: str) -> DataFrame:
    """Rank among all tickers of the date and sector, and distance to their median; null for a lone ticker."""
    by = ["date", "sector"]
    peers = F.count("ticker").over(Window.partitionBy(*by))
    many = F.when(peers > 1, F.lit(1))
    rank = (average_rank(F.col(x), by) - 1) / (peers - 1)
    middle = F.percentile(x, 0.5).over(Window.partitionBy(*by))
    return df.withColumns({rank_as: F.when(many == 1, rank), distance_as: F.when(many == 1, F.col(x) - middle)})


def market_beta(bars: DataFrame, index: DataFrame, n: int = 60) -> DataFrame:
    """date, ticker, beta_{n}d: over the last n rows where both returns exist; null without variance or index.

    The index is one row per date and so small that it joins by broadcast while it stays under Spark's own bound.
    """
    market = market_returns(index)
    own = bars.select("date", "ticker", change(F.col("adj_close"), 1).alias("x"))
    both = own.join(market, "date").where("x IS NOT NULL AND y IS NOT NULL")
    xy, x, y, yy = (full(F.avg, e, n) for e in (F.col("x") * F.col("y"), F.col("x"), F.col("y"), F.col("y") * F.col("y")))
    var = yy - y * y
    beta = both.select("date", "ticker", F.when(var > 0, F.try_divide(xy - x * y, var)).alias(f"beta_{n}d_nifty50"))
    return bars.select("date", "ticker").join(beta, ["date", "ticker"], "left")


def with_beta(df: DataFrame, market: DataFrame, n: int = 60) -> DataFrame:
    """``df`` (dealt by ticker) with beta_{n}d_nifty50, as ``market_beta``, but as windows of the partitioning it has.

    ``market`` (date, y: the index's return) is a written table of one row a date, which Spark broadcasts below its bound. The last n
    rows where both returns exist are those whose running number of such rows is at most n - 1 behind.
    """
    x, y = F.col("_x"), F.col("y")
    both = df.join(market, "date", "left").withColumn("_x", change(F.col("adj_close"), 1))
    both = both.withColumn("_both", x.isNotNull() & y.isNotNull())
    so_far = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_nth", F.sum(F.col("_both").cast("long")).over(so_far))
    w = Window.partitionBy("ticker").orderBy("_nth").rangeBetween(-(n - 1), 0)
    xy, mx, my, yy = (F.avg(F.when(F.col("_both"), e)).over(w) for e in (x * y, x, y, y * y))
    var = yy - my * my
    beta = F.when(F.col("_both") & (F.col("_nth") >= n) & (var > 0), F.try_divide(xy - mx * my, var))
    return both.withColumn(f"beta_{n}d_nifty50", beta).drop("_x", "y", "_both", "_nth")


def market_returns(index: DataFrame) -> DataFrame:
    """date, y: the change of the index against the date before; one row per date."""
    day = Window.partitionBy(F.lit(1)).orderBy("date")
    return index.select("date", (F.try_divide("index_close", F.lag("index_close").over(day)) - 1).alias("y"))


def cross_section(features: DataFrame, special: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Ranks, scores and sector columns of a feature frame with ret_5d, realized_vol_20d, turnover and sector.

    Turnover of special sessions is left out. Windows of one partitioning share its shuffle: by date, then by date
    and sector.
    """
    df = features
    turnover = F.col("turnover")
    if special is not None:
        df = df.join(special.select("date", F.lit(True).alias("_special")), "date", "left")
        turnover = F.when(F.col("_special").isNull(), turnover)
    df = dealt(df.withColumn("_turnover", turnover), "date", parts=parts)
    df = df.withColumns(
        {
            "ret_5d_rank_universe": percentile_rank(F.col("ret_5d")),
            "vol_20d_rank_universe": percentile_rank(F.col("realized_vol_20d")),
            "turnover_rank_universe": percentile_rank(F.col("_turnover")),
        }
    )
    df = winsorised_score(df, "ret_5d", "ret_5d_z_winsor")
    df = winsorised_score(df, "realized_vol_20d", "vol_20d_z_winsor")
    df = sector_comparison(df, "ret_5d", "ret_5d_rank_sector", "ret_5d_dist_sector_median")
    return df.drop("_special", "_turnover")
