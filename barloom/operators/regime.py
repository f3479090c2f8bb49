"""Per-date market regime: index levels joined to the date spine, and the mean pairwise correlation of returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import change, dealt


def regime(bars: DataFrame, index: DataFrame, vix: DataFrame) -> DataFrame:
    """date, vix_level, vix_pct_252d, nifty_above_sma_200: on every date of the universe, null where an index is missing.

    Index series are dimensions with one row per date; their windows run over their own rows.
    """
    own = Window.partitionBy(F.lit(1)).orderBy("date")
    back = own.rowsBetween(-251, 0)
    level = vix.where(F.col("vix").isNotNull())
    seen = F.collect_list("vix").over(back)
    level = level.withColumn("_seen", seen).select(
        "date",
        F.col("vix").alias("vix_level"),
        F.when(
            F.size("_seen") == 252, (F.size(F.filter("_seen", lambda x: x <= F.col("vix"))) - 1) / 251.0
        ).alias("vix_pct_252d"),
    )
    w = own.rowsBetween(-199, 0)
    trend = index.select(
        "date",
        F.when(
            F.count("index_close").over(w) == 200,
            (F.col("index_close") > F.avg("index_close").over(w)).cast("int"),
        ).alias("nifty_above_sma_200"),
    )
    spine = bars.select("date").distinct()
    return spine.join(level, "date", "left").join(trend, "date", "left")


def mean_correlation(bars: DataFrame, n: int = 60, parts: int | None = None) -> DataFrame:
    """date, corr_regime_{n}d: mean Pearson correlation of all pairs of tickers over the last n dates of the spine.

    Tickers with a missing or constant return in the window are left out, and two must remain. With z-scores inside
    each window, the sum over all pairs at one date follows from the square of the sum over tickers, so no pair of tickers is
    ever formed. A full window is the ticker's last n rows; its z-scores are cells of (last date, date), which are added up within each
    task before they are shuffled: dates times n cells leave a task, however many tickers it holds.
    """
    r = dealt(bars.select("date", "ticker", "adj_close"), "ticker", parts=parts).select("date", "ticker", change(F.col("adj_close"), 1).alias("r"))
    spine = bars.select("date").distinct()
    spine = spine.withColumn("t", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")).cast("long"))
    r = r.join(spine, "date").where(F.col("r").isNotNull())
    w = Window.partitionBy("ticker").orderBy("t").rowsBetween(-(n - 1), 0)
    seen = r.select("t", F.min("t").over(w).alias("first"), F.count("r").over(w).alias("n"), F.avg("r").over(w).alias("mu"), F.stddev_pop("r").over(w).alias("sd"), F.collect_list("r").over(w).alias("rs"))
    # n rows on n dates in a row: no return of the window is missing
    held = seen.where((F.col("n") == n) & (F.col("first") == F.col("t") - (n - 1)) & (F.col("sd") > 0))
    cells = held.select(F.col("t").alias("d"), F.posexplode(F.transform("rs", lambda x: (x - F.col("mu")) / F.col("sd"))).alias("at", "z"))
    sums = cells.groupBy("d", "at").agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("k"))
    k = F.max("k")
    mean = sums.groupBy("d").agg(
        F.when(k > 1, (F.sum(F.col("s") * F.col("s")) / float(n) - k) / (k * (k - 1))).alias(f"corr_regime_{n}d")
    )
    return spine.join(mean, spine["t"] == mean["d"], "left").select("date", f"corr_regime_{n}d")


def wide_returns(bars: DataFrame, tickers: list[str]) -> DataFrame:
    """One row per date and one column of one-row returns per named ticker."""
    r = bars.select("date", "ticker", change(F.col("adj_close"), 1).alias("r"))
    return r.groupBy("date").pivot("ticker", tickers).agg(F.first("r", ignorenulls=True))


def interaction(section: DataFrame, regimes: DataFrame) -> DataFrame:
    """date, ticker, mean_reversion_strength_x_vix: the return score times the volatility percentile of its date."""
    joined = section.select("date", "ticker", "ret_5d_z_winsor").join(regimes.select("date", "vix_pct_252d"), "date", "left")
    product = F.col("ret_5d_z_winsor") * F.col("vix_pct_252d")
    return joined.select("date", "ticker", product.alias("mean_reversion_strength_x_vix"))
