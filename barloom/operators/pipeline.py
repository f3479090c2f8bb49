"""Feature assembly: joins of modules, special-session masks, incremental windows, metadata and inspection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import per_ticker
from ..sources.scratch import materialise
from .cross_section import cross_section, market_returns, with_beta
from .regime import mean_correlation, regime
from .windows import parts_for


def all_features(bars: DataFrame, index: DataFrame, vix: DataFrame, special: DataFrame) -> DataFrame:
    """date, ticker and every feature of ``METADATA``, special sessions masked: the assembled table of a written panel.

    ``bars`` (with sector) is dealt by ticker once, for all windows, smoothers and beta, and by date once, for all
    cross-sections, over as many parts as its rows are worth. What has one row a date, index returns, regimes and special sessions, is written first and small: it is
    joined where the rows are.
    """
    parts = parts_for(bars)
    market, regimes = materialise(market_returns(index)), materialise(regime(bars, index, vix).join(mean_correlation(bars, parts=parts), "date", "left"))
    return assembled(with_beta(per_ticker(bars, parts=parts), market), regimes, materialise(special), parts)


def assembled(features: DataFrame, regimes: DataFrame, special: DataFrame, parts: int | None = None) -> DataFrame:
    """The columns of ``METADATA`` from per-ticker features with beta, and from written tables of one row a date."""
    joined = assemble(cross_section(features, special, parts), regimes)
    names = [name for name, *_ in METADATA]
    return mask_special(joined.select("date", "ticker", *names), special, masked_columns(joined.select(names)))


def assemble(features: DataFrame, regimes: DataFrame) -> DataFrame:
    """Per-ticker and cross-sectional features with the regime columns of their date and the interaction.

    Per-ticker modules are columns of one frame already, so the only join is that of the small regime table.
    """
    joined = features.join(regimes, "date", "left")
    product = F.col("ret_5d_z_winsor") * F.col("vix_pct_252d")
    return joined.withColumn("mean_reversion_strength_x_vix", product)


def mask_special(features: DataFrame, special: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sets ``columns`` null on special dates, after they have been computed, so that windows saw those dates."""
    df = features.join(special.select("date", F.lit(True).alias("_special")), "date", "left")
    return df.withColumns({c: F.when(F.col("_special").isNull(), F.col(c)) for c in columns}).drop("_special")


#: Name, module, source, rows that are looked back on (the current one included), whether special sessions mask it.
METADATA: tuple[tuple[str, str, str, int, bool], ...] = (
    ("ret_1d", "price", "per_ticker", 2, False),
    ("ret_5d", "price", "per_ticker", 6, False),
    ("ret_10d", "price", "per_ticker", 11, False),
    ("ret_20d", "price", "per_ticker", 21, False),
    ("ret_60d", "price", "per_ticker", 61, False),
    ("log_ret_1d", "price", "per_ticker", 2, False),
    ("gap_overnight", "price", "per_ticker", 2, False),
    ("gap_fill_rate", "price", "per_ticker", 2, False),
    ("gap_fill_rate_winsor", "price", "per_ticker", 2, False),
    ("dist_sma_20_pct", "price", "per_ticker", 20, False),
    ("dist_sma_50_pct", "price", "per_ticker", 50, False),
    ("dist_sma_200_pct", "price", "per_ticker", 200, False),
    ("dist_ema_20_pct", "price", "per_ticker", 20, False),
    ("dist_ema_50_pct", "price", "per_ticker", 50, False),
    ("dist_ema_200_pct", "price", "per_ticker", 200, False),
    ("pos_in_52w_range_pct", "price", "per_ticker", 252, False),
    ("realized_vol_5d", "volatility", "per_ticker", 6, False),
    ("realized_vol_10d", "volatility", "per_ticker", 11, False),
    ("realized_vol_20d", "volatility", "per_ticker", 21, False),
    ("realized_vol_60d", "volatility", "per_ticker", 61, False),
    ("parkinson_vol_20d", "volatility", "per_ticker", 20, True),
    ("garman_klass_vol_20d", "volatility", "per_ticker", 20, True),
    ("atr_14", "volatility", "per_ticker", 15, True),
    ("vol_of_vol_20d", "volatility", "per_ticker", 40, False),
    ("vol_regime", "volatility", "per_ticker", 252, False),
    ("macd", "trend", "per_ticker", 26, False),
    ("macd_signal", "trend", "per_ticker", 35, False),
    ("macd_hist", "trend", "per_ticker", 35, False),
    ("adx_14", "trend", "per_ticker", 28, False),
    ("aroon_up_25", "trend", "per_ticker", 25, False),
    ("aroon_down_25", "trend", "per_ticker", 25, False),
    ("heikin_ashi_close_smooth_5", "trend", "per_ticker", 5, False),
    ("supertrend_10_3", "trend", "per_ticker", 20, False),
    ("trend_aligned_5_20_50", "trend", "per_ticker", 50, False),
    ("trend_persistence_60d", "trend", "per_ticker", 80, False),
    ("pct_days_above_sma200_252d", "trend", "per_ticker", 452, False),
    ("up_streak_length", "trend", "per_ticker", 21, False),
    ("consecutive_days_above_sma50", "trend", "per_ticker", 51, False),
    ("adx_directional_persistence", "trend", "per_ticker", 28, False),
    ("rsi_14", "momentum", "per_ticker", 15, False),
    ("rsi_21", "momentum", "per_ticker", 22, False),
    ("stoch_k_14", "momentum", "per_ticker", 14, False),
    ("stoch_d_3", "momentum", "per_ticker", 17, False),
    ("williams_r_14", "momentum", "per_ticker", 14, False),
    ("roc_5d", "momentum", "per_ticker", 6, False),
    ("roc_10d", "momentum", "per_ticker", 11, False),
    ("roc_20d", "momentum", "per_ticker", 21, False),
    ("momentum_div_flag", "momentum", "per_ticker", 34, False),
    ("vol_ratio_20d", "volume", "per_ticker", 20, True),
    ("obv", "volume", "per_ticker", 2, True),
    ("typical_price_dev_pct", "volume", "per_ticker", 1, True),
    ("accum_dist_line", "volume", "per_ticker", 1, True),
    ("unusual_vol_z_20d", "volume", "per_ticker", 20, True),
    ("range_pct_close", "microstructure", "per_ticker", 1, True),
    ("range_expansion_20d", "microstructure", "per_ticker", 20, True),
    ("close_pos_in_range", "microstructure", "per_ticker", 1, True),
    ("body_to_range", "microstructure", "per_ticker", 1, True),
    ("trend_strength_smoothed", "persistence", "per_ticker", 61, False),
    ("roc_consistency_20d", "persistence", "per_ticker", 25, False),
    ("volume_trend_alignment", "persistence", "per_ticker", 25, True),
    ("regime_adjusted_rsi", "persistence", "per_ticker", 266, False),
    ("ret_5d_rank_universe", "cross_sectional", "cross_sectional", 5, False),
    ("ret_5d_z_winsor", "cross_sectional", "cross_sectional", 5, False),
    ("vol_20d_rank_universe", "cross_sectional", "cross_sectional", 20, False),
    ("vol_20d_z_winsor", "cross_sectional", "cross_sectional", 20, False),
    ("turnover_rank_universe", "cross_sectional", "cross_sectional", 1, True),
    ("ret_5d_rank_sector", "cross_sectional", "cross_sectional", 5, False),
    ("ret_5d_dist_sector_median", "cross_sectional", "cross_sectional", 5, False),
    ("beta_60d_nifty50", "cross_sectional", "cross_sectional", 60, False),
    ("vix_level", "regime", "regime", 1, False),
    ("vix_pct_252d", "regime", "regime", 252, False),
    ("nifty_above_sma_200", "regime", "regime", 200, False),
    ("corr_regime_60d", "regime", "regime", 60, False),
    ("mean_reversion_strength_x_vix", "interactions", "cross_sectional", 252, False),
)


#: Windows of features: how many rows of which other feature they hold.
WINDOWS_OF: dict[str, tuple[int, str]] = {
    "vol_regime": (252, "realized_vol_20d"),
    "vol_of_vol_20d": (20, "realized_vol_20d"),
    "pct_days_above_sma200_252d": (252, "dist_sma_200_pct"),
    "trend_persistence_60d": (60, "dist_sma_20_pct"),
    "stoch_d_3": (3, "stoch_k_14"),
    "range_expansion_20d": (20, "range_pct_close"),
    "roc_consistency_20d": (20, "ret_5d"),
    "volume_trend_alignment": (20, "ret_1d"),
    "up_streak_length": (20, "ret_1d"),
    "regime_adjusted_rsi": (252, "rsi_14"),
    "momentum_div_flag": (20, "rsi_14"),
    "beta_60d_nifty50": (60, "ret_1d"),
    "corr_regime_60d": (60, "ret_1d"),
}


def closure(name: str) -> int:
    """The rows of a ticker that a feature needs, the current one included: its window's, each with all that its input needs."""
    own = next(rows for n, _, _, rows, _ in METADATA if n == name)
    rows, of = WINDOWS_OF.get(name, (own, None))
    return max(own, rows + closure(of) - 1 if of else rows)


def metadata(spark: SparkSession) -> DataFrame:
    """The feature metadata as a table."""
    return spark.createDataFrame(list(METADATA), "name string, module string, source string, lookback int, mask_on_special boolean")


def masked_columns(features: DataFrame) -> list[str]:
    """The columns of a frame that special sessions mask."""
    masked = {name for name, *_, mask in METADATA if mask}
    return [c for c in features.columns if c in masked]


def coverage(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """name, n_valid, first_valid: how many values each feature has, and the date of the first, in one pass over all."""
    x = [F.struct(F.lit(c).alias("name"), F.col(c).isNotNull().alias("known")) for c in columns]
    long = features.select("date", F.explode(F.array(*x)).alias("s")).select("date", "s.*").where("known")
    return long.groupBy("name").agg(F.count(F.lit(1)).alias("n_valid"), F.min("date").alias("first_valid"))


def inspect(features: DataFrame, ticker: str, columns: Sequence[str], n: int) -> DataFrame:
    """The last n rows of one ticker."""
    return features.where(F.col("ticker") == ticker).select("date", "ticker", *columns).orderBy(F.col("date").desc()).limit(n)
