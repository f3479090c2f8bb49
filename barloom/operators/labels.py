"""Forward-looking labels and the training table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import over

HORIZONS = (5, 10, 20)


def forward_labels(bars: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """date, ticker and, per horizon, the forward return, the label of beating the date's median, and the demeaned return.

    A label needs a strictly larger return than the median of all tickers of the date; it is null while the return
    is unknown.
    """
    if not horizons or min(horizons) <= 0:
        raise ValueError("horizons must be positive")
    adj = F.col("adj_close")
    df = bars.select(
        "date", "ticker", *[(F.try_divide(F.lead(adj, h).over(over()), adj) - 1).alias(f"forward_ret_{h}d") for h in horizons]
    )
    day = Window.partitionBy("date")
    df = df.withColumns({f"_m{h}": F.percentile(f"forward_ret_{h}d", 0.5).over(day) for h in horizons})
    for h in horizons:
        r = F.col(f"forward_ret_{h}d")
        df = df.withColumns(
            {
                f"outperforms_universe_median_{h}d": F.when(r.isNotNull(), (r > F.col(f"_m{h}")).cast("int")),
                f"forward_ret_{h}d_demeaned": r - F.avg(r).over(day),
            }
        )
    return df.drop(*[f"_m{h}" for h in horizons])


def label_distribution(labels: DataFrame, label: str) -> DataFrame:
    """One row: rows with a label, rows without, and the share of ones in percent."""
    y = F.col(label)
    return labels.agg(
        F.count(y).alias("n_valid"),
        F.count_if(y.isNull()).alias("n_null"),
        (100.0 * F.avg(y)).alias("pct_ones"),
    )


def last_per_ticker(df: DataFrame, n: int = 2) -> DataFrame:
    """The last n rows of each ticker."""
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def training_table(
    features: DataFrame, regimes: DataFrame, labels: DataFrame, sectors: DataFrame, needed: Sequence[str], start=None, end=None
) -> DataFrame:
    """Features with regime, labels and sector; rows whose ``needed`` labels are not all known are dropped.

    Regime and sector tables are dimensions; dates are filtered before any join.
    """
    if start is not None:
        features = features.where(F.col("date") >= F.lit(start))
    if end is not None:
        features = features.where(F.col("date") <= F.lit(end))
    return (
        features.join(labels, ["date", "ticker"], "left")
        .join(regimes, "date", "left")
        .join(sectors, "ticker", "left")
        .na.drop(subset=list(needed))
    )


def model_inputs(df: DataFrame, sectors: Sequence[str]) -> DataFrame:
    """Adds day_of_week (1 Monday to 7 Sunday) and the sector's place in sorted order, -1 where unknown."""
    code = F.create_map(*[F.lit(x) for i, s in enumerate(sorted(sectors)) for x in (s, i)])
    return df.withColumns(
        {"day_of_week": F.weekday("date") + 1, "sector_code": F.coalesce(code[F.col("sector")], F.lit(-1))}
    )


def profile(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Rows, distinct dates, first and last date, tickers, sectors, label balance and the null share of each column, in one pass.

    The result is long: (item, value).
    """
    items = {
        "rows": F.count(F.lit(1)).cast("double"),
        "tickers": F.countDistinct("ticker").cast("double"),
        "sectors": F.countDistinct("sector").cast("double"),
        "dates": F.countDistinct("date").cast("double"),
        "first_date": F.unix_date(F.min("date")).cast("double"),
        "last_date": F.unix_date(F.max("date")).cast("double"),
        "label_mean": F.avg(label),
        **{f"null_{c}": F.avg(F.col(c).isNull().cast("double")) for c in columns},
    }
    one = df.agg(*[e.alias(k) for k, e in items.items()])
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("item"), F.col(k).alias("value")) for k in items])).alias("s")
    return one.select(stacked).select("s.item", "s.value")
