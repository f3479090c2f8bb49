"""Data-quality rules of bars: a report of (rule, severity, count) with the rules that were broken."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import over

REQUIRED = ("date", "ticker", "open", "high", "low", "close", "volume", "adj_close")


def rules(today: str, limit: float) -> dict[str, tuple[str, Column]]:
    c = F.col
    return {
        "price.non_positive": ("error", (c("open") <= 0) | (c("high") <= 0) | (c("low") <= 0) | (c("close") <= 0)),
        "volume.negative": ("error", c("volume") < 0),
        "ohlc.high_lt_low": ("error", c("high") < c("low")),
        "ohlc.high_lt_open_or_close": ("error", (c("high") < c("open")) | (c("high") < c("close"))),
        "ohlc.low_gt_open_or_close": ("error", (c("low") > c("open")) | (c("low") > c("close"))),
        "date.future": ("error", c("date") > F.lit(today).cast("date")),
        "volume.zero": ("warning", c("volume") == 0),
        "return.anomaly": ("warning", F.abs(F.try_divide(c("close"), c("_before")) - 1) > limit),
    }


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def _checked(bars: DataFrame, by: list[str], today: str, limit: float) -> DataFrame:
    """Counts of all rules per group: one pass over the bars, and one aggregation of duplicated keys."""
    found = rules(today, limit)
    seen = bars.withColumn("_before", F.lag("close").over(over()))
    counts = seen.groupBy(*by).agg(*[F.count_if(x).alias(n) for n, (_, x) in found.items()])
    double = bars.groupBy("date", "ticker").count().where("count > 1").groupBy(*by).agg(F.count(F.lit(1)).alias("uniqueness.duplicates"))
    counts = counts.join(double, by, "left") if by else counts.join(F.broadcast(double))
    severity = {n: s for n, (s, _) in found.items()} | {"uniqueness.duplicates": "error"}
    stack = F.array(
        *[
            F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("long").alias("n"))
            for n, s in severity.items()
        ]
    )
    return counts.select(*by, F.explode(stack).alias("r")).select(*by, "r.*").where("n > 0")


def validate(bars: DataFrame, today: str, limit: float = 0.5) -> DataFrame:
    """rule, severity, n of every broken rule. Missing columns are found from the schema alone, and end the check.

    Duplicates count keys, not rows. No bars break no rule.
    """
    if gone := missing_columns(bars):
        return bars.sparkSession.createDataFrame([("schema.missing_columns", "error", len(gone))], "rule string, severity string, n long")
    return _checked(bars, [], today, limit)


def validate_store(bars: DataFrame, today: str, limit: float = 0.5) -> DataFrame:
    """n_failed, n_warned: tickers with an error, and tickers with warnings only."""
    per = _checked(bars, ["ticker"], today, limit).groupBy("ticker").agg(F.max((F.col("severity") == "error").cast("int")).alias("bad"))
    return per.agg(F.count_if(F.col("bad") == 1).alias("n_failed"), F.count_if(F.col("bad") == 0).alias("n_warned"))
