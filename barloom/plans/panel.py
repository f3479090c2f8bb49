"""The panel that all registered queries use: weekly bars per nation, built from trades, with two index series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import change
from ..sources.scratch import materialise

TRADE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ticker, open, high, low, close, volume, adj_close, sector: one row per nation and week with trades.

    First and last trades are picked by aggregation over a composite order, so trades combine on the map side and
    only one row per nation, week and task is shuffled.
    """
    trades = read(spark, sf_dir, "lineitem").join(
        read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    price = F.col("l_extendedprice") / F.col("l_quantity")
    when = F.struct(*TRADE_ORDER)
    cells = trades.groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), "s_nationkey").agg(
        F.min_by(price, when).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, when).alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )
    names = read(spark, sf_dir, "nation").join(
        read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("ticker"), F.col("r_name").alias("sector"))
    return cells.join(names, "s_nationkey").select(
        "date", "ticker", "open", "high", "low", "close", "volume", F.col("close").alias("adj_close"), "sector"
    )


def bars_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written to the shared folder for a query that reads the panel more than once: trades are scanned once."""
    return materialise(bars(spark, sf_dir))


def market_index(panel: DataFrame) -> DataFrame:
    """date, index_close: the volume-weighted mean close of each date."""
    return panel.groupBy("date").agg(
        (F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("index_close")
    )


def fear_index(panel: DataFrame) -> DataFrame:
    """date, vix: the cross-sectional deviation of one-row returns of each date."""
    r = panel.withColumn("r", change(F.col("adj_close"), 1))
    return r.groupBy("date").agg(F.stddev_samp("r").alias("vix"))


BARS_SQL = """
bars AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, n_name AS ticker, any_value(r_name) AS sector,
    first(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open,
    max(p) AS high, min(p) AS low,
    last(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close,
    CAST(sum(l_quantity) AS BIGINT) AS volume,
    last(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS adj_close
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem)
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2),
idx AS (SELECT date, sum(close * volume) / sum(volume) AS index_close FROM bars GROUP BY date),
vixs AS (
  SELECT date, stddev_samp(r) AS vix
  FROM (SELECT date, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars)
  GROUP BY date)"""


def with_bars(*ctes: str, select: str) -> str:
    """DuckDB SQL over the panel: further CTEs, then the query."""
    return "WITH " + ",\n".join([BARS_SQL.strip(), *(x.strip() for x in ctes)]) + "\n" + select


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, with no negative zero left."""
    cols = [
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(cols)
