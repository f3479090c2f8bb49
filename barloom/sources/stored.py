"""Panels as tables with a physical layout: partitioned by year, bucketed by ticker and sorted, so that scans prune and joins do not shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialise, new_folder


def store_panel(df: DataFrame, name: str | None = None, path: str | None = None, buckets: int | None = None) -> str:
    """Write a dated panel as a table of the catalog and return its name: by year of the date, and by ticker if it has one.

    Rows are dealt by ticker into as many tasks as there are buckets, and a task writes one sorted file for each year of its
    bucket. All tables of a store are to have the same number of buckets; by default it is that of the shuffle partitions.
    """
    spark = df.sparkSession
    name = name or f"barloom_{uuid.uuid4().hex}"
    dated = df.withColumn("year", F.year("date"))
    out = lambda rows: rows.write.mode("overwrite").format("parquet").option("path", path or new_folder(spark)).partitionBy("year")
    if "ticker" not in df.columns:
        out(dated.repartition("year").sortWithinPartitions("date")).saveAsTable(name)
        return name
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out(dated.repartition(n, "ticker").sortWithinPartitions("year", "ticker", "date")).bucketBy(n, "ticker").sortBy("ticker", "date").saveAsTable(name)
    return name


def scan_panel(spark: SparkSession, name: str, ticker: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of one or all tickers in [start, end]: years are pruned by partition, row groups by the sorted ticker and date."""
    df = spark.table(name)
    if ticker is not None:
        df = df.where(F.col("ticker") == ticker)
    if start is not None:
        df = df.where((F.col("year") >= int(start[:4])) & (F.col("date") >= F.lit(start).cast("date")))
    if end is not None:
        df = df.where((F.col("year") <= int(end[:4])) & (F.col("date") <= F.lit(end).cast("date")))
    return df.drop("year")


@contextmanager
def colocated(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside join on (ticker, date) where the rows are: equal buckets of the ticker hold all that can meet."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def joined(spark: SparkSession, left: str, right: str, on: Sequence[str] = ("ticker", "date"), how: str = "inner") -> DataFrame:
    """The written join of two stored tables of as many buckets, without a shuffle of either."""
    with colocated(spark):
        return materialise(spark.table(left).drop("year").join(spark.table(right).drop("year"), list(on), how))
