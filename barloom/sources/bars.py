"""Sources and sinks of bars, features and logs: normalisation, upserts, partitioned tables, views, CSV and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("ticker", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")],
        T.StructField("volume", T.LongType()),
        T.StructField("adj_close", T.DoubleType()),
    ]
)

def normalise(raw: DataFrame, ticker: str | None = None) -> DataFrame:
    """Vendor columns, whatever their case, as bars: ``datetime`` is the date, a missing adjusted close is the close,
    rows without all four prices are dropped, and columns stand in fixed order."""
    have = {c.lower().replace(" ", "_"): c for c in raw.columns}

    def get(name: str, *other: str):
        found = next((have[n] for n in (name, *other) if n in have), None)
        return F.lit(None) if found is None else F.col(f"`{found}`")

    columns = {
        "date": get("date", "datetime").cast("date"),
        "ticker": F.lit(ticker) if ticker is not None else get("ticker", "symbol"),
        **{c: get(c).cast("double") for c in ("open", "high", "low", "close")},
        "volume": get("volume").cast("long"),
        "adj_close": F.coalesce(get("adj_close", "adjclose"), get("close")).cast("double"),
    }
    return raw.select(*[x.alias(n) for n, x in columns.items()]).na.drop(subset=["open", "high", "low", "close"])


def enforce(df: DataFrame, schema: T.StructType = BARS) -> DataFrame:
    """The columns of a schema, cast and in order; other columns go, missing ones are an error."""
    if gone := [f.name for f in schema.fields if f.name not in df.columns]:
        raise ValueError(f"missing columns: {gone}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """Union of both in which the newest load of each key stays; within the new rows, that of the largest ``load``
    column if there is one, else equal keys keep one row by its values.

    Rows are compared by aggregation, so repeats combine before the shuffle.
    """
    order = F.coalesce(F.col("load"), F.lit(0)) if "load" in new.columns else F.lit(0)
    rest = [c for c in stored.columns if c not in keys]
    a = stored.select(*keys, F.struct(F.lit(-1).cast("long").alias("seq"), *rest).alias("row"))
    b = new.select(*keys, F.struct(order.cast("long").alias("seq"), *rest).alias("row"))
    return a.unionByName(b).groupBy(*keys).agg(F.max("row").alias("row")).select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest]).select(stored.columns)


def write_table(df: DataFrame, path: str, version: int = 1, partition: str | None = "ticker", sort: str = "date") -> str:
    """Write a versioned table as zstd Parquet, replacing only the partitions that ``df`` holds."""
    target = f"{path.rstrip('/')}/v{version}"
    writer = df.repartition(partition).sortWithinPartitions(sort) if partition else df
    out = writer.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    (out.partitionBy(partition) if partition else out).parquet(target)
    return target


def read_table(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/v{version}")


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """SQL over the given tables as views."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def coverage(bars: DataFrame) -> DataFrame:
    """ticker, first_date, last_date, n_rows."""
    return bars.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n_rows"))


def watermarks(bars: DataFrame, tickers: DataFrame, today: str, default: str) -> DataFrame:
    """ticker, start: the day after the latest bar, or the default; tickers that are up to date are left out."""
    last = bars.groupBy("ticker").agg(F.max("date").alias("last"))
    start = F.coalesce(F.date_add("last", 1), F.lit(default).cast("date"))
    return tickers.select("ticker").distinct().join(last, "ticker", "left").select("ticker", start.alias("start")).where(F.col("start") <= F.lit(today).cast("date"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_values_csv(spark: SparkSession, path: str) -> DataFrame:
    """date, total_value from CSV, with a fixed schema."""
    return spark.read.csv(path, header=True, schema="date date, total_value double")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
