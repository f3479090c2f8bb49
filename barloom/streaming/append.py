"""The daily append as a stream: files of bars arrive, and each batch is upserted into the table by partition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.bars import BARS, enforce, upsert
from ..sources.scratch import discarded, exists, materialise


def bar_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Bars from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(BARS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_bars(bars: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Upsert every batch into ``table`` (partitioned by ticker), and end when all that has arrived is taken in.

    Only the partitions of the batch's tickers are read and rewritten. A batch that is run again after a failure
    gives the same table, as the newest load of a key stays whatever was there.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = enforce(batch)
        stored = spark.read.schema(BARS).parquet(table) if exists(spark, table) else new.limit(0)
        tickers = new.select("ticker").distinct()
        merged = upsert(stored.join(tickers, "ticker", "left_semi").select(new.columns), new)
        with discarded(spark):
            merged = materialise(merged.repartition("ticker").sortWithinPartitions("date"))
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(table)

    return bars.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", id_col: str = "event_id") -> DataFrame:
    """Event-time counts and sums by type of the events, each id once, that are not behind the watermark.

    The watermark of a batch is the latest time of all batches before, less ``late``. Rows at or behind it are dropped. Ids are
    remembered until the watermark has passed them, so a copy is dropped as a copy or as late; a window is complete
    when the watermark reaches its end, leaves in that batch, and its state goes.
    """
    return (
        events.withWatermark("ts", late)
        .dropDuplicatesWithinWatermark([id_col])
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


@dataclass(frozen=True)
class Taken:
    """What a run took in: rows, rows behind the watermark, and rows of state left at its end."""

    rows: int
    late: int
    state: int


def finish_windows(events: DataFrame, table: str, checkpoint: str, **options: str) -> Taken:
    """Take in what has arrived, append the windows that are complete to ``table``, and end.

    A later run with the same checkpoint goes on from there: with its watermark, its open windows and the ids it remembers.
    Files appear with the batch that made them, so a batch that is run again after a failure appends once.
    """
    out = windowed_counts(events, **options).writeStream.outputMode("append").format("parquet").option("path", table)
    query = out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    found = [p for p in query.recentProgress if p["stateOperators"]]
    operators = [o for p in found for o in p["stateOperators"]]
    return Taken(
        sum(p["numInputRows"] for p in found),
        sum(o["numRowsDroppedByWatermark"] for o in operators),
        sum(o["numRowsTotal"] for o in found[-1]["stateOperators"]) if found else 0,
    )
