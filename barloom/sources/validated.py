"""A write that refuses bad bars: rules are counted in the pass that stages a load, and only sound tickers are published."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.validation import REQUIRED, missing_columns, rules
from .bars import BARS, enforce, upsert
from .scratch import delete, discarded, exists, materialise, new_folder

DUPLICATES = "uniqueness.duplicates"
QUARANTINE = "load string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BARS.fields) + ", broken array<string>"


@dataclass(frozen=True)
class Report:
    """What a load broke: (rule, severity, count) of the rules that count any, and how many rows went which way."""

    issues: list[tuple[str, str, int]]
    published: int
    quarantined: int

    @property
    def errors(self) -> list[tuple[str, str, int]]:
        return [x for x in self.issues if x[1] == "error"]


def judged(load: DataFrame, today: str, limit: float = 0.5) -> DataFrame:
    """The bars of a load with ``_seen``, one flag a rule: the rules of ``validation``, and a second row of a key.

    The row before and the repeats of a key come from one sort by ticker and date, so the load is shuffled once.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    seen = load.withColumns({"_before": F.lag("close").over(w), "_nth": F.row_number().over(Window.partitionBy("ticker", "date").orderBy("date"))})
    flags = {name: F.coalesce(x, F.lit(False)) for name, (_, x) in rules(today, limit).items()} | {DUPLICATES: F.col("_nth") == 2}
    return seen.withColumn("_seen", F.struct(*[x.alias(n) for n, x in flags.items()])).drop("_before", "_nth")


def _broken(severities: dict[str, str]) -> Column:
    """The names of the error rules that a row breaks, in order."""
    names = sorted(n for n, s in severities.items() if s == "error")
    return F.array_compact(F.array(*[F.when(F.col(f"_seen.`{n}`"), n) for n in names]))


def staged(load: DataFrame, name: str, today: str, limit: float, observation: Observation) -> DataFrame:
    """The rows that ``save_bars`` stages: bars with the error rules each breaks; all rules are counted as rows pass."""
    severities = {n: s for n, (s, _) in rules(today, limit).items()} | {DUPLICATES: "error"}
    found = judged(enforce(load), today, limit)
    counts = [F.count_if(F.col(f"_seen.`{n}`")).alias(n) for n in severities]
    found = found.observe(observation, F.count(F.lit(1)).alias("rows"), *counts)
    return found.select(F.lit(name).alias("load"), *[f.name for f in BARS.fields], _broken(severities).alias("broken"))


def save_bars(load: DataFrame, name: str, table: str, quarantine: str, today: str, limit: float = 0.5) -> Report:
    """Upsert a load into ``table`` (partitioned by ticker), but for the tickers that break an error rule in it.

    The load is read once, by the job that writes it to a staging folder; the counts of all rules are gathered there, in
    the stage that writes, where a task that is run again counts once. Without an error the staged rows are published as they
    are. Else each ticker that breaks a rule is kept out with all its rows of the load, which go to ``quarantine`` (partitioned
    by load) with the rules that each row breaks, and the other tickers are published. Warnings are reported and block nothing.

    A load that is saved again replaces its quarantine and gives the same table. Missing columns write nothing; an empty load
    breaks no rule. The staging folder is deleted at the end, also if a step fails.
    """
    spark = load.sparkSession
    if gone := missing_columns(load, REQUIRED):
        return Report([("schema.missing_columns", "error", len(gone))], 0, 0)
    observation, staging = Observation(f"load {name}"), new_folder(spark)
    severities = {n: s for n, (s, _) in rules(today, limit).items()} | {DUPLICATES: "error"}
    try:
        staged(load, name, today, limit, observation).write.parquet(staging)
        counts = observation.get
        rows = spark.read.schema(QUARANTINE).parquet(staging)
        issues = [(n, s, counts[n]) for n, s in severities.items() if counts[n]]
        sound, kept_out = rows, 0
        if any(s == "error" for _, s, _ in issues):
            bad = rows.where(F.size("broken") > 0).select("ticker").distinct()
            refused = rows.join(bad, "ticker", "left_semi").select(rows.columns)
            refused.repartition("load").sortWithinPartitions("ticker", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(quarantine)
            kept_out = read_quarantine(spark, quarantine).where(F.col("load") == name).count()
            sound = rows.join(bad, "ticker", "left_anti")
        elif exists(spark, f"{quarantine}/load={name}"):
            delete(spark, f"{quarantine}/load={name}")
        _publish(sound.select([f.name for f in BARS.fields]), table)
        return Report(issues, counts["rows"] - kept_out, kept_out)
    finally:
        delete(spark, staging)


def _publish(new: DataFrame, table: str) -> None:
    """Upsert bars into the partitions of their tickers; others are neither read nor written."""
    spark = new.sparkSession
    if exists(spark, table):
        stored = spark.read.schema(BARS).parquet(table)
        touched = stored.join(new.select("ticker").distinct(), "ticker", "left_semi").select(new.columns)
        new = upsert(touched, new)
    with discarded(spark):
        merged = materialise(new.repartition("ticker").sortWithinPartitions("date"))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(table)


def read_bars(spark: SparkSession, table: str) -> DataFrame:
    """The published bars; none where nothing has been published."""
    return spark.read.schema(BARS).parquet(table) if exists(spark, table) else spark.createDataFrame([], BARS)


def read_quarantine(spark: SparkSession, quarantine: str) -> DataFrame:
    """The bars that were kept out, with their load and the error rules each row breaks."""
    return spark.read.schema(QUARANTINE).parquet(quarantine) if exists(spark, quarantine) else spark.createDataFrame([], QUARANTINE)
