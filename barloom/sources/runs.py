"""Tables that a run replaces together for some dates (or series), made visible by one ledger row for each.

Files of a run lie in partitions of their own, ``<root>/<table>/<key>=.../run=...``, and are written by partition overwrite. What
readers see of a key are the files of the run that the key's last successful ledger row names. A run that fails between
two tables has written no ledger row: readers see the run before, and the next run of the key leaves no trace of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import delete, exists, subfolders

SUCCESS = "SUCCESS"


class RunTables:
    """Tables below ``root`` whose rows are replaced by ``key``: a date or string column of every table."""

    def __init__(self, spark: SparkSession, root: str, key: str = "date", key_type: str = "date"):
        self.spark, self.root, self.key, self.key_type = spark, root.rstrip("/"), key, key_type
        self._ledger = f"{self.root}/_ledger"

    def stage(self, run: str, tables: Mapping[str, DataFrame]) -> None:
        """Write the tables of a run, some at a time, for all keys their rows hold; nothing becomes visible. Rows without a key are not kept."""
        if any("run" in rows.columns for rows in tables.values()):
            raise ValueError("a table of runs has no column named run of its own")

        def put(name: str) -> None:
            own = tables[name].where(F.col(self.key).isNotNull()).withColumn("run", F.lit(run))
            out = own.repartition(self.key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.partitionBy(self.key, "run").parquet(f"{self.root}/{name}")

        with ThreadPoolExecutor(4) as pool:
            list(pool.map(put, tables))

    def commit(self, run: str, keys: DataFrame) -> None:
        """Append one ledger row for each row of ``keys`` (the key, ``status``, any details): the run's rows become visible.

        All rows are one job, whose files appear when it ends; of two rows of one key in it the larger details count.
        """
        seq = 1 + (self._rows().agg(F.max("seq")).first()[0] or 0) if exists(self.spark, self._ledger) else 1
        keys.withColumns({"run": F.lit(run), "seq": F.lit(seq).cast("long")}).coalesce(1).write.mode("append").parquet(self._ledger)

    def replace(self, run: str, tables: Mapping[str, DataFrame], keys: DataFrame) -> None:
        """Write all tables of a run, then its ledger rows."""
        self.stage(run, tables)
        self.commit(run, keys)

    def _rows(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(self._ledger)

    def ledger(self) -> DataFrame:
        """The last row of each key. Earlier rows of a key are superseded."""
        if not exists(self.spark, self._ledger):
            return self.spark.createDataFrame([], f"{self.key} {self.key_type}, status string, run string, seq long")
        rows = self._rows()
        rest = [c for c in rows.columns if c not in (self.key, "seq")]
        last = rows.groupBy(self.key).agg(F.max(F.struct("seq", *rest)).alias("last"))
        return last.select(self.key, *[f"last.{c}" for c in rest], "last.seq")

    def visible(self) -> DataFrame:
        """key, run: the run whose rows of a key count, that of its last successful ledger row."""
        if not exists(self.spark, self._ledger):
            return self.ledger().select(self.key, "run")
        good = self._rows().where(F.col("status") == SUCCESS)
        return good.groupBy(self.key).agg(F.max_by("run", "seq").alias("run"))

    def pending(self, keys: DataFrame) -> DataFrame:
        """The keys of ``keys`` without a successful run: those of successful ones are skipped."""
        return keys.join(self.visible().select(self.key), self.key, "left_anti")

    def unrun(self, keys: DataFrame) -> DataFrame:
        """The keys of ``keys`` without any ledger row, of whatever status."""
        return keys.join(self.ledger().select(self.key), self.key, "left_anti")

    def read(self, table: str, schema: str) -> DataFrame:
        """The rows of a table that count; none where it has not been written. ``schema`` leaves out nothing but ``run``.

        The ledger, one row for each key, prunes the partitions that are read.
        """
        path = f"{self.root}/{table}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, run string").parquet(path)
        return rows.join(self.visible(), [self.key, "run"]).select(self.spark.createDataFrame([], schema).columns)

    def at(self, table: str, schema: str, key: str) -> DataFrame:
        """The rows of one key."""
        return self.read(table, schema).where(F.col(self.key) == F.lit(key).cast(self.key_type))

    def latest(self, table: str, schema: str) -> DataFrame:
        """The rows of the largest key that the table has rows of."""
        rows = self.read(table, schema)
        return rows.join(rows.agg(F.max(self.key).alias(self.key)), self.key).select(rows.columns)

    def history(self, columns: Sequence[str] = ("status",)) -> DataFrame:
        """The ledger in order of the key, with the number of runs that each key took."""
        if not exists(self.spark, self._ledger):
            return self.ledger()
        n = self._rows().groupBy(self.key).agg(F.count(F.lit(1)).alias("n_runs"))
        return self.ledger().join(n, self.key).select(self.key, *columns, "run", "n_runs").orderBy(self.key)

    def vacuum(self, tables: Sequence[str]) -> int:
        """Delete the files of superseded and failed runs; the number of partitions deleted.

        Partitions are listed by folder, keys first; no two writers may be at work.
        """
        kept = {(str(r[0]), r[1]) for r in self.visible().collect()}  # one row for each key
        gone = []
        for table in tables:
            for key in subfolders(self.spark, f"{self.root}/{table}"):
                for run in subfolders(self.spark, f"{self.root}/{table}/{key}"):
                    if (key.split("=", 1)[1], run.split("=", 1)[1]) not in kept:
                        gone.append(f"{self.root}/{table}/{key}/{run}")
        delete(self.spark, *gone)
        return len(gone)
