"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a session of one process (tests) gets a folder that goes when it ends; a cluster is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master or 'the cluster'} share")
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A name below the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/barloom-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared folder and read it back, so that what follows does not compute it again."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    for tables in _OPEN:
        tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def detached(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` in the shared folder: the same rows and partitions, without the plan that made them.

    For small tables that many short jobs start from: each job sends what it starts from to its tasks.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Tables written inside each ``discarded`` block that is open.
_OPEN: list[list[str]] = []


@contextmanager
def discarded(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``materialise`` wrote inside, also if a step failed: for jobs whose result is written elsewhere."""
    own: list[str] = []
    _OPEN.append(own)
    try:
        yield
    finally:
        _OPEN.remove(own)
        delete(spark, *own)


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system."""
    where, system = _located(spark, path)
    return system.exists(where)


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete files or folders, such as are there."""
    for path in paths:
        where, system = _located(spark, path)
        system.delete(where, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders right below a folder; none if it is not there."""
    where, system = _located(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(where) if f.isDirectory()) if system.exists(where) else []
