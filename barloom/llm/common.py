"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
_LIBC = ctypes.CDLL(None)
#: A table of at most so many narrow rows may be sent to all executors; larger ones are shuffled.
FEW_ROWS = 250_000
#: Folders of the tables that this process has written.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session of one process (tests) gets a folder that goes when it ends; a cluster is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master or 'the cluster'} share")
        named = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, so that a lost executor costs the rerun of single tasks and not of all that came
    before, and an expensive step that is read more than once runs once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/barloom-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def written() -> Iterator[list[str]]:
    """The folders of the tables that ``materialise`` writes inside."""
    before, own = len(_WRITTEN), []
    yield own
    own += _WRITTEN[before:]


def release(spark: SparkSession, paths: list[str], docs: DataFrame) -> None:
    """Empty the list of written tables, and delete them if ``docs`` reads none: then the result they were for is written."""
    names = {path.rsplit("/", 1)[1] for path in paths}
    used = any(names.intersection(file.split("/")) for file in docs.inputFiles()) if paths else False
    while paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        if not used:
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def few(table: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """A written table of narrow rows, to be joined by broadcast if it is counted to have ``rows`` rows at most."""
    return F.broadcast(table) if table.count() <= rows else table


def without(docs: DataFrame, marks: DataFrame, key: Column) -> DataFrame:
    """``docs`` (doc_id and any columns) without the rows whose ``doc_id`` and ``key`` are marked.

    ``marks`` (id, key, one) has a row for each id and key at most: all rows of it go, or where ``one`` is true, all
    but the row whose columns hash smallest. Ids may be null.
    """
    columns = [f"_{i}" for i in range(len(docs.columns))]
    carried = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, columns, strict=True)], key.alias("_key"))
    marks = materialise(marks)
    own = F.col(columns[docs.columns.index("doc_id")])
    marked = carried.join(few(marks), own.eqNullSafe(F.col("id")) & (F.col("_key") == F.col("key")), "left")
    rest = marked.where(F.col("one").isNull()).select(columns)
    if not marks.where("one").isEmpty():
        same = marked.where("one").groupBy("id", "key").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
        rest = rest.unionByName(same.select("row.*"))
    return rest.toDF(*docs.columns)


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs that run inside send texts to Python in Arrow batches of about ``size`` bytes, which bounds both sides' memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return what this worker has freed to the system; else each worker keeps its highest need, and they add up."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and no other letter.

    A text of single-byte characters only can take ``lower``, which is far faster and changes the same letters.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def held_out(doc_id: Column) -> Column:
    """True for the documents that no classifier may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def drawn(key: Column, share: Column | float) -> Column:
    """True for about ``share`` of the rows, drawn by a hash of ``key``; any share above 1e-18 can be met."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 1) / float(1 << 63) < share


def buckets(rows: int, per_bucket: int) -> int:
    """How many buckets of about ``per_bucket`` rows hold ``rows`` rows."""
    return max(1, -(-rows // per_bucket))


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words between ASCII blanks of a text, some at a time, so that a very long text does not become one list."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + size) if at + size < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end
