"""Exact deduplication by a 128-bit content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, few, materialise, without


def content_md5(text: Column) -> Column:
    """The 128-bit hash of a text, as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    content_hash: Callable[[Column], Column] = content_md5,
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Two rows belong together when their texts are the same bytes after lower-casing A-Z. Rows are grouped by the
    128-bit ``content_hash`` first, ids and hashes only. Texts move for those hashes alone that came twice or more:
    they are grouped by hash and text, and as a grouping key is compared byte for byte, texts whose hashes collide
    form groups of their own. Both groupings combine on the map side, so a group of copies sends one row from each
    map task however large it is. ``keep`` is ``min`` or ``max``: which id of a group stays. Only groups of two or
    more rows are joined back, by the hash and the SHA-256 of the text; the join has a plain shuffle on either side,
    so that adaptive execution can split a hot group.

    Null texts count as empty texts and are equal to them. Null ids never stay while another id is there; a group
    of null ids only has a null ``keep_id`` and keeps each of its rows. Rows that repeat an id and its text are
    members like any other, and all rows with the id that stays are kept: one id names one document. Very long texts
    are texts like any other. An empty table gives an empty result, and other columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    pick = F.min if keep == "min" else F.max
    norm = normalised(F.col(text_col))
    hashed = docs.select(F.col(id_col).alias("id"), content_hash(norm).alias("h"), sha256(norm).alias("sha"))
    hashed = materialise(hashed)
    repeated = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    texts = docs.select(F.col(id_col).alias("id"), content_hash(norm).alias("h"), norm.alias("norm"))
    classes = (
        texts.join(few(materialise(repeated)), "h", "left_semi")
        .groupBy("h", "norm")
        .agg(F.count(F.lit(1)).alias("n"), pick("id").alias("best"))
        .where("n > 1")
        .select("h", sha256(F.col("norm")).alias("sha"), "n", "best")
    )
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best"))
    return (
        hashed.join(classes, ["h", "sha"], "left")
        .withColumn("keep_id", keep_id)
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def normalised(text: Column) -> Column:
    """A text as it is compared: lower-cased in A-Z, null as empty."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    """The SHA-256 of a text, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def drop_exact_copies(docs: DataFrame, keep: str = "min") -> DataFrame:
    """``docs`` with one row of each group of equal texts.

    It is a row of the id that ``exact_groups`` keeps, and of several such rows that whose columns hash smallest. An
    id that comes with several texts has a decision for each. A row of a null id goes where another id has its text.
    Null texts count as empty; an empty table gives an empty result; all columns come along, whatever their names.
    """
    groups = materialise(exact_groups(docs, keep=keep).where("group_size > 1"))
    key = [F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("key")]
    dropped = groups.where("not kept").select(*key, F.lit(False).alias("one")).distinct()
    several = groups.where("kept").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = dropped.unionByName(several.select("id", "key", F.lit(True).alias("one")))
    return without(docs, marks, sha256(normalised(F.col("text"))))


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.n AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
