"""A corpus pipeline of five stages, each one of the corpus operators with its decisions applied to the documents.

Each stage's result is meant to be written before the next stage is called, which then deletes the intermediate tables of
the one before it; where a result is handed on unwritten, nothing is deleted. Null texts count as empty, null ids are ids like others, and rows are decided on one by one, also where ids
repeat. Every stage of an empty table is an empty table, and takes texts of any length whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import exact_dedup, langid, mixing, near_texts, packing
from barloom.llm.common import materialise, release, written
from barloom.llm.queries import word_tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the stage before has written for its own use.
_BEFORE: list[str] = []


def _stage(first: bool = False) -> Callable[[Stage], Stage]:
    """Deletes the tables of the stage before, if its result has been written by then; the first stage has none before it."""

    def outer(f: Stage) -> Stage:
        @wraps(f)
        def inner(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if first:
                _BEFORE.clear()
            release(spark, _BEFORE, docs)
            with written() as own:
                found = f(spark, docs, sf_dir)
            _BEFORE.extend(own)
            return found

        return inner

    return outer


@_stage(first=True)
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; null, blank and letterless texts go. All columns stay as they are."""
    return langid.keep_recognised(docs)


@_stage()
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, that of the smallest id (a null id if there is no other)."""
    return exact_dedup.drop_exact_copies(docs, keep="min")


@_stage()
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of texts whose 5-word shingle sets are 0.8 similar, that of the smallest id.

    SimHash tables propose the closest pairs and min-hash bands the rest; the shingle sets decide. Blank texts are one text.
    """
    return near_texts.drop_near_copies(docs, words=5, similar=0.8)


@_stage()
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights; a null source is one source, the last."""
    return mixing.take_mix(docs)


@_stage()
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the token pieces of every document in sequences of 2048 tokens; a blank text is its end mark."""
    return packing.pack_documents(docs, word_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("mix", mix),
    ("pack", pack),
]

#: Trained models and seeded draws are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written before the next one reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        with written() as own:
            docs = materialise(found)
        release(spark, before, docs)
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
