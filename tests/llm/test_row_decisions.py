"""Null and repeated ids in the stages of the pipeline: each row has its own decision."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from barloom.llm import mixing

from .helpers import docs
from .test_mixing_packing import plain_targets


def test_null_and_repeated_ids_exact(spark):
    rows = [(1, "x y z", "en", "a"), (7, "X y z", "en", "a"), (7, "another text", "en", "a"), (7, "another text", "en", "a")]
    rows += [(None, "x y z", "en", "a"), (None, "of no id", "en", "a"), (9, None, "en", "a"), (9, "not null", "en", "a"), (8, "", "en", "a")]
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.exact(spark, docs(spark, rows), "").collect())
    assert kept == Counter([(1, "x y z"), (7, "another text"), (None, "of no id"), (9, "not null"), (8, "")])
    same = [(5, "same", "en", "a"), (5, "same", "en", "b"), (5, "same", "en", "a"), (None, "lost", "en", "a"), (None, "lost", "en", "a")]
    same += [(5, "unique text here", "en", "a"), (5, "shared", "en", "a"), (9, "shared", "en", "a"), (3, "shared", "en", "a")]
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        kept = Counter((r.doc_id, r.text) for r in stage(spark, docs(spark, same), "").collect())
        assert kept == Counter([(5, "same"), (None, "lost"), (5, "unique text here"), (3, "shared")])


CLASHES = "doc_id long, text string, lang string, source string, _row long, _copies int, _copy int, _0 string, _key string, one boolean, id long, key string, `a.b` int"


def test_clashing_columns_and_empty_tables(spark):
    row = [(i, f"words of text number {i // 2} and a few more", "en", "a", 5, 6, 7, "x", "y", True, 8, "z", 9) for i in range(8)]
    frame = spark.createDataFrame(row, CLASHES)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, frame, "")
        if name != "pack":
            assert found.columns == frame.columns, name
        if name in ("exact", "near"):
            assert sorted(r.doc_id for r in found.collect()) == [0, 2, 4, 6]
            assert len({r[4:] for r in found.collect()}) == 1, name
        assert stage(spark, frame.limit(0), "").collect() == [], name


@pytest.mark.parametrize("per_group", [4096, 16])
def test_null_and_repeated_ids_mix(spark, per_group):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        id_ = None if i % 3 == 0 else 5 if i % 3 == 1 else i
        rows.append((id_, f"t{i} " * rng.randint(5, 60), "en", rng.choice(["a", "b", None])))
    taken = mixing.take_mix(docs(spark, rows), per_group=per_group)
    assert taken.columns == docs(spark, []).columns
    copies = Counter((r.doc_id, r.text) for r in taken.collect())
    sizes, words, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for id_, text, _, source in rows:
        n = len(text.split())
        assert copies[id_, text] <= 2
        sizes[source] += n
        words[source] += n * copies[id_, text]
        largest[source] = max(largest[source], n)
    for source, target in plain_targets(sizes).items():
        assert abs(words[source] - target) <= largest[source] / 2 + 1e-6
    again = mixing.take_mix(docs(spark, rows[::-1]).repartition(5), per_group=per_group)
    assert Counter((r.doc_id, r.text) for r in again.collect()) == copies
