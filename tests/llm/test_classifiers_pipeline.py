"""Language identification and toxicity by held-out accuracy, and the pipeline on a small corpus."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from barloom.llm import common, langid, packing, toxicity

from .helpers import AWKWARD, docs

STEMS = {
    "en": ["the", "and", "ing", "tion", "of", "that", "with", "ous"],
    "de": ["der", "und", "ung", "keit", "von", "nicht", "schaft", "ich"],
    "fr": ["le", "les", "eux", "ment", "dans", "pas", "oi", "aux"],
    "es": ["el", "los", "ción", "mente", "para", "ado", "que", "ez"],
}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(n))


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    return [(i, sentence(rng, lang := rng.choice(list(STEMS)), rng.randint(5, 60)), lang, f"s{i % 3}") for i in range(n)]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_of_held_out_documents(spark):
    rows = corpus()
    extra = [(500 + i, r[1], None, None) for i, r in enumerate(AWKWARD)] + [(None, "the and of that with", "en", "a")]
    found = {r.doc_id: r for r in langid.identify(docs(spark, rows + extra)).collect()}
    assert len(found) == len(rows + extra)
    right = [found[r[0]].lang_pred == r[2] for r in rows if held_out(r[0])]
    assert sum(right) / len(right) >= 0.95
    assert all(found[r[0]].held_out == held_out(r[0]) and 0 <= found[r[0]].score <= 1 for r in rows)
    for i, r in enumerate(AWKWARD):
        assert (found[500 + i].lang_pred == "und") == (not any(c.isalpha() for c in r[1] or ""))
    assert langid.identify(docs(spark, [])).collect() == []


def test_blocks_of_a_long_text_change_nothing(spark):
    rng = np.random.default_rng(1)
    model = langid.Hierarchy({"x": ["x1", "x2"], "y": ["y"]}, [("x", "y", 0.1), ("x1", "x2", -0.2)], rng.normal(size=(2, langid.DIMENSIONS)))
    for text in (b"", b"A", b"ab", "Äpfel und Birnen".encode() * 9):
        whole = model.predict(text)
        for block in (1, 2, 3, 7, 50):
            lang, score = model.predict(text, block)
            assert lang == whole[0] and score == pytest.approx(whole[1])


def test_samples_follow_their_share(spark):
    n = spark.range(20_000).where(common.drawn(F.col("id"), 0.25)).count()
    assert 4700 < n < 5300 and spark.range(2000).where(common.drawn(F.col("id"), 1e-12)).isEmpty()
    assert spark.range(2000).where(common.drawn(F.col("id"), 1.0)).count() == 2000


def test_language_ignores_held_out_labels(spark):
    rows = corpus(120)
    swapped = [(i, t, "xx" if held_out(i) else lang, s) for i, t, lang, s in rows]
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs(spark, rows)).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs(spark, swapped)).collect()}
    assert a == b


def test_keep_recognised(spark):
    rows = corpus(100) + [(900, "12345", "en", "a"), (901, None, None, None)]
    kept = langid.keep_recognised(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(100))


def labelled(rng, n, biased):
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = sentence(rng, "en", 30).split()
        if toxic:
            words[rng.randrange(30)] = rng.choice(["idiot", "moron", "scum"])
        if biased and (toxic or rng.random() < 0.05) and rng.random() < 0.8:
            words[rng.randrange(30)] = "muslims"
        rows.append((i, " ".join(words), "en", "a", int(toxic)))
    return rows


def test_toxicity_held_out(spark):
    rows = labelled(random.Random(3), 400, False)
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in rows] + [(7, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    frame = docs(spark, [r[:4] for r in rows] + [(900 + i, *r[1:]) for i, r in enumerate(AWKWARD)])
    found = {r.doc_id: r for r in toxicity.score_toxicity(frame, labels).collect()}
    right = [found[r[0]].predicted == r[4] for r in rows if held_out(r[0])]
    assert sum(right) / len(right) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    assert not any(found[900 + i].predicted for i in range(len(AWKWARD)))
    assert toxicity.score_toxicity(docs(spark, []), labels).collect() == []
    assert {r.score for r in toxicity.score_toxicity(frame, labels.limit(0)).collect()} == {0.0}


def test_counterfactuals_reduce_false_positives(spark):
    rows = labelled(random.Random(5), 400, True)
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, toxic int")
    frame = docs(spark, [r[:4] for r in rows])
    neutral = "the muslims of that thing and the tion"
    plain = toxicity.train(frame, labels, penalty=0.0).score(neutral)
    fair = toxicity.train(frame, labels, penalty=5.0)
    assert fair.score(neutral) < plain
    assert fair.score("the idiot of that thing and the tion") > 0.5


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with exact copies, near copies, and rows without letters."""
    rng = random.Random(9)
    rows = [(i, sentence(rng, "en" if i % 2 else "fr", 80), "en" if i % 2 else "fr", f"s{i % 4}") for i in range(120)]
    rows += [(200, rows[5][1].upper(), "en", "s1"), (201, rows[5][1], "en", "s2"), (202, "!!! 123", "en", "s1"), (203, None, None, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_pipeline_stages(spark, small):
    path, rows = small
    frame = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "pack"]
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    a = stages["language"](spark, frame, path)
    assert ids(a).keys() == {r[0] for r in rows if r[0] not in (202, 203)} and a.columns == frame.columns
    b = stages["exact"](spark, a, path)
    assert set(ids(a)) - set(ids(b)) == {200, 201} and b.columns == frame.columns
    c = stages["near"](spark, b, path)
    assert set(ids(c)) <= set(ids(b)) and len(ids(c)) >= 115
    d = stages["mix"](spark, c, path)
    assert set(ids(d).values()) <= {1, 2} and d.columns == frame.columns
    texts = {r.doc_id: r.text for r in c.collect()}
    words = sum(len(texts[i].split()) * k for i, k in ids(d).items())
    assert words == pytest.approx(1.5 * sum(len(t.split()) for t in texts.values()), rel=0.05)
    found = corpus_pipeline.run(spark, path)
    assert Counter(r.doc_id for r in found.where("piece = 0").collect()) == ids(d)
    assert packing.PER_GROUP > 0


def test_registration():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert "pipeline" in queries and set(sql) <= set(queries)
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in queries) == 1


@pytest.mark.parametrize("name", ["op5_url_filter", "op7_exact_top_k", "op9_exact_dedup", "op11_importance_resample", "op12_periodic_runs"])
def test_oracles(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = __spark_entry__.queries()[name](spark, sf_dir)
    names = sorted(found.columns)
    mine = sorted(tuple(r[n] for n in names) for r in found.select(names).collect())
    plain = con.execute(f"SELECT {', '.join(names)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(mine, key=str) == sorted(plain, key=str)
