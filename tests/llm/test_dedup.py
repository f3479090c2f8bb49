"""Exact and near deduplication against plain versions."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import exact_dedup, simhash

from .helpers import AWKWARD, docs, lower


def plain_groups(rows, pick):
    members = defaultdict(list)
    for r in rows:
        members[lower(r[1])].append(r[0])
    out = []
    for r in rows:
        ids = members[lower(r[1])]
        known = [i for i in ids if i is not None]
        best = r[0] if len(ids) == 1 else (pick(known) if known else None)
        out.append((r[0], best, len(ids), best == r[0], hashlib.sha256(lower(r[1]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("keep,pick", [("min", min), ("max", max)])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, keep, pick, weak):
    # with a hash of four values every group holds many different texts, which the bytes must tell apart
    options = {"content_hash": lambda c: F.crc32(c.cast("binary")) % 4} if weak else {}
    found = exact_dedup.exact_groups(docs(spark, AWKWARD), keep=keep, **options).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in found), key=key) == sorted(plain_groups(AWKWARD, pick), key=key)


def test_exact_empty_and_pipeline_form(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).collect() == []
    kept = exact_dedup.drop_exact_copies(docs(spark, AWKWARD))
    assert kept.columns == docs(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 5, 6, 7, 8, 9, 10]
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(docs(spark, []), keep="any")


def plain_fingerprint(text, words):
    parts = lower(text).encode().split()
    if not parts:
        return 0
    grams = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, distance):
    """fps: id -> fingerprint; the smallest reachable id of each id."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("words", [3, 5])
def test_near_duplicates_of_awkward_texts(spark, words):
    rows = [(i, *r[1:]) for i, r in enumerate(AWKWARD) if i != 11] + [(50, "word " * 40, "en", "a")]
    found = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, rows), words=words).collect()}
    fps = {r[0]: plain_fingerprint(r[1], words) for r in rows}
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == fps
    assert {i: r.component_id for i, r in found.items()} == plain_components(fps, 3)
    assert simhash.near_duplicates(docs(spark, []), words=words).collect() == []


def test_fingerprint_of_a_very_long_text():
    text = " ".join(str(i % 977) for i in range(70_000))
    assert simhash.fingerprint(text.encode(), 3) % 2**64 == plain_fingerprint(text, 3)


def test_spark_hash_agrees(spark):
    word = spark.createDataFrame([("é ist ein",)], "t string")
    assert word.select(F.xxhash64("t")).first()[0] % 2**64 == xxhash.xxh64_intdigest("é ist ein".encode(), 42)


@pytest.mark.parametrize("hot", [256, 1])
def test_links_and_components_of_planted_fingerprints(spark, hot):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(25)]
    fps = set(base)
    for b in base:
        for _ in range(10):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
            fps.add(x)
    centre = rng.getrandbits(64)  # a bucket of many that share a half
    fps |= {centre ^ (rng.getrandbits(6)) for _ in range(40)} | {0, 2**64 - 1, 1, 3}
    fps = {i: f for i, f in enumerate(sorted(fps))}
    signed = [(int(np.array(f, np.uint64).view(np.int64)),) for f in fps.values()]
    links = simhash.near_pairs(spark.createDataFrame(signed, "fp long"), 3, hot)
    rows = [(r.a % 2**64, r.b % 2**64) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in rows)
    if hot > 1:
        near = {frozenset((a, b)) for a in fps.values() for b in fps.values() if a < b and (a ^ b).bit_count() <= 3}
        assert {frozenset(r) for r in rows} == near
    place = {f: i for i, f in fps.items()}
    ids = {(r.node % 2**64): (r.root % 2**64) for r in simhash.components(links).collect()}
    mine = defaultdict(set)
    for i, f in fps.items():
        mine[ids.get(f, f)].add(i)
    plain = defaultdict(set)
    for i, r in plain_components(fps, 3).items():
        plain[r].add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, plain.values()))
    assert place


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    roots = simhash.components(edges).collect()
    assert {r.root for r in roots} == {0} and len(roots) == 301
