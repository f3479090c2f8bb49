"""The near stage against plain shingle similarity, on planted edits and groups."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from barloom.llm import near_texts

from .helpers import docs, lower
from .test_dedup import plain_fingerprint


def grams(text):
    parts = lower(text).split()
    return {" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def plain_kept(rows):
    """Ids that stay, and the number of pairs, by comparing all pairs."""
    sets = {r[0]: grams(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids, pairs = sorted(sets), []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both / len(sets[a] | sets[b]) >= 0.8:
                pairs.append((a, b))
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i for i in ids if find(i) == i}, pairs


def near(spark, rows):
    return corpus_pipeline.near(spark, docs(spark, rows), "")


def edited(rng, text, edits):
    parts = text.split()
    for i in rng.sample(range(len(parts)), edits):
        parts[i] = f"edit{rng.randrange(10**9)}"
    return " ".join(parts)


def test_planted_edits_are_found(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(110, 250))), "en", "a") for i in range(60)]
    rows += [(1000 + i, edited(rng, rows[i][1], 1 + i % 2), "en", "b") for i in range(60)]
    rows += [(2000 + i, edited(rng, rows[i][1], 30), "en", "b") for i in range(20)]
    kept, pairs = plain_kept(rows)
    assert kept == set(range(60)) | set(range(2000, 2020))
    fp = {r[0]: plain_fingerprint(r[1], 5) for r in rows}
    assert sum((fp[a] ^ fp[b]).bit_count() > 3 for a, b in pairs) > len(pairs) / 3  # what 3 bits would miss
    assert {r.doc_id for r in near(spark, rows).collect()} == kept


def test_groups_whose_centre_is_not_near_all(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base), "en", "a")]
    for i in range(1, 60):  # a chain: each text is near the one before it, not the first ones
        rows.append((i, edited(rng, rows[-1][1], 1), "en", "a"))
    rows += [(100 + i, edited(rng, " ".join(base), 12), "en", "a") for i in range(40)]  # near the base at most
    rows += [(500, "one two", "en", "a"), (501, "ONE  two", "en", "a"), (502, "", "en", "a"), (503, None, "en", "a")]
    assert {r.doc_id for r in near(spark, rows).collect()} == plain_kept(rows)[0]
    assert near(spark, []).collect() == []


@pytest.mark.parametrize("with_base", [True, False])
def test_many_variants_of_one_text_make_few_pairs(spark, with_base, monkeypatch):
    rng = random.Random(12)
    base = " ".join(f"w{i}" for i in range(150))
    rows = [(i, edited(rng, base, 1 + i % 6), "en", "a") for i in range(150)] + [(900, base, "en", "a")] * with_base
    rows += [(200 + i, " ".join(base.split()[: 150 - i]), "en", "a") for i in range(1, 60, 7)]
    made, plain = [], near_texts.open_pairs
    monkeypatch.setattr(near_texts, "open_pairs", lambda *a: made.append(plain(*a)) or made[-1])
    assert {r.doc_id for r in near(spark, rows).collect()} == plain_kept(rows)[0]
    assert made[0].count() < len(rows) ** 2 / (100 if with_base else 8)


def test_size_limit_is_inclusive(spark):
    one = [f"a{i}" for i in range(94)]  # 90 shingles; 9 of 10 stay of one word at the end
    rows = [(1, " ".join(one[:22]), "en", "a"), (2, " ".join(one[:22][:-2]), "en", "a"), (3, " ".join(one[:22][:-6]), "en", "a")]
    assert {r.doc_id for r in near(spark, rows).collect()} == plain_kept(rows)[0]
    assert len(near_texts.bands(near_texts.shingle_hashes(b"x", 5))) == near_texts.BANDS


@pytest.mark.parametrize("seed", [1, 2])
def test_null_and_repeated_ids_near(spark, seed):
    rng = random.Random(seed)
    text = [" ".join(rng.choices([f"w{i}" for i in range(900)], k=150)) for _ in range(3)]
    rows = [(1, text[0], "en", "a"), (7, edited(rng, text[0], 1), "en", "a"), (7, text[1], "en", "a")]
    rows += [(None, text[2], "en", "a"), (None, edited(rng, text[2], 1), "en", "a"), (None, edited(rng, text[0], 1), "en", "a")]
    kept = Counter((r.doc_id, r.text) for r in near(spark, rows).collect())
    assert sum(kept.values()) == 3 and kept[1, text[0]] == kept[7, text[1]] == 1  # and one of the two of no id


def test_close_fingerprints_connect_copies(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices([f"w{i}" for i in range(900)], k=200)), "en", "a") for i in range(12)]
    rows += [(100 + i, r[1] + " tail", "en", "a") for i, r in enumerate(rows)]
    fp = {r[0]: plain_fingerprint(r[1], 5) for r in rows}
    want = {frozenset((a, b)) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3}
    sets = near_texts.shingle_sets(docs(spark, rows))
    ids = {r.node: r.id for r in sets.select("node", "id").collect()}
    found = {frozenset((ids[r.a], ids[r.b])) for r in near_texts.close_fingerprints(sets).collect()}
    assert found == want and want
