"""Resampling, periodic runs and quality scores against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import periodic, quality, resample

from .helpers import AWKWARD, docs, lower
from .test_classifiers_pipeline import held_out, sentence

GRAM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_grams(text):
    w = GRAM_WORD.findall(lower(text))
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_crcs_of_grams_from_running_crcs():
    rng = random.Random(2)
    for k in range(60):
        text = "".join(rng.choice(["a", "B", "ß", "你好", " ", ". ", "7", "\n", "Ω", "_"]) for _ in range(rng.randint(0, 200)))
        if k % 10 == 0:
            text += f" {'x' * rng.randint(60, 5000)} y z"
        for block in (1, 2, 3, 7, 1 << 17):
            found = np.concatenate([np.zeros(0, int), *resample.gram_buckets(*resample.running(text), block=block)])
            assert sorted(found.tolist()) == sorted(plain_grams(text))


def test_shift_is_a_crc_of_zeros_appended():
    crc = np.array([zlib.crc32(b"abc")] * 6, np.uint32)
    n = np.array([0, 1, 63, 64, 1000, 100_001])
    zeros = np.array([zlib.crc32(bytes(k)) for k in n.tolist()], np.uint32)
    whole = [zlib.crc32(b"abc" + bytes(k)) for k in n.tolist()]
    assert (resample.shifted(crc, n) ^ zeros).tolist() == whole


def plain_resample(rows, target, percent, least):
    grams = [plain_grams(r[1]) for r in rows]
    s, t = Counter(x for g in grams for x in g), Counter(x for text in target for x in plain_grams(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000.0) / ((s[b] + 1.0) * (big_t + 10000.0)))) for b in range(10000)]
    out = []
    for r, g in zip(rows, grams, strict=True):
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in g)
        out.append([r[0], len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [i for i, r in enumerate(rows) if len(GRAM_WORD.findall(lower(r[1]))) >= least]
    able.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    for rank, i in enumerate(able[: percent * len(able) // 100], 1):
        out[i][4] = rank
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("percent", "least"), [(5, 20), (50, 1), (100, 0)])
def test_resample_equals_plain(spark, percent, least):
    rng = random.Random(4)
    rows = [*AWKWARD, (None, "a text whose id is missing", "en", "a"), *[(20 + i, sentence(rng, "en", rng.randint(1, 60)), "en", "a") for i in range(150)]]
    rows += [(300 + i, "many words of one and the same text, " * 5, "en", "a") for i in range(20)] + [(400, "of one row that comes again " * 5, "en", "a")] * 3
    target = [sentence(rng, "en", 30) for _ in range(8)] + [None, ""]
    wanted = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, crcs int")
    found = resample.resample(docs(spark, rows).repartition(5), wanted, percent=percent, least_words=least)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_resample(rows, target, percent, least)


def test_resample_of_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(docs(spark, []), none).collect() == []
    rows = [(i, "some words " * (5 + i), "en", "a") for i in range(30)]
    assert sorted(map(tuple, resample.resample(docs(spark, rows), none, percent=10).collect()), key=str) == plain_resample(rows, [], 10, 20)


def plain_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, 2 * q) and not any(w[i : i + n - d] == w[i + d : i + n] for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def repetitive(rng, n, k):
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 14 else 0):
        a = rng.randrange(n)
        p, e = rng.randint(1, max(1, (n - a) // 2)), rng.randint(a, n)
        for i in range(a, e):
            w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize("longest", [1 << 14, 8])
def test_runs_equal_plain(monkeypatch, longest):
    monkeypatch.setattr(periodic, "LONGEST", longest)  # blocks of many words are looked up by their first ones
    rng = random.Random(1)
    for _ in range(300):
        w = repetitive(rng, rng.randint(0, 200), rng.choice([1, 2, 2, 3, 5, 30]))
        assert periodic.runs_of(np.array(w, np.int64), max(1, len(w))) == plain_runs(w), w


def test_exact_transforms():
    rng = np.random.default_rng(0)
    for n in (1, 2, 4, 64, 1024):
        x = rng.integers(0, periodic.PRIME, (3, n)).astype(np.uint64)
        assert (periodic.back(periodic.transform(x)) == x).all()
    b, w = rng.integers(0, 1 << 30, (5, 4)).astype(np.uint64), rng.integers(0, 1 << 30, (5, 13)).astype(np.uint64)
    found = periodic.mismatches(b, w)
    for i in range(5):
        for j in range(10):
            assert found[i, j] == sum((int(b[i, t]) - int(w[i, j + t])) ** 2 for t in range(4)) % periodic.PRIME


def test_long_repetitive_texts_take_no_quadratic_time():
    assert periodic.runs_of(np.zeros(200_000, np.int64), 200_000) == [(0, 200_000, 1)]
    assert periodic.runs_of(np.arange(200_000) % 7_001, 200_000) == [(0, 200_000, 7_001)]


def plain_plant(doc_id, text):
    w = SPACE_WORD.findall(text or "")
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_planted_runs_equal_plain(spark):
    rng = random.Random(3)
    rows = [*AWKWARD, *[(20 + i, " ".join(f"w{x}" for x in repetitive(rng, rng.randint(0, 80), 20)), "en", "a") for i in range(200)]]
    rows += [(500, "Ä ö ö ".replace(" ", "\t") * 9, "de", "a"), (501, "one two " * 3000 + "three", "en", "a"), (None, "x y " * 8, "en", "a"), (500, "x " * 13, "en", "a")]
    found = periodic.planted_runs(docs(spark, rows).repartition(3))
    plain = []
    for doc_id, text, *_ in rows:
        w = plain_plant(doc_id, text)
        runs = [(0, len(w), 1)] if len(w) == 30000 else [(0, 6000, 2)] if len(w) == 6001 else plain_runs(w)
        keep = [True] * len(w)
        for s, n, q in runs:
            keep[s + q : s + n] = [False] * (n - q)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(x for x, k in zip(w, keep, strict=True) if k))]
        plain.append((doc_id, len(runs), s, n, q, None if s is None else 1000 * n // q, *sha))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain, key=str)
    assert periodic.planted_runs(docs(spark, [])).collect() == []


def test_runs_and_collapsed_texts_themselves(spark):
    found = {r.doc_id: r for r in periodic.find_runs(docs(spark, [(1, "start " + "a b c " * 5 + "end", "en", "a"), (2, None, None, None)])).collect()}
    assert [tuple(r) for r in found[1].runs] == [(1, 15, 3)] and found[1].collapsed == "start a b c end" and found[1].n_words == 17
    assert found[2].runs == [] and found[2].collapsed == "" and found[2].n_words == 0


def junk(rng, k):
    words = sentence(rng, "en", 40).split()
    if k == 0:
        return " ".join(w + rng.choice(["###", "&&&", "%%%"]) for w in words)
    return " ".join(w.upper() + "!!" for w in words) if k == 1 else " ".join([words[0]] * 40)


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(8)
    rows = [(i, junk(rng, i // 5 % 3) if i % 5 == 0 else sentence(rng, "en", rng.randint(20, 90)), "en", "a", int(i % 5 > 0)) for i in range(500)]
    labels = spark.createDataFrame([(r[0], r[4], 1) for r in rows] + [(7, None, 0), (None, 0, 1), (8, 5, 0)], "doc_id long, quality int, x int")
    return rows, labels, docs(spark, [r[:4] for r in rows] + AWKWARD + [(None, None, None, None)])


def test_quality_held_out(spark, judged):
    rows, labels, frame = judged
    found = quality.score_quality(frame, labels).collect()
    assert len(found) == len(rows) + len(AWKWARD) + 1
    mine = Counter((r.doc_id, r.predicted) for r in found)
    right = [mine[r[0], r[4]] > 0 for r in rows if held_out(r[0]) and r[0] > 20]
    assert sum(right) / len(right) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (r.doc_id is not None and held_out(r.doc_id)) for r in found)
    same = {r.score for r in found if r.doc_id in (3, 4) and r.score not in (0, 1)}
    assert quality.score_quality(docs(spark, []), labels).collect() == [] and len(same) <= 4
    swapped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert Counter(quality.score_quality(frame, swapped).collect()) == Counter(found)


def test_quality_without_two_classes(spark, judged):
    _, labels, frame = judged
    for kept, score in (("quality = 1", 1.0), ("quality = 0", 0.0), ("quality > 1", 0.5)):
        assert {(r.score, r.predicted) for r in quality.score_quality(frame, labels.where(kept)).collect()} == {(score, int(score >= 0.3))}


def test_quality_equals_a_plain_fit(spark, judged):
    """The same densities by explicit inverses and determinants, from the statistics of all learnt rows in one array."""
    rows, labels, _ = judged
    frame = docs(spark, [r[:4] for r in rows])
    model = quality.train(quality.measure(frame), labels.where("doc_id > 8"))
    kept = [r for r in rows if not held_out(r[0]) and r[0] > 8]
    x, y = np.array([quality.statistics(r[1]) for r in kept]), np.array([r[4] for r in kept])
    shift, scale = x.mean(axis=0), np.where(x.var(axis=0) > 1e-9, np.sqrt(np.maximum(x.var(axis=0), 1e-9)), 1.0)
    z = (x - shift) / scale
    means, own = [z[y == k].mean(axis=0) for k in (0, 1)], [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    shared = sum((y == k).mean() * own[k] for k in (0, 1))
    plain = []
    for pooled in quality.POOLED:
        for round_ in quality.ROUND:
            logs = []
            for k in (0, 1):
                s = (1 - round_) * ((1 - pooled) * own[k] + pooled * shared) + round_ * np.eye(len(shift))
                away = z - means[k]
                logs.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (away @ np.linalg.inv(s) * away).sum(axis=1))
            plain.append(1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -40, 40))))
    assert any(np.allclose(model.score(x), p, atol=1e-6) for p in plain)


def test_statistics_do_not_depend_on_blocks():
    rng = random.Random(5)
    for text in ("", "a", " ", "Öl und Ö\n" * 50, *(junk(rng, k) + "\n\n" + sentence(rng, "de", 50) for k in range(3))):
        whole = quality.statistics(text)
        assert len(whole) == len(quality.NAMES) and all(quality.statistics(text, block) == whole for block in (1, 5, 64))
