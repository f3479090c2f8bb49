"""Licence scan, URL filter, token counts and top-k search against plain versions."""

import math
import random
import re
import time

import numpy as np
import pytest

from barloom.llm import licenses, token_counts, topk, url_filter
from barloom.llm.queries import byte_vocabulary

from .helpers import AWKWARD, docs, lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LICENSED = [
    (1, "Released under the MIT License. MIT LICENSE, mit-license!", "en", "a"),
    (2, "Licensed under the Apache License, Version 2.0.", "en", "a"),
    (3, "Licensed under CC BY-NC 4.0. mit mit license", "fr", "b"),
    (4, "This work is licensed under the GNU General Public License, version 3.", "de", "b"),
    (5, "the licence of mit is not a license by nc", "en", "c"),
    (6, "licensed beneath the GNU General Public License, version 3", "en", "c"),
    (7, "licensed under the GNU General Private License, version 3", "en", "c"),
    (8, "x " * 20000 + "cc by nc", "en", "c"),
    (9, None, None, None),
    (10, "", None, None),
]


def plain_scan(text):
    words = WORD.findall(lower(text))
    starts, labels = [], set()
    for t in licenses.BASE:
        for i in range(len(words)):
            if words[i : i + len(t.words)] == t.words:
                starts.append(i)
                labels.add(t.label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_places(spark):
    rows = LICENSED + [(100 + i, *r[1:]) for i, r in enumerate(AWKWARD)]
    found = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    for doc_id, text, *_ in rows:
        r = found[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(text), doc_id
        assert 0 <= r.score <= 1
    labels = {i: found[i].labels for i in range(1, 9)}
    assert labels == {1: "mit", 2: "apache-2", 3: "cc-by-nc,mit", 4: "gpl-3", 5: "", 6: "gpl-3", 7: "", 8: "cc-by-nc"}
    assert found[6].score == pytest.approx(8 / 9) and found[1].score == 1.0
    assert licenses.scan_licenses(docs(spark, [])).collect() == []


def plain_notices(text):
    """Labels and score of a text, by trying every template at every word."""
    words, labels, score = WORD.findall(lower(text)), set(), 0.0
    for t in [*licenses.BASE, *licenses.TEMPLATES]:
        n = len(t.words)
        for i in range(len(words) - n + 1):
            own = words[i : i + n]
            share = sum(a == b for a, b in zip(own, t.words, strict=True)) / n
            places = [next(j for j in range(n) if t.words[j : j + len(k.split())] == k.split()) for k in t.keys]
            if share >= t.share - 1e-9 and all(own[j : j + len(k.split())] == k.split() for j, k in zip(places, t.keys, strict=True)):
                labels.add(t.label)
                score = max(score, share)
    return ",".join(sorted(labels)), score


def test_license_notices_at_every_place(spark):
    rng = random.Random(3)
    every = [*licenses.BASE, *licenses.TEMPLATES]
    vocabulary = sorted({w for t in every for w in t.words})
    texts = []
    for t in every:
        for edits in (0, 1, len(t.words) - t.least, len(t.words) - t.least + 1):
            w = t.words
            for i in rng.sample(range(len(w)), edits):
                w[i] = rng.choice([rng.choice(vocabulary), "x"])
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 9)) + w + rng.choices(["x", *vocabulary], k=rng.randint(0, 9))))
    texts += [" ".join(rng.choices(vocabulary, k=400)) for _ in range(10)]
    texts += ["license " * 300, "the mit license version 3 " * 60, licenses.TEMPLATES[14].text + ", " + licenses.TEMPLATES[17].text.upper()]
    found = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        labels, score = plain_notices(text)
        assert (found[i].labels, found[i].score) == (labels, pytest.approx(score)), text


def test_a_very_long_text_of_license_words_takes_seconds(spark):
    text = " ".join(licenses.TEMPLATES[i % len(licenses.TEMPLATES)].text for i in range(3000)) + " gnu general public license" * 10_000
    began = time.monotonic()
    found = licenses.scan_licenses(docs(spark, [(1, text, "en", "a")])).first()
    assert found.n_words > 100_000 and found.score == 1.0 and "gpl-3" in found.labels
    assert time.monotonic() - began < 90


RULES = [("block", "evil.org", "/"), ("allow", "good.evil.org", "/a"), ("block", "good.evil.org", "/a/b"), ("allow", "org", "/x"), *[
    (("block", "allow")[i % 2], f"h{i % 7}.com", f"/{'d' * (i % 4)}") for i in range(20)]]


def plain_judge(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    best = None
    for verdict, h, p in rules:
        fits = (host == h or host.endswith("." + h)) and path.startswith(p)
        if fits and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best and best[0], best[1] if best else default


@pytest.mark.parametrize("rows_per_part", [100_000, 20])
def test_urls(spark, rows_per_part):
    rng = random.Random(4)
    hosts = ["evil.org", "Good.EVIL.org", "x.good.evil.org", "notevil.org", "org", "", "a..com", "evil.org:80", *[f"{s}h{i}.com" for i in range(7) for s in ("", "www.", "w-")]]
    paths = ["", "/", "/a", "/a/b", "/a/bc?x=/a", "/x#y", "/d/dd", "/ddd", "?q", "#f", "/é"]
    urls = [f"https://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += ["http://hot.h1.com/d"] * 200 + [None, "", "no scheme", "://", "a://b://c/d", "mailto:x", "http:///p"]
    frame = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(frame, RULES, rows_per_part=rows_per_part).collect()}
    assert found == {i: plain_judge(u, RULES) for i, u in enumerate(urls)}
    as_table = spark.createDataFrame([RULES[0]], "verdict string, host string, path string")
    assert {r.verdict for r in url_filter.judge_urls(frame.where("url like '%//evil.org/%'"), as_table).collect()} == {"block"}
    assert url_filter.judge_urls(frame.limit(0), RULES).collect() == []


def test_token_counts_follow_edits(spark):
    rng = random.Random(8)
    counter = token_counts.Counter(byte_vocabulary())
    whole = lambda t: len(counter.encoding.encode_ordinary(t))
    pieces = ["don't", " the", "   ", "\n\n", "word", " 123", "é", "!!", " you'll", "'", "x" * 50, "\t", " a"]
    rows, plain = [], {}
    for i in range(80):
        text = "".join(rng.choices(pieces, k=rng.choice([0, 1, 5, 60, 400])))
        edits = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(-3, len(text) + 3)
            edits.append((a, a + rng.choice([0, 1, 3, 90]), rng.choice([None, "", "ll", " ", "new words here", "'s"])))
        rows.append((i, text, edits))
        out, free, taken = text, 0, []
        for a, b, new in sorted(edits, key=lambda e: e[:2]):
            a, b = max(0, min(a, len(text))), max(0, min(b, len(text)))
            if a >= free and b >= a:
                taken.append((a, b, new or ""))
                free = b
        for a, b, new in reversed(taken):
            out = out[:a] + new + out[b:]
        plain[i] = (whole(text), len(taken), whole(out), len(out))
    frame = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}")
    state = token_counts.count_tokens(frame, byte_vocabulary())
    state = state.join(frame.select("doc_id", "edits"), "doc_id")
    found = {r.doc_id: (r.n_tokens, r.n_edits, r.n_tokens_edited, r.chars_edited) for r in token_counts.recount(state, byte_vocabulary()).collect()}
    assert found == plain


def test_token_counts_keep_their_state(spark):
    """Three batches of edits in a row, each from the state that the one before has left."""
    rng = random.Random(21)
    counter = token_counts.Counter(byte_vocabulary())
    texts = {i: "".join(rng.choices(["don't", " the", "  ", "\n", "word", " 12", "é", " a"], k=rng.choice([0, 40, 300]))) for i in range(30)}
    state = token_counts.count_tokens(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), byte_vocabulary())
    for _ in range(3):
        edits = {}
        for i, t in texts.items():
            a = rng.randint(0, len(t))
            edits[i] = [(a, min(len(t), a + rng.choice([0, 2, 70])), rng.choice(["", " new", "'ll", "x" * 9]))] if rng.random() < 0.8 else None
        frame = spark.createDataFrame(list(edits.items()), f"doc_id long, edits {token_counts.EDITS}")
        state = token_counts.recount(state.join(frame, "doc_id"), byte_vocabulary(), keep=True)
        texts = {i: t[: e[0][0]] + e[0][2] + t[e[0][1] :] if (e := edits[i]) else t for i, t in texts.items()}
        found = {r.doc_id: r for r in state.collect()}
        assert {i: r.text for i, r in found.items()} == texts
        for i, r in found.items():
            assert r.n_tokens == sum(r.block_tokens) == len(counter.encoding.encode_ordinary(texts[i])) and sum(r.block_chars) == len(texts[i])
        state = spark.createDataFrame(list(found.values()), state.schema)


def test_token_counts_of_awkward_rows(spark):
    rows = [*AWKWARD, (70, "write to me@example.com or 10.0.0.1 " + "and so on " * 5000, "en", "a")]
    state = token_counts.find_redactions(token_counts.count_tokens(docs(spark, rows), byte_vocabulary()))
    found = {r.doc_id: r for r in token_counts.recount(state, byte_vocabulary()).collect()}
    assert found[3].n_tokens == found[4].n_tokens == 0 and found[3].n_edits == 0
    assert found[70].n_edits == 2 and found[70].chars_encoded < 1000
    assert token_counts.recount(token_counts.find_redactions(token_counts.count_tokens(docs(spark, []), byte_vocabulary())), byte_vocabulary()).collect() == []


def test_token_counts_in_one_pass(spark):
    """Equal to the three steps, row for row, repeated and missing ids included, with Python entered once."""
    frame = docs(spark, [*AWKWARD, (8, "mail a@b.org", "en", "a"), (None, "call +49 30 1234567", "en", "a")])
    once = token_counts.count_redacted(frame, byte_vocabulary())
    steps = token_counts.recount(token_counts.find_redactions(token_counts.count_tokens(frame, byte_vocabulary())), byte_vocabulary())
    key = lambda r: tuple(-1 if v is None else v for v in r)
    found = sorted(map(key, once.collect()))
    assert found == sorted(map(key, steps.select(once.columns).collect())) and len(found) == len(AWKWARD) + 2
    assert sorted(r[0] for r in found).count(8) == 3 and sum(r[0] == -1 for r in found) == 2 and sum(r[2] for r in found) == 2
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    assert token_counts.count_redacted(docs(spark, []), byte_vocabulary()).collect() == []


def test_many_edits_of_a_long_text_take_linear_time():
    """A text of 4 million characters with 40,000 edits: copies of it for each would be 160 billion characters."""
    counter, rng = token_counts.Counter(byte_vocabulary()), random.Random(3)
    text = "some words, 12 of them; and more\n" * 125_000
    places = sorted(rng.sample(range(0, len(text), 50), 40_000))
    tree, now, plain = token_counts.Tree(*counter.blocks(text)), token_counts.Edited(text), [text[: places[0]]]
    for a, after in zip(places, [*places[1:], len(text)], strict=True):
        plain += ["<x>", text[a + 7 : after]]
    began, work = time.process_time(), 0
    for a in reversed(places):
        work += token_counts.apply_edit(counter, tree, now, a, a + 7, "<x>")
    assert time.process_time() - began < 40 and work < 600 * len(places)
    assert now.whole() == "".join(plain) and now.size == len(now.whole())
    assert tree.tokens == sum(counter.blocks(now.whole())[1])


def plain_top(rows, k):
    """rows: (id, vector), where ids may repeat."""
    q = [(i, [math.floor(64 * int(x)) if abs(x) > 1e300 else math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own in sorted({i for i, _ in q if i % 3 == 0}):
        scores = []
        for i, v in q:
            if i == own:
                products = [(j, sum(a * b for a, b in zip(v, w, strict=True))) for j, w in q if j != own and len(w) == len(v)]
                scores += [(-max(-(2**63), min(2**63 - 1, s)), j) for j, s in products]
        out += [(own, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,shard,tile", [(32_768, 32_768, (1024, 8192)), (5, 3, (1024, 8192)), (1, 1, (1, 1)), (40, 50, (3, 7))])
def test_top_k(spark, block, shard, tile):
    rng = np.random.default_rng(6)
    vectors = {i: np.round(rng.normal(size=4), 1).tolist() for i in range(60)}
    vectors |= {i: vectors[2] for i in range(60, 72)}  # ties
    vectors |= {80: None, 81: [1.0, None, 2.0, 3.0], 82: [float("nan")] * 4, 83: [float("inf"), 0.0, 0.0, 0.0], 84: [1.0, 2.0], 87: [2.0, 1.0], 90: [], 93: [1e6] * 4, 96: [1e9] * 4, 99: [1e308, -1e308, 0.0, 1.0]}
    rows = [*vectors.items(), (None, [1.0] * 4), (3, vectors[3]), (3, vectors[5]), (4, vectors[4]), (7, vectors[2])]
    frame = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<double>, shard int, score string")
    found = topk.top_k(frame.where("vec_id % 3 = 0"), frame, k=7, query_block=block, shard_rows=shard, tile=tile)
    assert sorted(tuple(r) for r in found.collect()) == plain_top(rows, 7)
    assert topk.top_k(frame.limit(0), frame.limit(0)).collect() == []
    narrow = frame.where("vec_id < 60").withColumn("embedding", frame["embedding"].cast("array<float>"))
    found = topk.top_k(narrow.where("vec_id % 3 = 0"), narrow, k=7, query_block=block, shard_rows=shard, tile=tile)
    assert sorted(tuple(r) for r in found.collect()) == plain_top([(r.vec_id, r.embedding) for r in narrow.collect()], 7)
