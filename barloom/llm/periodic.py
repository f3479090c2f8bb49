"""Periodic runs of words: blocks of dyadic lengths are located in the windows after them by exact number theoretic transforms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORD, arrow_batches, give_back, materialise, word_blocks
from .resample import CRC_STEPS

LEAST = 12
#: A prime with roots of unity of every order up to 2 ** 27; products of two residues fit 64 bits.
PRIME, ROOT = 15 * (1 << 27) + 1, 31
SMALLEST = 4
#: Blocks longer than this are looked up by their first so many words.
LONGEST = 1 << 14
#: Words of several texts that are searched together, and cells of one transform.
TOGETHER, CELLS = 1 << 18, 1 << 19
BATCH_BYTES = 16 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"
_ROOTS: dict[int, np.ndarray] = {}


def _powers(n: int) -> np.ndarray:
    """The first n / 2 powers of a primitive n-th root of unity."""
    found = _ROOTS.get(n)
    if found is None:
        root, found = pow(ROOT, (PRIME - 1) // n, PRIME), np.ones(1, np.uint64)
        while len(found) < n // 2:  # doubles the powers known
            found = np.concatenate([found, found * np.uint64(pow(root, len(found), PRIME)) % np.uint64(PRIME)])
        _ROOTS[n] = found
    return found


def transform(rows: np.ndarray) -> np.ndarray:
    """The number theoretic transform of each row, whose length is a power of two (decimation in frequency, in order of digits)."""
    k, n = rows.shape
    p = np.uint64(PRIME)
    x, blocks = rows.reshape(k, 1, n), 1
    while n > 1:
        half = n // 2
        a, b = x[:, :, :half], x[:, :, half:]
        both = np.stack([(a + b) % p, (a + p - b) % p * _powers(n) % p], axis=2)
        blocks, n = 2 * blocks, half
        x = both.reshape(k, blocks, n)
    return x.reshape(k, -1)


def back(rows: np.ndarray) -> np.ndarray:
    """The inverse of ``transform``: takes its order of digits, gives the plain order."""
    k, size = rows.shape
    p, n = np.uint64(PRIME), 1
    x = rows.reshape(k, size, 1)
    while n < size:
        pair = x.reshape(k, size // (2 * n), 2, n)
        inverse = _powers(2 * n).copy()
        inverse[1:] = p - inverse[1:][::-1]  # the inverse of root ** i is -root ** (n - i)
        a, b = pair[:, :, 0], pair[:, :, 1] * inverse % p
        x = np.concatenate([(a + b) % p, (a + p - b) % p], axis=2)
        n *= 2
    return x.reshape(k, size) * np.uint64(pow(size, PRIME - 2, PRIME)) % p


def mismatches(block: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Per row, the sum of squared differences of the block and each stretch of the window, modulo ``PRIME``.

    The sum over t of (b[t] - w[j + t])² is the squares of the block, and of the stretch by a running sum, less twice their
    correlation, which is a product of transforms. It is 0 where all words agree.
    """
    p, (k, b), width = np.uint64(PRIME), block.shape, window.shape[1]
    size = 1 << (width - 1).bit_length()
    left, right = np.zeros((k, size), np.uint64), np.zeros((k, size), np.uint64)
    left[:, 0], left[:, size - b + 1 :] = block[:, 0], block[:, :0:-1]  # reversed in a circle
    right[:, :width] = window
    lags = width - b + 1
    cross = back(transform(left) * transform(right) % p)[:, :lags]
    squares = np.zeros((k, width + 1), np.uint64)
    np.cumsum(window * window % p, axis=1, out=squares[:, 1:])
    own = (block * block % p).sum(axis=1, dtype=np.uint64) % p
    stretch = (squares[:, b:] - squares[:, :-b]) % p
    return (own[:, None] + stretch + p + p - cross - cross) % p


def _next_same(w: np.ndarray) -> np.ndarray:
    """The distance from each word to the next one that equals it, or a distance beyond all words."""
    order = np.argsort(w, kind="stable")
    found = np.full(len(w), len(w) + 1, np.int64)
    same = w[order[:-1]] == w[order[1:]]
    found[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return found


def _occurrences(w: np.ndarray, at: np.ndarray, b: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the ``b`` words from each place of ``at`` stand again, ``low`` to ``high`` words on: places and distances.

    ``w`` has values below ``PRIME``; words past the end count as the value before none. Windows are taken in pieces of
    bounded width, and blocks some at a time, so that memory is bounded at every scale.
    """
    n, places, distances = len(w), [], []
    step = min(high - low + 1, 3 * b)
    rows = max(1, CELLS // (1 << (step + b - 2).bit_length()))
    inside, words = np.arange(b), w.astype(np.uint64)
    for first in range(low, high + 1, step):
        lags = min(step, high + 1 - first)
        ahead = np.arange(lags + b - 1)
        for i in range(0, len(at), rows):
            x = at[i : i + rows]
            x = x[x + first + b <= n]
            if not len(x):
                continue
            place = x[:, None] + first + ahead
            window = np.where(place < n, words[np.minimum(place, n - 1)], np.uint64(PRIME - 1))
            row, lag = np.nonzero(mismatches(words[x[:, None] + inside], window) == 0)
            places.append(x[row])
            distances.append(lag + first)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(distances)


def _reach(w: np.ndarray, x: int, q: int) -> int:
    """How many words from ``x`` on equal those ``q`` words later."""
    n, at, size = len(w) - q, x, 32
    while at < n:
        end = min(n, at + size)
        differ = w[at:end] != w[at + q : end + q]
        k = int(differ.argmax())
        if differ[k]:
            return at + k - x
        at, size = end, 2 * size
    return n - x


def _factors(q: int) -> list[int]:
    found, f = [], 2
    while f * f <= q:
        if q % f == 0:
            found.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return [*found, q] if q > 1 else found


def _primitive(w: np.ndarray, s: int, q: int) -> bool:
    """Whether a stretch of at least 2q words from ``s`` with period q has no smaller one: such would divide q."""
    return not any(np.array_equal(w[s : s + q - q // f], w[s + q // f : s + q]) for f in _factors(q))


def runs_of(w: np.ndarray, longest: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of the numbers ``w`` whose length is at least ``least`` and twice the smallest period.

    ``longest`` bounds the distance of equal numbers. A run of period q holds a stretch of at least max(least - q, q) words
    that stand again q words later, and so, at the scale of blocks of b words (1.5 b - 1 <= q <= 3 b - 2, from 4 words on), all of a
    block that starts at a multiple of b / 2. Each block is looked up in the window at these distances; a hit is a seed,
    which is extended both ways. Two exact tests keep the work near to linear: a block holding a word that does not come
    again within the window cannot; and a block whose window lies in a known run with a period of at most b needs no look-up,
    because another run there would share more than the sum of the two periods with it, which no two runs do.
    """
    if least < 10:
        raise ValueError("runs of fewer than 10 words are not found by blocks of 4 words")
    n, found = len(w), []
    again, reverse = _next_same(w) if n else np.zeros(0, np.int64), w[::-1]
    known, period = np.zeros(n + 1, np.int64), np.ones(n + 1, np.int64)  # where the run ends that covers a place, and its period
    b = SMALLEST
    while b + (low := 1 if b == SMALLEST else 3 * b // 2 - 1) <= min(n, longest) and low <= longest // 2:
        high, size = min(3 * b - 2, longest // 2), min(b, LONGEST)
        at = np.arange(0, n - size - low + 1, b // 2)
        lone = np.concatenate([[0], np.cumsum(again > high)])
        at = at[lone[at + size] == lone[at]]
        at = at[~((known[at] >= np.minimum(at + high + b, n)) & (period[at] <= b))]
        places, distances = _occurrences(w, at, size, low, high)
        repeats = (distances % period[places] == 0) & (distances >= period[places]) & (places + distances + size <= known[places])
        places, distances = places[~repeats], distances[~repeats]
        order = np.lexsort((places, distances))
        last, done = 0, -1
        for x, q in zip(places[order].tolist(), distances[order].tolist(), strict=True):
            if q == last and x < done:
                continue
            ahead = _reach(w, x, q)
            if ahead < size:  # a zero of the prime that is no match
                continue
            # backwards, the words before x + q against those before x
            behind = _reach(reverse, n - x - q, q)
            start, last, done = x - behind, q, x + ahead
            length = done - start + q
            if length >= max(least, 2 * q) and _primitive(w, start, q):
                found.append((start, length, q))
                better = known[start : start + length] < start + length
                known[start : start + length][better] = start + length
                period[start : start + length][better] = q
        b *= 2
    return sorted(found)


def _numbered(data: bytes, base: int) -> tuple[np.ndarray, int]:
    """The words of a text as numbers from ``base`` on, equal for equal words, and the next free number."""
    ids: dict[bytes, int] = {}
    parts = [np.fromiter((ids.setdefault(x, base + len(ids)) for x in part), np.int64, len(part)) for part in word_blocks(data)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), base + len(ids)


def _collapsed(data: bytes, keep: np.ndarray) -> str:
    parts, at = [], 0
    for words in word_blocks(data):
        own = keep[at : at + len(words)]
        at += len(words)
        parts += words if own.all() else [x for x, k in zip(words, own.tolist(), strict=True) if k]
    return b" ".join(parts).decode()


def search(texts: Sequence[str | None], least: int = LEAST) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """For each text: its number of words, its runs, and its words without what repeats, joined by one space.

    Short texts are numbered apart from each other and searched as one sequence, in which nothing can cross a border.
    """
    group: list[tuple[bytes, np.ndarray]] = []
    total = free = 0

    def flush() -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
        if not group:
            return
        starts = np.cumsum([0, *(len(w) for _, w in group)])
        found = runs_of(np.concatenate([w for _, w in group]), max(len(w) for _, w in group), least)
        own: list[list[tuple[int, int, int]]] = [[] for _ in group]
        for i, (start, length, period) in zip(np.searchsorted(starts, [r[0] for r in found], side="right").tolist(), found, strict=True):
            own[i - 1].append((start - int(starts[i - 1]), length, period))
        for (data, w), runs in zip(group, own, strict=True):
            keep = np.ones(len(w), bool)
            for start, length, period in runs:
                keep[start + period : start + length] = False
            yield len(w), runs, _collapsed(data, keep)

    for text in texts:
        data = (text or "").encode()
        w, free = _numbered(data, free)
        if group and total + len(w) > TOGETHER:
            yield from flush()
            group, total = [], 0
            w, free = _numbered(data, 0)
        group.append((data, w))
        total += len(w)
    yield from flush()


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words stand between ASCII blanks. A run is a stretch of words with smallest period q, of at least ``least`` and 2q
    words, that no neighbouring word extends. ``collapsed`` leaves out what any run holds after its first q words. Texts
    are searched whole, each in one task; no row is shuffled. A null text has no words, as an empty one; rows that repeat
    an id, or have none, each get their row; a very long text takes memory in proportion to its words; an empty table
    gives an empty result; extra columns are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, runs, rest = [], [], []
            for words, own, collapsed in search([cell.as_py() for cell in batch["text"]], least):
                n.append(words)
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in own])
                rest.append(collapsed)
            run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            columns = [batch["id"], pa.array(n, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])
            del batch, columns, rest
            give_back()

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(each, f"id {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text of ``docs``, where for about a tenth of the ids the words from some place on are repeated up to the end.

    With h the CRC-32 of the id's digits and g = h div 10: of a text of n > 0 words with h mod 10 = 0, word i >= a becomes
    word a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8). A null id plants nothing.
    """
    h = F.crc32(F.col("id").cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    words = F.regexp_extract_all("text", F.lit(f"({SPACE_WORD})"), F.lit(1))
    chosen = rows.withColumn("words", F.when(h % 10 == 0, words)).withColumns({"n": F.size("words"), "g": F.floor(h / 10)})
    a = F.when(F.col("n") > 0, F.pmod("g", F.col("n"))).cast("int")
    chosen = chosen.withColumn("a", a)
    chosen = chosen.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod("g", F.lit(8))))).cast("int"))
    copies = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    repeated = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(copies, F.lit(1), F.col("n") - F.col("a")))
    text = F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text"))
    return chosen.select(F.col("id").alias(id_col), text.alias(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of ``find_runs``: the number of runs, the longest (ties: smallest start, then period), and hashes of runs and rest."""
    runs: Column = F.col("runs")
    ranked = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", ranked)
    length, period = -F.col("best.a"), F.col("best.period")
    return best.select(
        id_col,
        F.size(runs).cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted_runs(docs: DataFrame) -> DataFrame:
    """The digests of the runs of ``docs`` after ``planted``, written in batches of texts that bound a worker's memory."""
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return materialise(digests(find_runs(planted(docs))))


#: Runs in SQL: pairs of equal stretches of four words of a document, joined to islands by distance; one with a smaller period goes.
ORACLE = (
    """
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS digits FROM documents), longest AS (SELECT coalesce(max(length(digits)), 0) AS most FROM ids),
"""
    + CRC_STEPS
    + """,
crcs AS (
  SELECT doc_id, xor(4294967295, xor(any_value(s.c), bit_xor(a.c))) AS h
  FROM (SELECT doc_id, digits, unnest(range(length(digits))) AS i FROM ids) g
  JOIN adds a ON a.byte = hex(substr(digits, i + 1, 1)) AND a.after = length(digits) - 1 - i JOIN starts s ON s.size = length(digits) GROUP BY doc_id),
given AS (
  SELECT doc_id, h, w, len(w) AS n, CASE WHEN len(w) > 0 AND h % 10 = 0 THEN (h // 10) % len(w) ELSE len(w) END AS a
  FROM (SELECT doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents LEFT JOIN crcs USING (doc_id))),
docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, n,
    CASE WHEN a < n THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w
  FROM given),
words AS MATERIALIZED (SELECT row, unnest(range(n)) AS i, unnest(w) AS word FROM docs),
four AS MATERIALIZED (
  SELECT row, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o AS gram
  FROM words WINDOW o AS (PARTITION BY row ORDER BY i)),
islands AS (
  SELECT row, q, min(i) AS start, max(i) + 4 + q AS stop
  FROM (SELECT x.row, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.row, y.i - x.i ORDER BY x.i) AS island
        FROM four x JOIN four y ON x.row = y.row AND x.gram = y.gram AND x.i < y.i)
  GROUP BY row, q, island),
whole AS MATERIALIZED (SELECT * FROM islands WHERE stop - start >= greatest(12, 2 * q)),
runs AS MATERIALIZED (
  SELECT row, start, stop - start AS length, q AS period FROM whole x
  WHERE NOT EXISTS (FROM whole y WHERE y.row = x.row AND y.q < x.q AND x.q % y.q = 0 AND y.start <= x.start AND y.stop >= x.stop)),
best AS (
  SELECT row, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, p := period), struct_pack(l := -length, s := start, p := period)) AS b,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY row),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
rest AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, floor(1000 * b.l / b.p)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (row) LEFT JOIN rest USING (row)
"""
)
