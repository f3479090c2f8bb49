"""Target-distribution importance resampling on hashed n-grams, whose CRCs come from running CRCs of whole documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, give_back, materialise, word_blocks

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
SEED = 42
BATCH_BYTES = 16 << 20
#: Words whose n-grams are derived at once.
BLOCK = 1 << 17
_POLY = 0xEDB88320
#: Lower-cases A-Z; every other byte under 0x80 but a-z and 0-9 becomes the separator.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def _byte_step() -> np.ndarray:
    """What one more zero byte makes of each of the 32 bits of a CRC register, by the shift register itself."""
    bits = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))
    for _ in range(8):
        bits = (bits >> np.uint32(1)) ^ np.where(bits & np.uint32(1), np.uint32(_POLY), np.uint32(0))
    return bits


def _tables(columns: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its values at the bits, as four tables of the values at each byte."""
    found = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            with_it = np.arange(256) >> bit & 1 == 1
            found[byte, with_it] ^= columns[8 * byte + bit]
    return found


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of shifts by 0 to 63 zero bytes, all in one, and by 64, 128, ... up to 2 ** 31 zero bytes."""
    bits = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))
    step = _tables(_byte_step())
    low, columns = [], bits
    for _ in range(64):
        low.append(_tables(columns))
        columns = _apply(step, columns)
    high = []
    for _ in range(6, 32):
        high.append(_tables(columns))
        columns = _apply(high[-1], columns)
    return np.stack(low), high


_LOW, _HIGH = _shifts()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRC-32 (uint32) of each text followed by ``n`` bytes, less what these bytes themselves add: a map linear over GF(2)."""
    low = n & 63
    out = _LOW[low, 0, crc & 255] ^ _LOW[low, 1, crc >> 8 & 255] ^ _LOW[low, 2, crc >> 16 & 255] ^ _LOW[low, 3, crc >> 24]
    rest = n >> 6
    k = 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _apply(_HIGH[k], out[odd])
        rest, k = rest >> 1, k + 1
    return out


_BLANK = np.uint32(zlib.crc32(b" "))


def running(text: str) -> tuple[bytes, bytes]:
    """One scan of a text, its words joined by single blanks: the CRC of what ends with each word, and the words' lengths.

    Both are little-endian unsigned 32-bit numbers, one a word. Words are runs of ASCII letters, digits and characters
    beyond ASCII; A-Z are lower-cased.
    """
    crcs, lengths, last = [], [], 0
    for words in word_blocks(text.encode().translate(_NORMAL)):
        lengths.append(np.fromiter(map(len, words), np.uint32, len(words)))
        if words:
            first = zlib.crc32(words[0], zlib.crc32(b" ", last) if crcs else 0)  # no blank before the very first word
            ends = accumulate(words[1:], lambda crc, word: zlib.crc32(word, zlib.crc32(b" ", crc)), initial=first)
            crcs.append(np.fromiter(ends, np.uint32, len(words)))
            last = int(crcs[-1][-1])
    return (b"".join(c.astype("<u4").tobytes() for c in crcs), b"".join(n.astype("<u4").tobytes() for n in lengths))


def gram_buckets(crcs: bytes, lengths: bytes, buckets: int = BUCKETS, longest: int = LONGEST, block: int = BLOCK) -> Iterator[np.ndarray]:
    """The bucket of every run of 1 to ``longest`` words, from the running CRCs of the text alone, some words at a time.

    With A what stands before an n-gram B, crc(AB) is crc(A) shifted by the bytes of B, plus crc(B) over GF(2); so the
    n-gram's CRC is that of the prefix that ends with it less the shifted CRC of the prefix before it.
    """
    ends, size = np.frombuffer(crcs, "<u4"), np.frombuffer(lengths, "<u4").astype(np.int64)
    for at in range(0, len(ends), block):
        end, own = ends[at : at + block + longest - 1], size[at : at + block + longest - 1]
        m = min(block, len(end))
        before = np.zeros(len(end), np.uint32)  # of the prefix up to the blank before each word
        before[1:] = shifted(end[:-1], np.ones(len(end) - 1, np.int64)) ^ _BLANK
        if at:
            before[0] = shifted(ends[at - 1 : at], np.ones(1, np.int64))[0] ^ _BLANK
        total = np.concatenate([[0], np.cumsum(own + 1)])
        for n in range(1, longest + 1):
            k = min(m, len(end) - n + 1)
            if k > 0:
                bytes_in = total[n : n + k] - total[:k] - 1
                yield ((end[n - 1 : n - 1 + k] ^ shifted(before[:k], bytes_in)) % np.uint32(buckets)).astype(np.int64)


def _scanned(buckets: int, longest: int):
    """Running CRCs of each text, and in a last row without them the counts of the buckets over the partition."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(buckets, np.int64), None
        names = ["id", "crcs", "lengths", "counts"]
        for batch in batches:
            kind, crcs, lengths = batch["id"].type, [], []
            for cell in batch["text"]:
                own = running(cell.as_py() or "")
                for found in gram_buckets(*own, buckets, longest):
                    counts += np.bincount(found, minlength=buckets)
                crcs.append(own[0])
                lengths.append(own[1])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(crcs, pa.binary()), pa.array(lengths, pa.binary()), pa.nulls(n, pa.list_(pa.int64()))], names)
            del batch, crcs, lengths
            give_back()
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([counts], pa.list_(pa.int64()))], names)

    return each


def scan(texts: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[DataFrame, np.ndarray]:
    """Running CRCs of every text, written (id, crcs, lengths), and how many n-grams fall in each bucket.

    Each text is scanned once. Counts are added up within a partition, then by Spark: no more than ``buckets`` numbers
    come back.
    """
    slim = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema[id_col].dataType.simpleString()
    with arrow_batches(texts.sparkSession, BATCH_BYTES):
        found = materialise(slim.mapInArrow(_scanned(buckets, longest), f"id {kind}, crcs binary, lengths binary, counts array<long>"))
    parts = found.where(F.col("counts").isNotNull()).select(F.posexplode("counts").alias("bucket", "n")).where("n > 0")
    counts = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return found.where(F.col("counts").isNull()).drop("counts"), counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log ratio of each bucket's smoothed share in the target to that in the raw texts, in thousandths rounded down."""
    k, raw, target = float(len(raw)), raw.astype(float), target.astype(float)
    ratio = (target + 1.0) * (raw.sum() + k) / ((raw + 1.0) * (target.sum() + k))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def _weighed(gain: np.ndarray, longest: int):
    """Features and summed gains of each document, from its running CRCs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = [], [], []
            for crcs, lengths in zip(batch["crcs"], batch["lengths"], strict=True):
                own = (crcs.as_py(), lengths.as_py())
                found = [(len(x), int(gain[x].sum())) for x in gram_buckets(*own, len(gain), longest)]
                words.append(len(own[0]) // 4)
                features.append(sum(n for n, _ in found))
                weight.append(sum(w for _, w in found))
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(x, pa.int64()) for x in (words, features, weight))], ["id", "n_words", "n_features", "weight"])
            del batch
            give_back()

    return each


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted partition with its number and, for those in the draw, their place in it."""
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        inside = batch["drawable"].to_numpy(zero_copy_only=False).astype(np.int64)
        place = n + np.cumsum(inside)
        n = int(place[-1]) if len(place) else n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(place), part), pa.int64()), pa.array(place, pa.int64())], [*batch.schema.names, "part", "place"])


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: int = 5,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_features``, ``weight``, ``score`` and ``rank``.

    Features are all runs of 1 to ``longest`` words. A document's weight is the sum of its features' gains, log ratios of
    their buckets' shares in ``target`` and in ``docs``. The score adds a Gumbel draw, by a hash of seed and id, so that the highest
    scores are a sample without replacement in proportion to the exponentials of the weights. Of the documents with at
    least ``least_words`` words, ``percent`` in a hundred, rounded down, are drawn, and get ranks from 1 on.

    The texts are scanned once, into running CRCs; counts and weights come from these. Ranks come from a sort by ranges of
    the score, the id and a row number, so that no tie, however large, is one task; only counts by range reach one place.

    Null texts have no words; a null id draws by the hash of the seed alone and loses ties. Rows that repeat an id
    each get their row and may each be drawn. Very long texts are whole, in memory in proportion to their words. An empty
    table gives an empty result, an empty target zero counts; extra columns are ignored.
    """
    raw, own = scan(docs, id_col, text_col, buckets, longest)
    _, wanted = scan(target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text")), "id", "text", buckets, longest)
    kind = docs.schema[id_col].dataType.simpleString()
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        weighed = raw.mapInArrow(_weighed(gains(own, wanted), longest), f"id {kind}, n_words long, n_features long, weight long")
        digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
        h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
        gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
        scored = materialise(
            weighed.select(
                "id", "n_features", "weight", (F.col("weight") + gumbel).alias("score"), (F.col("n_words") >= least_words).alias("drawable"), F.monotonically_increasing_id().alias("row")
            )
        )
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    by_range = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    shape = f"id {kind}, n_features long, weight long, score long, drawable boolean, row long, part long, place long"
    ranked = materialise(by_range.mapInArrow(_numbered, shape))
    counts = ranked.groupBy("part").agg(F.max("place").alias("n"))  # one row per range
    whole = Window.partitionBy(F.lit(1))
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(whole).alias("all"))
    rank = F.col("before") + F.col("place")
    drawn = F.col("drawable") & (rank <= F.floor(F.lit(percent) * F.col("all") / 100))
    return ranked.join(F.broadcast(counts), "part").select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(drawn, rank).alias("rank"))


#: CRC-32 in SQL: what a byte with k bytes after it adds (steps of 8 (k + 1) zero bits), and what is left of the first register.
CRC_STEPS = """
steps(b, k, c) AS (
  SELECT b, 0, b FROM range(256) t(b) UNION ALL SELECT -1, 0, 4294967295
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8 * (SELECT most FROM longest)),
adds AS (SELECT printf('%02X', b) AS byte, k // 8 - 1 AS after, c FROM steps WHERE b >= 0 AND k > 0 AND k % 8 = 0),
starts AS (SELECT k // 8 AS size, c FROM steps WHERE b = -1 AND k % 8 = 0)
"""
ORACLE = (
    """
WITH RECURSIVE texts AS (
  SELECT false AS wanted, doc_id AS id, text FROM documents UNION ALL SELECT true, item_id, text FROM benchmark),
words AS (
  SELECT wanted, id, row_number() OVER () AS row, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
grams AS MATERIALIZED (
  SELECT wanted, row, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT wanted, row, w, unnest(range(1, len(w) + 1)) AS i FROM words), (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w)),
single AS MATERIALIZED (SELECT DISTINCT gram, hex(encode(gram)) AS bytes, octet_length(encode(gram)) AS size FROM grams),
longest AS MATERIALIZED (SELECT coalesce(max(size), 0) AS most FROM single),
"""
    + CRC_STEPS
    + """,
crcs AS (
  SELECT gram, xor(4294967295, xor(any_value(s.c), bit_xor(a.c))) % 10000 AS bucket
  FROM (SELECT gram, size, bytes, unnest(range(size)) AS i FROM single) g
  JOIN adds a ON a.byte = substr(g.bytes, 2 * g.i + 1, 2) AND a.after = g.size - 1 - g.i JOIN starts s ON s.size = g.size GROUP BY gram),
features AS MATERIALIZED (SELECT wanted, row, bucket, count(*) AS n FROM grams JOIN crcs USING (gram) GROUP BY ALL),
counts AS (
  SELECT b AS bucket, coalesce(sum(n) FILTER (NOT wanted), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (wanted), 0)::DOUBLE AS t
  FROM range(10000) r(b) LEFT JOIN features ON bucket = b GROUP BY b),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS gain FROM counts),
weights AS (SELECT row, sum(n * gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE NOT wanted GROUP BY row),
scored AS (
  SELECT id AS doc_id, row, len(w) AS n_words, (greatest(len(w), 0) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (row) WHERE NOT wanted),
drawn AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (row)
"""
)
