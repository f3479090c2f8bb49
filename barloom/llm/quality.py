"""Quality scores by a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, few, give_back, held_out, materialise, word_blocks

#: The statistics of a document, in the order of ``statistics``.
NAMES = (
    "log_bytes", "log_words", "log_lines", "log_word_length", "log_line_words",
    "upper", "digits", "stops", "marks", "symbols", "beyond_ascii", "blanks",
    "distinct_words", "top_word", "single_words", "same_as_before", "distinct_pairs", "same_lines",
    "short_words", "long_words", "no_letter", "marked_ends", "capital_starts", "entropy",
)
BATCH_BYTES = 16 << 20
#: Shrinkage towards the pooled covariance, and of all towards the identity, that the validation chooses from.
POOLED = (0.0, 0.1, 0.3, 0.6, 1.0)
ROUND = (0.01, 0.05, 0.2, 0.5)


def _bytes_in(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


UPPER, LOWER, DIGITS = (_bytes_in(bytes(range(a, b + 1))) for a, b in ((65, 90), (97, 122), (48, 57)))
STOPS, MARKS, BLANKS = _bytes_in(b".,;:?'\"()-"), _bytes_in(b"!"), _bytes_in(b" \t\n\v\f\r")
BEYOND = _bytes_in(bytes(range(128, 256)))
SYMBOLS = ~(UPPER | LOWER | DIGITS | STOPS | MARKS | BLANKS | BEYOND)
_END_MARKS = frozenset(b"!#$%&*+/<=>@\\^_`{|}~")
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_CAPITALS = frozenset(range(65, 91))


def _share(part: float, whole: float) -> float:
    """The arcsine of the root of a share, whose spread depends little on the share itself."""
    return float(np.arcsin(np.sqrt(min(1.0, part / whole)))) if whole else 0.0


def statistics(text: str | None, block: int = 1 << 20) -> list[float]:
    """The transformed statistics of a whole text, null as empty: logarithms of sizes, arcsines of shares.

    Bytes are counted and words are made block by block; what is kept of a long text are its distinct words, pairs and lines.
    """
    data = (text or "").encode()
    count = np.zeros(256, np.int64)
    for at in range(0, len(data), block):
        count += np.bincount(np.frombuffer(data, np.uint8, min(block, len(data) - at), at), minlength=256)
    words: Counter[bytes] = Counter()
    pairs: set[int] = set()
    n = short = long = bare = marked = capital = repeats = 0
    last: list[bytes] = []
    for part in word_blocks(data, block):
        words.update(part)
        before = [*last, *part]
        pairs.update(map(hash, zip(before, before[1:], strict=False)))
        repeats += sum(map(eq, before, before[1:]))
        last = before[-1:]
    for w, c in words.items():
        size = len(w)
        n += c
        if size <= 3:
            short += c
        elif size > 24:
            long += c
        if w[-1] in _END_MARKS:
            marked += c
        if w[0] in _CAPITALS:
            capital += c
        if _LETTER.search(w) is None:
            bare += c
    lines: Counter[int] = Counter(hash(line) for line in data.split(b"\n") if line.strip())
    n_lines = sum(lines.values())
    solid = int(count[~BLANKS].sum())
    letters = int(count[UPPER].sum() + count[LOWER].sum())
    share = count[count > 0] / max(1, len(data))
    return [
        float(np.log1p(len(data))),
        float(np.log1p(n)),
        float(np.log1p(n_lines)),
        float(np.log1p(solid / n)) if n else 0.0,
        float(np.log1p(n / n_lines)) if n_lines else 0.0,
        _share(count[UPPER].sum(), letters),
        *(_share(count[kind].sum(), solid) for kind in (DIGITS, STOPS, MARKS, SYMBOLS, BEYOND)),
        _share(count[BLANKS].sum(), len(data)),
        _share(len(words), n),
        _share(max(words.values(), default=0), n),
        _share(sum(c == 1 for c in words.values()), n),
        _share(repeats, n),
        _share(len(pairs), n),
        _share(n_lines - len(lines), n_lines),
        *(_share(k, n) for k in (short, long, bare, marked, capital)),
        float(-(share * np.log(share)).sum()) if len(data) else 0.0,
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(cell.as_py()) for cell in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["held_out"], pa.array(found, pa.list_(pa.float64()))], ["id", "held_out", "x"])
        del batch, found
        give_back()


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``held_out`` and the statistics ``x`` of every document, written: texts are read once."""
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return materialise(slim.mapInArrow(_measured, f"id {kind}, held_out boolean, x array<double>"))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(NAMES))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition, by label and part: the sums of (1, x) times (1, x)."""
    d = len(NAMES) + 1
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        x = np.hstack([np.ones((batch.num_rows, 1)), _rows(batch)])
        key = np.column_stack([batch["label"].to_numpy(zero_copy_only=False), batch["part"].to_numpy(zero_copy_only=False)])
        for label, part in np.unique(key, axis=0).tolist():
            own = x[(key == (label, part)).all(axis=1)]
            sums[label, part] = sums.get((label, part), 0.0) + own.T @ own
    for (label, part), total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([v] * (d * d), pa.int32()) for v in (label, part)] + [pa.array(np.arange(d * d), pa.int32()), pa.array(total.ravel(), pa.float64())],
            ["label", "part", "at", "total"],
        )


class Discriminant:
    """Two Gaussian densities over standardised statistics; of each, the inverse of its Cholesky factor is kept."""

    def __init__(self, shift: np.ndarray, scale: np.ndarray, means: Sequence[np.ndarray], covariances: Sequence[np.ndarray], prior: float):
        self.shift, self.scale, self.means = shift, scale, means
        factors = [np.linalg.cholesky(c) for c in covariances]
        self.inverse = [np.linalg.inv(f) for f in factors]
        self.log_root = [float(np.log(np.diag(f)).sum()) for f in factors]
        self.odds = float(np.log(prior / (1.0 - prior)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 of each row: the difference of the log densities, and of the priors, as a logistic curve."""
        z = (x - self.shift) / self.scale
        density = []
        for mean, inverse, root in zip(self.means, self.inverse, self.log_root, strict=True):
            away = (z - mean) @ inverse.T
            density.append(-0.5 * np.einsum("ij,ij->i", away, away) - root)
        return 1.0 / (1.0 + np.exp(-np.clip(density[1] - density[0] + self.odds, -40.0, 40.0)))


def fit(moments: dict[int, np.ndarray], pooled: float, round_: float) -> Discriminant:
    """The discriminant of the sums of (1, x)(1, x)' of each label.

    A class covariance goes by ``pooled`` towards that of both classes, then by ``round_`` towards the identity, in units of
    the standard deviations of all rows.
    """
    n = {k: m[0, 0] for k, m in moments.items()}
    both = moments[0] + moments[1]
    shift = both[0, 1:] / both[0, 0]
    spread = np.diag(both)[1:] / both[0, 0] - shift**2
    scale = np.where(spread > 1e-9, np.sqrt(np.maximum(spread, 1e-9)), 1.0)
    means, own = [], []
    for k in (0, 1):
        mean = moments[k][0, 1:] / n[k]
        own.append((moments[k][1:, 1:] / n[k] - np.outer(mean, mean)) / np.outer(scale, scale))
        means.append((mean - shift) / scale)
    shared = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
    shrunk = [(1 - round_) * ((1 - pooled) * c + pooled * shared) + round_ * np.eye(len(shift)) for c in own]
    return Discriminant(shift, scale, means, shrunk, n[1] / (n[0] + n[1]))


def _losses(models: list[Discriminant]):
    """Of one partition, the summed log loss of each model."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(models))
        for batch in batches:
            y, x = batch["label"].to_numpy(zero_copy_only=False) == 1, _rows(batch)
            for i, model in enumerate(models):
                s = model.score(x)
                total[i] -= np.log(np.clip(np.where(y, s, 1.0 - s), 1e-6, 1.0)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models)), pa.int32()), pa.array(total)], ["model", "loss"])

    return each


def train(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", parts: int = 5) -> Discriminant | float:
    """A discriminant learnt from all labelled rows that are not held out; the share of label 1 if there is one class only.

    Means and covariances come from sums of products that Spark adds up over every labelled row, without a sample. The two
    shrinkages are those of least log loss on one of ``parts`` parts, drawn by a hash of the id, by models of the other parts
    (if both hold both classes; else they are in the middle of the grid); the model is then that of all parts.
    """
    known = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1))
    known = materialise(known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("label")))
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(parts)).cast("int").alias("part")
    rows = materialise(measured.join(few(known), "id").select("label", part, "x"))
    sums = rows.mapInArrow(_moments, "label int, part int, at int, total double").groupBy("label", "part", "at").agg(F.sum("total").alias("total"))
    d = len(NAMES) + 1
    moments = {(k, p): np.zeros(d * d) for k in (0, 1) for p in range(parts)}
    for r in sums.collect():  # two classes by five parts by the square of the number of statistics
        moments[r["label"], r["part"]][r["at"]] = r["total"]

    def of(wanted) -> dict[int, np.ndarray]:
        return {k: sum(moments[k, p] for p in wanted).reshape(d, d) for k in (0, 1)}

    whole, most, last = of(range(parts)), of(range(1, parts)), of([0])
    n = [whole[k][0, 0] for k in (0, 1)]
    if not all(n):
        return n[1] / sum(n) if sum(n) else 0.5
    grid = [(a, b) for a in POOLED for b in ROUND]
    best = grid[len(grid) // 2]
    if all(m[k][0, 0] for m in (most, last) for k in (0, 1)):
        models = [fit(most, *g) for g in grid]
        loss = rows.where("part = 0").mapInArrow(_losses(models), "model int, loss double").groupBy("model").agg(F.sum("loss").alias("loss"))
        best = grid[min(loss.collect(), key=lambda r: (r["loss"], r["model"]))["model"]]
    return fit(whole, *best)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` in [0, 1] and ``predicted`` (1 from ``least`` on).

    Scores depend on the statistics of the whole text only. Null texts score as empty ones. Of labels that repeat an id the
    largest counts; null labels and ids, and labels other than 0 and 1, are not learnt from; with labels of one class only
    every score is that class, without any it is 0.5. Null ids count as not held out. Rows that repeat an id each get their
    row, and are each learnt from; very long texts are measured whole; an empty table gives an empty result; extra columns
    are ignored.
    """
    measured = measure(docs, id_col, text_col)
    model = train(measured, labels, id_col, label_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_rows(batch)) if isinstance(model, Discriminant) else np.full(batch.num_rows, model)
            columns = [batch["id"], batch["held_out"], pa.array(score, pa.float64()), pa.array(score >= least).cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return measured.mapInArrow(each, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
