"""Toxicity scores by a logistic classifier that is regularised with counterfactual identity terms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, held_out, materialise

#: Groups of identity terms; a term is swapped for the next one of its group.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives"),
    ("black", "white", "asian", "latino", "arab"),
    ("mujeres", "hombres"),
    ("femmes", "hommes"),
    ("frauen", "männer"),
)
WORD = regex.compile(r"[\p{L}\p{N}]+")
PREFIXES = (4, 5, 6)
WORD_CACHE = 300_000


def word_features(word: str) -> list[str]:
    """A word itself, and its beginnings of 4 to 6 characters where it is longer."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def _swaps(groups: Sequence[Sequence[str]]) -> dict[str, str]:
    return {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}


def selected_features(rows: DataFrame, most: int, always: Sequence[str], least: float) -> list[str]:
    """The ``most`` features of ``rows`` (tokens, toxic) that tell the labels apart best, by a chi-square of at least ``least``.

    Counts of documents are aggregated by Spark over the whole sample; only the selected features come back.
    """
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, t = float(totals["n"]), float(totals["t"] or 0)
    if not 0 < t < n:
        return []
    counts = rows.select(F.explode("tokens").alias("token"), "toxic").groupBy("token").agg(
        F.count(F.lit(1)).alias("c"), F.sum("toxic").alias("a")
    )
    c, a = F.col("c").cast("double"), F.col("a").cast("double")
    gap = a * n - c * t
    chi = gap * gap / (c * (n - c + 0.5) * (t * (n - t) / n))
    best = counts.where((F.col("c") >= 3) & (chi >= least)).orderBy(chi.desc(), "token").limit(most).select("token").collect()
    return sorted({r["token"] for r in best} | set(always))


class Classifier:
    """Weights by feature, bounded by the number of selected features."""

    def __init__(self, place: dict[str, int], weights: np.ndarray, bias: float):
        self.place, self.weights, self.bias = place, weights, bias
        self.cache: dict[str, tuple[int, ...]] = {}

    def _places(self, word: str) -> tuple[int, ...]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= WORD_CACHE:
                self.cache = {}
            found = tuple(self.place[f] for f in word_features(word) if f in self.place)
            self.cache[word] = found
        return found

    def score(self, text: str) -> float:
        on: set[int] = set()
        for word in set(WORD.findall(text.lower())):
            on.update(self._places(word))
        margin = self.bias + float(self.weights[sorted(on)].sum()) if on else self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -40.0, 40.0))))


def _tokens(swap: dict[str, str]):
    """Distinct features of each text, and of its counterfactual (null if it names no identity term)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = [], []
            for text in batch["text"].to_pylist():
                words = set(WORD.findall((text or "").lower()))
                own.append(sorted({f for w in words for f in word_features(w)}))
                swapped = {swap.get(w, w) for w in words}
                other.append(None if swapped == words else sorted({f for w in swapped for f in word_features(w)}))
            yield pa.RecordBatch.from_arrays(
                [batch["toxic"], pa.array(own, pa.list_(pa.string())), pa.array(other, pa.list_(pa.string()))],
                ["toxic", "tokens", "swapped"],
            )

    return each


def _indexed(place: dict[str, int]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def at(tokens):
            return None if tokens is None else [place[t] for t in tokens if t in place]

        for batch in batches:
            own = [at(t) for t in batch["tokens"].to_pylist()]
            other = [at(t) for t in batch["swapped"].to_pylist()]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(own, kind), pa.array(other, kind)], ["toxic", "own", "other"])

    return each


def _gradient(weights: np.ndarray, bias: float, penalty: float):
    """Sums of the gradient of one partition: of the log loss, and of the squared change of score under swaps."""

    def sums(values: pa.Array, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = values.flatten().to_numpy(zero_copy_only=False)
        n = np.diff(values.offsets.to_numpy())
        row = np.repeat(np.arange(len(n)), n)
        return np.bincount(row, w[at], len(n)) if len(at) else np.zeros(len(n)), at, row

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grad, rows = np.zeros(len(weights) + 1), 0
        for batch in batches:
            y = batch["toxic"].to_numpy(zero_copy_only=False).astype(float)
            own = pa.array(batch["own"].to_pylist(), pa.list_(pa.int32()))
            margin, at, row = sums(own, weights)
            error = 1.0 / (1.0 + np.exp(-np.clip(margin + bias, -40, 40))) - y
            np.add.at(grad, at, error[row])
            grad[-1] += error.sum()
            rows += len(y)
            both = np.flatnonzero(batch["other"].is_valid().to_numpy(zero_copy_only=False))
            if len(both):
                other = pa.array(batch["other"].take(pa.array(both)).to_pylist(), pa.list_(pa.int32()))
                swapped, at2, row2 = sums(other, weights)
                change = np.zeros(len(y))
                change[both] = margin[both] - swapped
                np.add.at(grad, at, 2 * penalty * change[row])
                np.add.at(grad, at2, -2 * penalty * change[both][row2])
        yield pa.RecordBatch.from_arrays([pa.array([grad.tolist()], pa.list_(pa.float64())), pa.array([rows], pa.int64())], ["grad", "n"])

    return each


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = 20_000,
    n_features: int = 4096,
    least_chi: float = 20.0,
    penalty: float = 1.0,
    decay: float = 1e-4,
    iterations: int = 60,
    identity: Sequence[Sequence[str]] = IDENTITY,
) -> Classifier | None:
    """A classifier learnt from the labelled documents that are not held out; None if there is nothing to learn.

    At most about ``sample_rows`` labelled documents, drawn by a hash of the id, are the bounded training sample.
    Each step sums gradients over the partitions of the sample: those of the log loss, and of ``penalty`` times the
    squared change of the score when the identity terms of a labelled text are swapped within their groups. Features
    whose chi-square is under ``least_chi`` are as likely chance, among so many, and are left out.
    """
    known = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("toxic"))
    n = known.count()
    if not n:
        return None
    known = materialise(known.where(drawn(F.col("id"), sample_rows / n)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # the sample is bounded by a parameter, so it may be sent to where the documents are
    labelled = texts.join(F.broadcast(known), "id").select("toxic", "text")
    swap = _swaps(identity)
    rows = materialise(labelled.mapInArrow(_tokens(swap), "toxic int, tokens array<string>, swapped array<string>"))
    names = selected_features(rows, n_features, sorted(swap), least_chi)
    if not names:
        return None
    place = {name: i for i, name in enumerate(names)}
    data = rows.mapInArrow(_indexed(place), "toxic int, own array<int>, other array<int>")
    data = materialise(data.coalesce(8))
    w, m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, iterations + 1):
        parts = data.mapInArrow(_gradient(w[:-1], float(w[-1]), penalty), "grad array<double>, n long").collect()
        g = sum((np.array(p["grad"]) for p in parts), np.zeros(len(w))) / max(1, sum(p["n"] for p in parts))
        g[:-1] += 2 * decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Classifier(place, w[:-1], float(w[-1]))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` in [0, 1] and ``predicted`` (1 from 0.5 on).

    Scores depend on the whole text only. Null and empty texts score as a text without any known feature. Of labels
    that repeat an id the largest counts; null labels and ids are not learnt from; where nothing can be learnt
    (no labels, or one class only) every score is 0. Null ids count as not held out. Rows that repeat an id each get
    their row; an empty table gives an empty result; extra columns are ignored.
    """
    model = train(docs, labels, id_col, text_col, label_col, **options)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [0.0 if model is None else model.score(t or "") for t in batch["text"].to_pylist()]
            predicted = [int(s >= 0.5) for s in score]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["held_out"], pa.array(score, pa.float64()), pa.array(predicted, pa.int32())],
                ["id", "held_out", "score", "predicted"],
            )

    slim = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    found = slim.mapInArrow(each, f"id {kind}, held_out boolean, score double, predicted int")
    return found.withColumnRenamed("id", id_col)
