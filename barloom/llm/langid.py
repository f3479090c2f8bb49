"""Hierarchical language identification: the language family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, drawn, give_back, held_out, materialise

#: Families of languages; a language in none is a family of its own.
FAMILIES: Mapping[str, str] = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic", "sk": "slavic",
}
UNKNOWN = "und"
DIMENSIONS = 1 << 14
SCALE = 32.0
LETTER = regex.compile(r"\p{L}")


def grams(data: bytes, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bucket of every run of 2 and of 3 bytes of a text, lower-cased in A-Z, a blank put before and after."""
    return _runs(b" " + data.lower() + b" ", dimensions)


def _runs(data: bytes, dimensions: int = DIMENSIONS, starts: int | None = None) -> np.ndarray:
    """Bucket of every run of 2 and of 3 of the bytes that starts at one of the first ``starts``."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:]
    two, three = two[:starts], three[:starts]
    mixed = np.concatenate([two * np.uint32(2654435761), (three + np.uint32(1 << 20)) * np.uint32(2246822519)])
    return (mixed >> np.uint32(32 - dimensions.bit_length() + 1)).astype(np.int64)


def features(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``label``, ``draw``, ``at`` and ``share`` of the rows of ``docs`` (label, draw, text): the share of each gram bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, share = [], []
            for text in batch.column(2).to_pylist():
                bucket, n = np.unique(grams(text, dimensions), return_counts=True)
                at.append(bucket.astype(np.int32))
                share.append((n / n.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))],
                ["label", "draw", "at", "share"],
            )

    rows = docs.select("label", "draw", F.col("text").cast("binary").alias("text"))
    return materialise(rows.mapInArrow(each, "label string, draw long, at array<int>, share array<float>"))


def fit_machine(
    at: list[np.ndarray], share: list[np.ndarray], positive: np.ndarray, cost: float, epochs: int, dimensions: int = DIMENSIONS
) -> tuple[np.ndarray, float]:
    """Weights and intercept of one linear SVM of squared hinge loss, by dual coordinate descent (Hsieh et al., 2008).

    Shares are small numbers, so they are scaled by ``SCALE``; the intercept is the weight of a constant feature.
    """
    y = np.where(positive, 1.0, -1.0)
    x = [SCALE * s.astype(np.float64) for s in share]
    ridge = 0.5 / cost
    curve = np.array([float(v @ v) for v in x]) + 1.0 + ridge
    weights, intercept, alpha = np.zeros(dimensions), 0.0, np.zeros(len(y))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(y)).tolist():
            slope = y[i] * (float(weights[at[i]] @ x[i]) + intercept) - 1.0 + ridge * alpha[i]
            new = max(0.0, alpha[i] - slope / curve[i])
            step = (new - alpha[i]) * y[i]
            if step:
                weights[at[i]] += step * x[i]
                intercept += step
                most = max(most, abs(slope))
                alpha[i] = new
        if most < 0.01:
            break
    return SCALE * weights, intercept


def _fit_shard(cost: float, epochs: int):
    """One machine on one shard of its rows."""

    def each(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("draw", "ascending"), ("positive", "ascending")])
        lists = [rows[c].combine_chunks() for c in ("at", "share")]
        at, share = ([v.values.to_numpy() for v in column] for column in lists)
        positive = rows["positive"].to_numpy()
        weights, intercept = fit_machine(at, share, positive, cost, epochs)
        return pa.table(
            {
                "machine": rows["machine"][:1].combine_chunks().cast(pa.int32()),
                "both": [bool(positive.any() and not positive.all())],
                "intercept": [intercept],
                "weights": pa.array([weights], pa.list_(pa.float64())),
            }
        )

    return each


class Hierarchy:
    """Weights of all pairwise machines: between families, and between the languages of each family.

    A machine is (negative class, positive class, place of its row of weights, intercept). It is bounded by the
    number of languages and buckets, never by the documents.
    """

    def __init__(self, families: dict[str, list[str]], machines: list[tuple[str, str, float]], weights: np.ndarray):
        self.families, self.machines, self.weights = families, machines, weights
        self.place = {frozenset(m[:2]): i for i, m in enumerate(machines)}

    def _vote(self, margin: np.ndarray, classes: list[str]) -> tuple[str, float]:
        """The class that wins most of its duels, the sum of margins deciding ties, and its weakest duel as a chance."""
        if len(classes) == 1:
            return classes[0], 1.0
        won = {c: [0, 0.0, np.inf] for c in classes}
        for a, b in combinations(classes, 2):
            i = self.place[frozenset((a, b))]
            m = float(margin[i]) if self.machines[i][1] == b else -float(margin[i])
            for c, own in ((b, m), (a, -m)):
                won[c] = [won[c][0] + (own > 0), won[c][1] + own, min(won[c][2], own)]
        best = max(sorted(classes), key=lambda c: (won[c][0], won[c][1]))
        return best, float(1.0 / (1.0 + np.exp(-2.0 * np.clip(won[best][2], -20.0, 20.0))))

    def predict(self, data: bytes, block: int = 1 << 20) -> tuple[str, float]:
        total, n, data = np.zeros(len(self.machines)), 0, b" " + data.lower() + b" "
        for at in range(0, len(data) - 1, block):  # a very long text goes block by block, with two bytes of the next one
            bucket = _runs(data[at : at + block + 2], starts=block)
            total += self.weights[:, bucket].sum(axis=1)
            n += len(bucket)
        margin = total / n + np.array([m[2] for m in self.machines])
        family, sure = self._vote(margin, sorted(self.families))
        lang, own = self._vote(margin, self.families[family])
        return lang, min(sure, own)


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    families: Mapping[str, str] = FAMILIES,
    per_language: int = 1500,
    per_shard: int = 1000,
    cost: float = 1.0,
    epochs: int = 30,
) -> Hierarchy | None:
    """A hierarchy learnt from the labelled rows of ``docs`` that are not held out; None if there are none.

    About ``per_language`` documents of each language, drawn by a hash of the id, are the bounded training sample.
    Each machine's rows are dealt to shards of about ``per_shard``; one job fits all machines on all shards, each
    shard in one task, and a machine is the mean of its shards (of those that hold both its classes, if any does).
    """
    known = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("label"), F.col(text_col).alias("text"))
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # one row per language
    if not n:
        return None
    # a share of hash values, per language, keeps the sample bounded without sorting or gathering a language
    share = F.create_map(*[F.lit(x) for lang, k in n.items() for x in (lang, per_language / k)])
    sample = known.where(drawn(F.col("id"), share[F.col("label")]))
    rows = features(sample.select("label", F.xxhash64("id", "text").alias("draw"), "text"))
    by_family: dict[str, list[str]] = {}
    for lang in sorted(n):
        by_family.setdefault(families.get(lang, lang), []).append(lang)
    duels = [(a, b, by_family[a], by_family[b]) for a, b in combinations(sorted(by_family), 2)]
    duels += [(a, b, [a], [b]) for langs in by_family.values() for a, b in combinations(langs, 2)]
    part_in = {
        lang: [
            (i, lang in high, buckets(sum(min(n[x], per_language) for x in low + high), per_shard))
            for i, (_, _, low, high) in enumerate(duels)
            if lang in low + high
        ]
        for lang in n
    }
    if not duels:
        return Hierarchy(by_family, [], np.zeros((0, DIMENSIONS)))
    # a row goes to each machine that its language has a part in: bounded by the number of languages
    parts = rows.sparkSession.createDataFrame(
        [(lang, *part) for lang, own in part_in.items() for part in own], "label string, machine int, positive boolean, shards int"
    )
    dealt = rows.join(F.broadcast(parts), "label").withColumn("shard", F.pmod("draw", "shards"))
    fitted = dealt.select("machine", "shard", "positive", "draw", "at", "share").groupBy("machine", "shard")
    fitted = materialise(fitted.applyInArrow(_fit_shard(cost, epochs), "machine int, both boolean, intercept double, weights array<double>"))
    weight = F.posexplode(F.concat("weights", F.array("intercept"))).alias("at", "weight")
    mean = F.coalesce(F.avg(F.when(F.col("both"), F.col("weight"))), F.avg("weight")).alias("weight")
    means = fitted.select("machine", "both", weight).groupBy("machine", "at").agg(mean)
    means = means.groupBy("machine").agg(F.sort_array(F.collect_list(F.struct("at", "weight")))["weight"].alias("weights"))
    weights, intercept = np.zeros((len(duels), DIMENSIONS)), np.zeros(len(duels))
    for r in means.collect():  # one row of weights per machine
        weights[r["machine"]], intercept[r["machine"]] = r["weights"][:-1], r["weights"][-1]
    machines = [(a, b, float(intercept[i])) for i, (a, b, _, _) in enumerate(duels)]
    return Hierarchy(by_family, machines, weights)


def _predict(model: Hierarchy | None):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for cell in batch.column(batch.num_columns - 1):
                text = cell.as_py()
                if model is None or not text or not LETTER.search(text):
                    found = (UNKNOWN, 0.0)
                else:
                    found = model.predict(text.encode())
                lang.append(found[0])
                score.append(found[1])
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "score"],
            )
            del batch, columns
            give_back()

    return each


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``lang_pred`` and ``score``.

    The family with most won duels is predicted first, then the language within it; ``score`` is the chance that a
    logistic curve gives the weaker of the two decisions. Predictions see the whole text and nothing else.

    A text that is null, empty or without a letter is ``und`` with score 0, as is every text if nothing can be
    learnt from. Null ids count as not held out, but are not learnt from. Rows that repeat an id each get their
    row; an empty table gives an empty result; extra columns are ignored.
    """
    model = train(docs, id_col, text_col, **options)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    found = slim.mapInArrow(_predict(model), f"id {kind}, held_out boolean, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)


def keep_recognised(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a score of at least ``least``; no row is shuffled."""
    model = train(docs, **options)
    fields = ", ".join(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    carried = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    # the text rides along twice: as the column it was, and as the last, which is judged
    carried = carried.withColumn("judged", F.col(f"_{docs.columns.index('text')}"))
    found = carried.mapInArrow(_predict(model), f"{fields}, lang_pred string, score double")
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select([F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
