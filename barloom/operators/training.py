"""Models per fold with Spark ML: gradient-boosted trees, early stopping on the validation window, adaptive search, importances."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete, detached, exists, materialise
from .metrics import log_loss

#: Stands for a missing value: below all others, so that a split can part the rows without one.
MISSING = -1e12

#: What a search draws from: lowest, highest, whether on a logarithmic scale, whether whole numbers.
SPACE: Mapping[str, tuple[float, float, bool, bool]] = {
    "maxDepth": (2, 5, False, True),
    "stepSize": (0.02, 0.5, True, False),
    "minInstancesPerNode": (5, 500, True, True),
    "subsamplingRate": (0.5, 1.0, False, False),
    "featureShare": (0.2, 1.0, False, False),
    "minInfoGain": (1e-7, 1e-2, True, False),
}

TRIALS = (
    "fold_id int, trial int, round int, rung int, trees int, maxDepth int, stepSize double, minInstancesPerNode int, subsamplingRate double, "
    "featureShare double, minInfoGain double, val_log_loss double"
)


def prepared(rows: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """``keep``, label and the features as one vector, written by ranges of date and in order of ``keep``: folds are filters on it.

    Rows without a label take no part. Missing and not-a-number features become ``MISSING``. The rows are written before they are
    dealt: finding the ranges reads them once more. Their order is fixed, as the samples of a fit go by it.
    """
    values = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(MISSING)) for f in features]
    found = rows.where(F.col(label).isNotNull()).select(*keep, F.col(label).cast("double").alias("label"), array_to_vector(F.array(*values)).alias("features"))
    return materialise(materialise(found).repartitionByRange("date").sortWithinPartitions(*keep))


def role_in(fold: Row) -> Column:
    """The window of a fold that holds the date, or null."""
    return reduce(
        lambda rest, r: F.when(F.col("date").between(fold[f"{r}_start"], fold[f"{r}_end"]), F.lit(r)).otherwise(rest), ("test", "val", "train"), F.lit(None)
    )


def of_fold(rows: DataFrame, fold: Row) -> DataFrame:
    """The rows in the windows of one fold, with ``role``: the dates reach the scan, and nothing is stored once a fold."""
    return rows.where(F.col("date").between(fold["train_start"], fold["test_end"])).withColumn("role", role_in(fold)).where("role IS NOT NULL")


def windows(rows: DataFrame, folds: Sequence[Row], most: int = 50_000, hold: bool = False) -> list[DataFrame]:
    """The rows of each fold in as few partitions as hold ``most`` of them each; with ``hold``, small folds as tables.

    Fits of many folds and settings run side by side, and each is a long chain of short jobs, so that spare partitions cost
    tasks and nothing else; large folds keep as many partitions as they have. With ``hold``, for many fits of each fold, folds of
    one partition are written as such: no fit plans, scans and filters again, or ships that plan with each task. Large ones
    stay filters on the written rows.
    """
    if not folds:
        return []
    sizes = rows.agg(*[F.count(role_in(f)) for f in folds]).first()
    found = [of_fold(rows, f).coalesce(max(1, -(-n // most))) for f, n in zip(folds, sizes, strict=True)]
    return [detached(w) if hold and n <= most else w for w, n in zip(found, sizes, strict=True)]


def fit(rows: DataFrame, early: bool = True, trees: int = 20, featureShare: float = 1.0, **setting: float) -> GBTClassificationModel:
    """A model of the train rows of one fold (column ``role``); with ``early``, trees stop when the val rows gain no more."""
    used = rows.where(F.col("role").isin("train", "val") if early else F.col("role") == "train")
    model = GBTClassifier(maxIter=trees, seed=7, featureSubsetStrategy=str(float(featureShare)) if featureShare < 1 else "all", **{"maxDepth": 3, "stepSize": 0.1} | setting)
    if early:
        model = model.setValidationIndicatorCol("is_val")
    return model.fit(used.select("label", "features", (F.col("role") == "val").alias("is_val")))


def per_fold(rows: DataFrame, folds: Sequence[Row], work: Callable[[Row, DataFrame], DataFrame], parallel: int = 4) -> DataFrame:
    """``fold_id`` and what ``work`` makes of the rows of each fold, of all folds; some folds are fitted at a time."""
    if not folds:
        raise ValueError("there is no fold")
    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(work, folds, windows(rows, folds)))
    named = [part.select(F.lit(fold["fold_id"]).alias("fold_id"), "*") for fold, part in zip(folds, parts, strict=True)]
    return reduce(DataFrame.unionByName, named)


def predict(model: GBTClassificationModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns with predicted_proba."""
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("predicted_proba"))


def importances(model: GBTClassificationModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """feature, importance, largest first."""
    values = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)], "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def drawn(fold: int, trial: int, known: Sequence[Row], seed: int = 42) -> dict[str, float]:
    """A setting for one trial: uniform in the space, or, with losses ``known``, near one of the best quarter of them.

    Depends on its arguments only. A third of the trials stay uniform, so that no region is left for good; steps shrink
    with the number of known trials.
    """
    dice = random.Random(f"{seed}:{fold}:{trial}")
    best = sorted(known, key=lambda r: (r["val_log_loss"], r["trial"]))[: max(1, len(known) // 4)]
    near = dice.choice(best) if best and dice.random() > 1 / 3 else None
    width, out = 0.3 / math.sqrt(1 + len(known) / 10), {}
    for name, (low, high, logarithmic, whole) in SPACE.items():
        to, back = (math.log, math.exp) if logarithmic else (float, float)
        a, b = to(low), to(high)
        u = dice.random()
        if near is not None:
            u = (to(near[name]) - a) / (b - a) + dice.gauss(0, width)
            u = abs(u) if u < 1 else 2 - u  # a step over an end is reflected
        value = back(a + (b - a) * min(1.0, max(0.0, u)))
        out[name] = min(high, max(low, round(value))) if whole else min(high, max(low, value))
    return out


def trial_loss(rows: DataFrame, trees: int, setting: Mapping[str, float]) -> float:
    """The log loss of the val rows under the model of the train rows of a fold."""
    model = fit(rows, early=False, trees=trees, **setting)
    return float(predict(model, rows.where("role = 'val'"), ["label"]).agg(log_loss().alias("loss")).first()["loss"])


def search(
    rows: DataFrame, folds: Sequence[Row], path: str, draws: Sequence[int] = (20, 10, 10, 10), budgets: Sequence[int] = (2, 8), share: int = 4,
    parallel: int = 8, seed: int = 42, score: Callable[[DataFrame, int, Mapping[str, float]], float] = trial_loss,
) -> DataFrame:
    """The table of trials of an adaptive search on every fold, kept under ``path``.

    Columns: fold_id, trial, round, rung, trees, the setting and val_log_loss. Each round draws settings near the best of the
    rounds before it (``drawn``). They are all fitted with the first budget of trees; of each rung, the best one in
    ``share`` go on to the next budget (successive halving). All folds and trials of a rung are fitted side by side, each
    fit a chain of Spark jobs over the fold's rows. A rung is written when it is done: a search that was
    stopped goes on with its first missing rung and ends in the same table, and a finished one fits nothing.
    Only losses come to the driver, one number a trial. A fold without train or val rows is an error.
    """
    spark, ids = rows.sparkSession, [f["fold_id"] for f in folds]
    of = dict(zip(ids, windows(rows, folds, hold=True), strict=True))
    known: dict[int, list[Row]] = {k: [] for k in ids}  # the last loss of every trial of the rounds that are over
    first = 0
    with ThreadPoolExecutor(parallel) as pool:
        for number, n in enumerate(draws):
            running = {k: [(t, drawn(k, t, known[k], seed)) for t in range(first, first + n)] for k in ids}
            last: dict[tuple[int, int], Row] = {}
            for rung, trees in enumerate(budgets):
                place = f"{path}/round={number}/rung={rung}"
                if not exists(spark, f"{place}/_SUCCESS"):
                    # neighbours in the list are of different folds: fits that run side by side differ in size
                    todo = [(k, *trial) for trials in zip(*running.values(), strict=True) for k, trial in zip(ids, trials, strict=True)]
                    losses = list(pool.map(lambda w: score(of[w[0]], trees, w[2]), todo))
                    done = [
                        Row(fold_id=k, trial=t, round=number, rung=rung, trees=trees, **setting, val_log_loss=loss)
                        for (k, t, setting), loss in zip(todo, losses, strict=True)
                    ]
                    spark.createDataFrame(done, TRIALS).coalesce(1).write.mode("overwrite").parquet(place)
                found = spark.read.schema(TRIALS).parquet(place).collect()  # one row a fold and trial of the rung
                last |= {(r["fold_id"], r["trial"]): r for r in found}
                for k in ids:
                    order = sorted((r["val_log_loss"], r["trial"]) for r in found if r["fold_id"] == k)
                    kept = {t for _, t in order[: max(1, len(order) // share)]}
                    running[k] = [(t, setting) for t, setting in running[k] if t in kept]
            for (k, _), r in last.items():
                known[k].append(r)
            first += n
    places = [f"{path}/round={number}/rung={rung}" for number in range(len(draws)) for rung in range(len(budgets))]
    return spark.read.schema(TRIALS).parquet(*places)


def best_settings(trials: DataFrame) -> dict[int, tuple[int, dict[str, float]]]:
    """For each fold the trees and setting of the trial of least loss among those of the largest budget, ties to the first."""
    top = trials.groupBy("fold_id").agg(F.max("trees").alias("trees"))
    best = trials.join(top, ["fold_id", "trees"]).groupBy("fold_id", "trees").agg(F.min_by(F.struct(*SPACE), F.struct("val_log_loss", "trial")).alias("s"))
    return {r["fold_id"]: (r["trees"], r["s"].asDict()) for r in best.collect()}  # one row a fold


def save(model: GBTClassificationModel, path: str, features: Sequence[str], **about: object) -> None:
    """The model, and beside it one JSON row: its features in order, its settings, and what else is said about it."""
    spark = SparkSession.getActiveSession()
    delete(spark, path)
    settings = {p.name: v for p, v in model.extractParamMap().items() if isinstance(v, int | float | str)}
    model.write().save(f"{path}/model")
    row = json.dumps({"features": list(features), "settings": settings, "trees": model.getNumTrees} | about, default=str)
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.text(f"{path}/metadata")


def load(path: str) -> tuple[GBTClassificationModel, dict]:
    """A saved model and what was saved about it."""
    spark = SparkSession.getActiveSession()
    return GBTClassificationModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/metadata").first()[0])
