"""Fits, saved models and the adaptive search over folds."""

from datetime import date, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from barloom.operators import training as T
from barloom.sources.scratch import new_folder

START = date(2000, 1, 3)
DAY = lambda n: START + timedelta(days=n)


def fold(k, train, val, test):
    spans = {"train": (0, train), "val": (train + 1, val), "test": (val + 1, test)}
    return Row(fold_id=k, **{f"{r}_{side}": DAY(n) for r, ends in spans.items() for side, n in zip(("start", "end"), ends, strict=True)})


FOLDS = [fold(0, 29, 39, 49), fold(1, 39, 49, 59)]


@pytest.fixture(scope="module")
def rows(spark):
    """Sixty days of ten tickers; the label follows ``a``, which is missing for one ticker in ten, and ``b`` is no number for some."""
    found = [
        (DAY(d), f"T{t}", None if t == 9 else float((d * 7 + t * 3) % 10), float("nan") if t % 4 == 0 else float(d % 3), None if d == 5 else int((d * 7 + t * 3) % 10 > 4 and t != 9))
        for d in range(60)
        for t in range(10)
    ]
    frame = spark.createDataFrame(found, "date date, ticker string, a double, b double, y int")
    return T.prepared(frame, ["a", "b"], "y")


def test_rows_without_a_label_are_left_out_and_missing_values_marked(rows):
    assert rows.count() == 590
    found = {tuple(r["features"]) for r in rows.where("ticker IN ('T8', 'T9')").collect()}
    assert all(b == T.MISSING or a == T.MISSING for a, b in found) and len(found) > 3


def test_windows_hold_each_row_once_a_fold(rows):
    first, second = T.windows(rows, FOLDS)
    assert {(r[0], r[1]) for r in first.groupBy("role").count().collect()} == {("train", 290), ("val", 100), ("test", 100)}
    assert second.where("role = 'test'").agg({"date": "min"}).first()[0] == DAY(50) and second.rdd.getNumPartitions() == 1
    with pytest.raises(ValueError):
        T.per_fold(rows, [], lambda fold, w: w)


def test_a_saved_model_gives_the_same_predictions(spark, rows):
    window, path = T.of_fold(rows, FOLDS[0]), new_folder(spark)
    model = T.fit(window, trees=3)
    T.save(model, path, ["a", "b"], label="y", fold=FOLDS[0].asDict())
    again, about = T.load(path)
    assert about["features"] == ["a", "b"] and about["fold"]["fold_id"] == 0 and about["settings"]["maxDepth"] == 3
    scores = [{(r[0], r[1]): r[2] for r in T.predict(m, window.where("role = 'test'"), ["date", "ticker"]).collect()} for m in (model, again)]
    assert scores[0] == scores[1] and len(scores[0]) == 100
    assert T.trial_loss(window, 3, {"maxDepth": 2}) < 0.3  # the label is a threshold of one feature
    assert T.importances(model, ["a", "b"], spark).first()["feature"] == "a"


def test_rows_are_computed_once_and_stand_in_order(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return float(x)

    frame = spark.createDataFrame([(DAY(i * 37 % 60), f"T{i * 7 % 10}", i) for i in range(400)], "date date, ticker string, i int").repartition(3)
    frame = frame.dropDuplicates(["date", "ticker"]).withColumn("a", F.udf(seen, "double")("i"))
    rows = T.prepared(frame.withColumn("y", F.lit(1)), ["a"], "y")
    found = [[(r["date"], r["ticker"]) for r in part] for part in rows.rdd.glom().collect()]
    assert made.value == sum(map(len, found)) > 0  # not once for the ranges and once more for the table
    assert all(part == sorted(part) for part in found)


def test_small_folds_of_a_search_are_tables_and_large_ones_filters(rows):
    plain, small, large = (T.windows(rows, FOLDS, **how)[1] for how in ({}, {"hold": True}, {"hold": True, "most": 50}))
    text = [w._jdf.queryExecution().executedPlan().toString() for w in (plain, small, large)]
    assert "parquet" in text[0] and "parquet" not in text[1] and "parquet" in text[2]
    assert [tuple(r) for r in small.collect()] == [tuple(r) for r in plain.collect()]
    assert T.trial_loss(small, 2, {"subsamplingRate": 0.6}) == T.trial_loss(plain, 2, {"subsamplingRate": 0.6})


def plain_loss(window, trees, setting):
    """Stands for a fit: least at depth 4 and a small step, less with more trees."""
    return abs(setting["maxDepth"] - 4) + setting["stepSize"] + 1 / trees


def test_draws_are_in_the_space_repeat_and_close_in(spark):
    free = [T.drawn(0, t, []) for t in range(200)]
    assert free == [T.drawn(0, t, []) for t in range(200)]
    known = [Row(trial=t, **s, val_log_loss=plain_loss(None, 1, s)) for t, s in enumerate(free[:40])]
    near = [T.drawn(0, t, known) for t in range(200, 400)]
    for s in (*free, *near):
        assert all(low <= s[name] <= high for name, (low, high, _, _) in T.SPACE.items()) and isinstance(s["maxDepth"], int)
    mean = lambda draws: sum(plain_loss(None, 1, s) for s in draws) / len(draws)
    assert mean(near) < mean(free) - 0.2


def test_a_stopped_search_goes_on_where_it_was(spark, rows):
    plan = {"draws": (8, 4), "budgets": (1, 3), "share": 4}
    whole = T.search(rows, FOLDS, new_folder(spark), score=plain_loss, **plan)
    table = sorted(map(tuple, whole.collect()))
    assert len(table) == 2 * (8 + 2 + 4 + 1)
    # halving keeps the best: each trial of the second rung is among the two best of the first
    first = whole.where("round = 0 AND rung = 0 AND fold_id = 0").orderBy("val_log_loss", "trial").limit(2).collect()
    assert {r["trial"] for r in whole.where("round = 0 AND rung = 1 AND fold_id = 0").collect()} == {r["trial"] for r in first}

    path, fits = new_folder(spark), []

    def fails(window, trees, setting):
        fits.append(1)
        if len(fits) > 22:  # in the second round
            raise RuntimeError("lost")
        return plain_loss(window, trees, setting)

    with pytest.raises(RuntimeError):
        T.search(rows, FOLDS, path, score=fails, parallel=1, **plan)
    counted = []
    again = T.search(rows, FOLDS, path, score=lambda *a: counted.append(1) or plain_loss(*a), **plan)
    assert sorted(map(tuple, again.collect())) == table
    assert len(counted) == 30 - 20  # the two rungs of the first round were not fitted again
    T.search(rows, FOLDS, path, score=fails, **plan)  # nothing is left to fit
    trees, setting = T.best_settings(again)[0]
    assert trees == 3 and plain_loss(None, 3, setting) == min(r[-1] for r in table if r[0] == 0 and r[4] == 3)


def test_search_fits_models(spark, rows):
    found = T.search(rows, FOLDS[:1], new_folder(spark), draws=(2,), budgets=(1, 2), parallel=2).collect()
    assert len(found) == 3 and all(0 < r["val_log_loss"] < 1 for r in found)
