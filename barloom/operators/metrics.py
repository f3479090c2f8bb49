"""Ranking and classification metrics of predictions (date, ticker, label, predicted_proba, actual_return)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import average_rank, dealt

EPS = 1e-15


def log_loss(by: Sequence[str] = ()) -> Column:
    """Mean log loss of probabilities clipped away from 0 and 1."""
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col("predicted_proba")))
    return F.avg(-F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p)))


def invalid_inputs(df: DataFrame) -> DataFrame:
    """One row of counts that must be 0 for metrics to hold, and ``n``, which must not."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("label").isin(0, 1) | F.col("label").isNull()).alias("n_not_binary"),
        F.count_if(F.col("predicted_proba").isNull() | ~F.col("predicted_proba").between(0, 1)).alias("n_bad_probability"),
    )


def auc(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``auc`` per group: the share of pairs ranked rightly, ties half; null where a class is missing.

    Scores are counted first, so that a cumulative sum runs over distinct scores of a group and not over rows.
    """
    t = df.groupBy(*by, "predicted_proba").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    below = Window.partitionBy(*by).orderBy("predicted_proba").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("under", F.coalesce(F.sum("q").over(below), F.lit(0)))
    won = F.sum(F.col("p") * (F.col("under") + F.col("q") / 2.0))
    return t.groupBy(*by).agg(F.try_divide(won, F.sum("p") * F.sum("q")).alias("auc"))


def average_precision(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``avg_precision`` per group: the sum of recall steps times precision over distinct scores from the top."""
    t = df.groupBy(*by, "predicted_proba").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"))
    top = Window.partitionBy(*by).orderBy(F.col("predicted_proba").desc()).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("precision", F.sum("p").over(top) / F.sum("n").over(top))
    return t.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * F.col("precision")), F.sum("p")).alias("avg_precision"))


def _top(df: DataFrame, share: float) -> DataFrame:
    """Marks the floor(n * share) best rows of each date, ties by ticker."""
    day = Window.partitionBy("date")
    best = day.orderBy(F.col("predicted_proba").desc(), "ticker")
    k = F.floor(F.count(F.lit(1)).over(day) * share)
    return df.withColumns({"_k": k, "_r": F.row_number().over(best)}).withColumn("top", F.col("_r") <= F.col("_k"))


def precision_at_top(df: DataFrame, share: float) -> DataFrame:
    """Mean over dates of the share of positives among the best; dates with no room for one do not count."""
    daily = _top(df, share).where("top").groupBy("date").agg(F.avg("label").alias("p"))
    return daily.agg(F.avg("p").alias("precision_at_top"), F.count(F.lit(1)).alias("n_dates"))


def recall_at_top(df: DataFrame, share: float) -> DataFrame:
    """Mean over dates with positives of the share of them among the best."""
    daily = _top(df, share).groupBy("date").agg(
        F.sum(F.when(F.col("top"), F.col("label")).otherwise(0)).alias("hit"), F.sum("label").alias("all")
    )
    return daily.where(F.col("all") > 0).agg(F.avg(F.col("hit") / F.col("all")).alias("recall_at_top"), F.count(F.lit(1)).alias("n_dates"))


def calibration(df: DataFrame, buckets: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """bucket, n, mean_predicted, mean_label over equal-width buckets, the last one closed; empty ones stay."""
    b = F.least(F.floor(F.col("predicted_proba") * buckets), F.lit(buckets - 1)).cast("int")
    found = df.groupBy(*by, b.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("predicted_proba").alias("mean_predicted"), F.avg("label").alias("mean_label")
    )
    spine = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    if by:
        spine = spine.crossJoin(df.select(*by).distinct())  # buckets times groups
    return spine.join(found, [*by, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def information_coefficient(
    df: DataFrame, by: Sequence[str] = ("date",), score: str = "predicted_proba", outcome: str = "actual_return"
) -> DataFrame:
    """``ic`` per group: the rank correlation of score and outcome; null for fewer than 3 rows or constant ranks."""
    pairs = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    ranked = pairs.select(
        *by, average_rank(F.col(score), by).alias("a"), average_rank(F.col(outcome), by).alias("b")
    )
    return ranked.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= 3, _correlation("a", "b")).alias("ic"))


def _correlation(a: str, b: str) -> Column:
    """The correlation of two columns, null where one is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def ic_summary(ics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, ratio of both, t statistic and number of the known coefficients."""
    return (
        ics.where("ic IS NOT NULL")
        .groupBy(*by)
        .agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.count(F.lit(1)).alias("n"))
        .withColumn("ic_ir", F.try_divide("ic_mean", "ic_std"))
        .withColumn("ic_t", F.try_divide(F.col("ic_mean") * F.sqrt(F.col("n").cast("double")), F.col("ic_std")))
    )


#: Draws whose orders are one matrix: with 5,000 tickers a date it takes 10 MB.
DRAWS_AT_ONCE = 128


def _orders(day: object, tickers: Sequence[str], n: int, seed: int) -> Iterator[np.ndarray]:
    """The orders of a date's tickers under draws 1 to n, some draws at a time: by the MD5 of seed, draw, date and ticker."""
    for first in range(1, n + 1, DRAWS_AT_ONCE):
        draws = range(first, min(n, first + DRAWS_AT_ONCE - 1) + 1)
        yield np.array([[md5(f"{seed}|{d}|{day}|{t}".encode()).digest() for t in tickers] for d in draws], "S16")


def permuted_ics(df: DataFrame, n: int = 1000, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """draw, ic_mean, per group of ``by``: the mean daily coefficient when scores are dealt anew within each date, ``n`` times.

    A draw re-pairs the rows of a date by their order under the MD5 of seed, draw, date and ticker, so that any
    cluster, and any other engine, makes the same permutations. A date's rows are one group, as long as its tickers; their
    orders under some draws are a matrix, which the ranks are multiplied with. Rows are shuffled once, not once a draw.
    """
    keys = [*by, "date"]

    def each(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ticker")
        tickers, day = rows["ticker"].to_pylist(), rows["date"][0].as_py()
        a, b = (rankdata(rows[c].to_numpy().astype(float)) for c in ("predicted_proba", "actual_return"))
        a, b = a - a.mean(), b - b.mean()
        size = np.sqrt((a @ a) * (b @ b))
        if rows.num_rows < 3 or not size > 0:
            return pa.table({**{c: rows[c].slice(0, 0) for c in by}, "ics": pa.array([], pa.list_(pa.float64()))})
        ics = np.concatenate([a[np.argsort(k, axis=1, kind="stable")] @ b / size for k in _orders(day, tickers, n, seed)])
        return pa.table({**{c: rows[c].slice(0, 1) for c in by}, "ics": pa.array([ics], pa.list_(pa.float64()))})

    slim = df.where("predicted_proba IS NOT NULL AND actual_return IS NOT NULL").select(
        *keys, "ticker", F.col("predicted_proba").cast("double").alias("predicted_proba"), F.col("actual_return").cast("double").alias("actual_return")
    )
    shape = ", ".join([*(f"{c} {slim.schema[c].dataType.simpleString()}" for c in by), "ics array<double>"])
    daily = dealt(slim, *keys).groupBy(*keys).applyInArrow(each, shape)
    return daily.select(*by, F.posexplode("ics").alias("at", "ic")).groupBy(*by, (F.col("at") + 1).alias("draw")).agg(F.avg("ic").alias("ic_mean"))


def permutation_summary(null: DataFrame, actual: DataFrame, two_sided: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """p_value, null_mean, null_std: how often a permuted mean reaches the actual one (one row of ic_mean per group)."""
    keys = list(by)
    x = actual.select(*keys, F.col("ic_mean").alias("x"))
    m = null.select(*keys, F.col("ic_mean").alias("m"))
    both = m.join(x, keys) if keys else m.join(F.broadcast(x))  # without groups it is one row
    reached = F.abs("m") >= F.abs("x") if two_sided else F.col("m") >= F.col("x")
    return both.groupBy(*keys).agg(
        F.avg(reached.cast("double")).alias("p_value"), F.avg("m").alias("null_mean"), F.stddev_samp("m").alias("null_std")
    )


def permuted_feature_ics(df: DataFrame, features: Sequence[str], outcome: str, n: int = 1000, seed: int = 0) -> DataFrame:
    """feature, draw, ic_mean: as ``permuted_ics`` for many features, which share the draws.

    A date's rows are one group, as long as its tickers. There the outcome's ranks under all draws are one matrix,
    and all features are multiplied with it at once; the means over dates are aggregated by Spark.
    """

    def each(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ticker")
        tickers, day = rows["ticker"].to_pylist(), rows["date"][0].as_py()
        y = rows["_y"].to_numpy()
        found = {"feature": [], "ics": []}
        keys = np.concatenate(list(_orders(day, tickers, n, seed)))
        orders: dict[bytes, np.ndarray] = {}
        for f in features:
            x = rows[f].to_numpy().astype(float)
            known = ~(np.isnan(x) | np.isnan(y))
            if known.sum() < 3:
                continue
            if known.tobytes() not in orders:
                orders[known.tobytes()] = np.argsort(keys[:, known], axis=1, kind="stable")
            a, b = (rankdata(v[known]) for v in (x, y))
            a, b = a - a.mean(), b - b.mean()
            size = np.sqrt((a @ a) * (b @ b))
            if size > 0:
                found["feature"].append(f)
                found["ics"].append(a[orders[known.tobytes()]] @ b / size)
        return pa.table({"feature": pa.array(found["feature"], pa.string()), "ics": pa.array(found["ics"], pa.list_(pa.float64()))})

    slim = df.select("date", "ticker", F.col(outcome).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    daily = dealt(slim, "date").groupBy("date").applyInArrow(each, "feature string, ics array<double>")
    return daily.select("feature", F.posexplode("ics").alias("at", "ic")).groupBy("feature", (F.col("at") + 1).alias("draw")).agg(F.avg("ic").alias("ic_mean"))


def rankdata(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties at their mean."""
    _, place, count = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(count)
    return (last - (count - 1) / 2.0)[place]


def bundle(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, positives, log_loss, auc, avg_precision, ic_mean, ic_std and ic_ir per group."""
    basic = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_positive"), log_loss().alias("log_loss"))
    ics = ic_summary(information_coefficient(df, [*by, "date"]), by).select(*by, "ic_mean", "ic_std", "ic_ir")
    keys = list(by)
    return basic.join(auc(df, by), keys).join(average_precision(df, by), keys).join(ics, keys, "left")


def regime_breakdown(df: DataFrame, regime: str, least: int = 50) -> DataFrame:
    """The bundle per value of a regime column, for regimes of at least ``least`` rows."""
    return bundle(df.where(F.col(regime).isNotNull()), [regime]).where(F.col("n_rows") >= least)


def over_folds(folds: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """metric, mean, std, min, max, n over the finite values of each column, per group if given."""
    long = folds.select(
        *by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")
    ).select(*by, "s.*")
    finite = long.where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')")
    return finite.groupBy(*by, "metric").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count(F.lit(1)).alias("n")
    )


def pooled_calibration(per_fold: DataFrame) -> DataFrame:
    """Calibration of many folds, each bucket weighted by its count."""
    n = F.sum("n")
    return per_fold.groupBy("bucket").agg(
        n.alias("n"),
        F.try_divide(F.sum(F.col("mean_predicted") * F.col("n")), n).alias("mean_predicted"),
        F.try_divide(F.sum(F.col("mean_label") * F.col("n")), n).alias("mean_label"),
    )


def importance_over_folds(per_fold: DataFrame) -> DataFrame:
    """feature, mean, std, n_folds and share of the sum of means, of (fold_id, feature, importance)."""
    t = per_fold.groupBy("feature").agg(
        F.avg("importance").alias("mean"), F.stddev_samp("importance").alias("std"), F.countDistinct("fold_id").alias("n_folds")
    )
    return t.withColumn("share", F.try_divide("mean", F.sum("mean").over(Window.partitionBy(F.lit(1)))))


def decision(folds: DataFrame, p_values: DataFrame) -> DataFrame:
    """Whether mean AUC and IC reach the least (0.52, 0.02) and the ideal (0.55, 0.04) over folds, and beat chance in all.

    ``p_values`` holds the p_value of each fold's permutations; ``share_p10`` is the share of folds below 0.10, and all of
    them must be, with at least one known, for ``beats_chance`` and ``passes``.
    """
    one = folds.agg(F.avg("auc").alias("auc"), F.avg("ic_mean").alias("ic"))
    chance = p_values.agg(F.avg((F.col("p_value") < 0.10).cast("double")).alias("share_p10"))
    enough = (F.col("auc") >= 0.52) & (F.col("ic") >= 0.02)
    beats = F.coalesce(F.col("share_p10") == 1, F.lit(False))
    return one.crossJoin(chance).select(  # one row each
        "auc", "ic", "share_p10",
        enough.alias("reaches_least"),
        ((F.col("auc") >= 0.55) & (F.col("ic") >= 0.04)).alias("ideal"),
        beats.alias("beats_chance"), (enough & beats).alias("passes"),
    )


def stability(folds: DataFrame, n: int = 4) -> DataFrame:
    """Rolling mean and deviation of the fold coefficients, and the share of folds whose sign is the overall one's."""
    everything = Window.partitionBy(F.lit(1))  # one row per fold
    w = everything.orderBy("fold_id").rowsBetween(-(n - 1), 0)
    enough = F.count("ic_mean").over(w) == n
    same = (F.signum("ic_mean") == F.signum(F.avg("ic_mean").over(everything))).cast("double")
    return folds.withColumn("_s", same).select(
        "fold_id",
        F.when(enough, F.avg("ic_mean").over(w)).alias("rolling_mean"),
        F.when(enough, F.stddev_samp("ic_mean").over(w)).alias("rolling_std"),
        F.avg("_s").over(everything).alias("same_sign"),
    )


def compare_versions(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Two tables side by side, rows of either kept, with the difference of each column."""
    left = a.select(key, *[F.col(c).alias(f"{c}_a") for c in columns])
    right = b.select(key, *[F.col(c).alias(f"{c}_b") for c in columns])
    joined = left.join(right, key, "full")
    return joined.withColumns({f"{c}_delta": F.col(f"{c}_b") - F.col(f"{c}_a") for c in columns})


def compare_calibration(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pooled calibrations of two versions by bucket: n, the gap of label and prediction of each, and how much smaller b's is."""
    side = lambda t, v: t.select("bucket", F.col("n").alias(f"n_{v}"), (F.col("mean_label") - F.col("mean_predicted")).alias(f"gap_{v}"))
    joined = side(a, "a").join(side(b, "b"), "bucket", "full")
    return joined.withColumn("gap_reduced", F.abs("gap_a") - F.abs("gap_b"))


def unpivoted(df: DataFrame, keep: Sequence[str], features: Sequence[str], outcomes: dict[int, str]) -> DataFrame:
    """``keep``, feature, x, horizon, y: a row for each feature and each horizon's outcome of a row, with both known."""
    x = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]
    y = [F.struct(F.lit(h).alias("horizon"), F.col(c).alias("y")) for h, c in outcomes.items()]
    long = df.select(*keep, F.array(*y).alias("ys"), F.explode(F.array(*x)).alias("s")).where("s.x IS NOT NULL")
    return long.select(*keep, "s.*", F.explode("ys").alias("t")).select(*keep, "feature", "x", "t.*").where("y IS NOT NULL")


def univariate_ics(df: DataFrame, features: Sequence[str], outcomes: dict[int, str]) -> DataFrame:
    """The summary of daily coefficients of each feature and horizon: they are unpivoted, then one pass serves all of them.

    ``outcomes`` names the outcome column of each horizon.
    """
    long = unpivoted(df, ["date"], features, outcomes)
    return ic_summary(information_coefficient(long, ["feature", "horizon", "date"], "x", "y"), ["feature", "horizon"])


def extremes(summary: DataFrame, n: int, best: bool, by: Sequence[str] = ("horizon",)) -> DataFrame:
    """The n features of highest or lowest ratio of each group, unknown ones last; ratios equal in 9 digits tie, by name."""
    ratio = F.round("ic_ir", 9)
    order = ratio.desc_nulls_last() if best else ratio.asc_nulls_last()
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order, "feature"))
    return summary.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def module_summary(summary: DataFrame, modules: DataFrame, too_good: float = 3.0, by: Sequence[str] = ("horizon",)) -> DataFrame:
    """Per group and module: features, those of suspicious ratio, and the best and worst of them, ties as in ``extremes``."""
    place = F.struct(F.round("ic_ir", 9), "feature")
    return summary.join(modules, "feature").groupBy(*by, "module").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.abs("ic_ir") > too_good).alias("n_too_good"),
        F.max_by("feature", place).alias("best"),
        F.min_by("feature", place).alias("worst"),
    )


def dispersion(df: DataFrame, x: str, least: int = 5) -> DataFrame:
    """Per date: deviation, spread of the middle 80 % and 50 %, and range of x, for dates of enough rows."""
    q = {p: F.percentile(x, p) for p in (0.1, 0.25, 0.75, 0.9)}
    return df.groupBy("date").agg(
        F.count(x).alias("n"),
        F.stddev_samp(x).alias("std"),
        (q[0.9] - q[0.1]).alias("p10_p90"),
        (q[0.75] - q[0.25]).alias("p25_p75"),
        (F.max(x) - F.min(x)).alias("range"),
    ).where(F.col("n") >= least)


def eight_numbers(df: DataFrame, x: str) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of a column."""
    return df.agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
        F.percentile(x, 0.25).alias("p25"), F.percentile(x, 0.5).alias("p50"), F.percentile(x, 0.75).alias("p75"), F.max(x).alias("max"),
    )


def prediction_distribution(df: DataFrame) -> DataFrame:
    """Moments, tail shares and a histogram of nine bins of the probabilities, in one pass."""
    p = F.col("predicted_proba")
    bins = [F.count_if((p >= lo / 10) & (p < (lo + 1) / 10 if lo < 8 else p <= 1)).alias(f"bin_{lo}") for lo in range(9)]
    return df.agg(
        F.count(p).alias("n"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"),
        F.avg((p < 0.3).cast("double")).alias("share_low"), F.avg((p > 0.7).cast("double")).alias("share_high"), *bins,
    )


def top_pick_ranks(df: DataFrame, n: int) -> DataFrame:
    """How the n best of each date came out: mean percentile of their returns, and the share in each fifth."""
    day = Window.partitionBy("date")
    df = df.withColumns(
        {
            "_p": F.row_number().over(day.orderBy(F.col("predicted_proba").desc(), "ticker")),
            "_a": F.row_number().over(day.orderBy("actual_return", "ticker")),
            "_n": F.count(F.lit(1)).over(day),
        }
    )
    picks = df.where(F.col("_p") <= n).withColumn("pct", F.try_divide(F.col("_a") - 1, F.col("_n") - 1))
    fifth = F.least(F.floor(F.col("pct") * 5), F.lit(4))
    return picks.agg(F.avg("pct").alias("mean_percentile"), *[F.avg((fifth == i).cast("double")).alias(f"fifth_{i}") for i in range(5)])


def regime_mix(df: DataFrame, regime: str, level: str) -> DataFrame:
    """Share of rows in each regime, and mean and largest level there."""
    t = df.where(F.col(regime).isNotNull()).groupBy(regime).agg(F.count(F.lit(1)).alias("n"), F.avg(level).alias("mean_level"), F.max(level).alias("max_level"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
