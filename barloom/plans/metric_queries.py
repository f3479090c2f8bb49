"""Queries of folds and evaluation metrics. Predictions are the percentile rank of the 5-row return, outcomes the forward return."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.features import per_ticker
from ..operators import cross_section as X
from ..operators import folds as W
from ..operators import labels as L
from ..operators import metrics as M
from ..operators.cross_section import percentile_rank
from ..operators import pipeline as P
from ..sources.scratch import materialise
from .feature_queries import FEATURES, S1, S2, S3, S4, S5, S6
from .market_queries import F2, LABELS, SCORE, SECTION, SECTOR_RANK, percentile_sql, rank_sql, special_sessions
from .panel import bars, bars_once, rounded, with_bars

FOLDS = {"train_start": "1995-01-01", "initial_train_end": "1997-12-31"}


def predictions(spark, sf_dir):
    """date, ticker, label, predicted_proba, actual_return, vol_regime, above: rows with all three known."""
    panel = bars_once(spark, sf_dir)
    f = per_ticker(panel, ["ret_5d", "vol_regime", "dist_sma_20_pct"])
    f = f.withColumn("predicted_proba", percentile_rank(F.col("ret_5d")))
    y = L.forward_labels(panel, [5])
    return f.join(y, ["date", "ticker"]).select(
        "date", "ticker", F.col("outperforms_universe_median_5d").alias("label"), "predicted_proba",
        F.col("forward_ret_5d_demeaned").alias("actual_return"), "vol_regime", (F.col("dist_sma_20_pct") > 0).cast("int").alias("above"),
    ).where("label IS NOT NULL AND predicted_proba IS NOT NULL AND actual_return IS NOT NULL")


def folds(spark, sf_dir):
    return W.fold_bounds(bars(spark, sf_dir), **FOLDS)


def tested(spark, sf_dir):
    """Predictions of the test windows, by fold."""
    return W.fold_rows(predictions(spark, sf_dir), folds(spark, sf_dir)).where("role = 'test'")


def _one(f):
    return lambda spark, sf_dir: rounded(f(predictions(spark, sf_dir)))


def t05_folds(spark, sf_dir):
    return folds(spark, sf_dir)


def t05_fold_rows(spark, sf_dir):
    rows = W.fold_rows(bars(spark, sf_dir).select("date", "ticker"), folds(spark, sf_dir))
    return rows.groupBy("fold_id", "role").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def t10_predictions(spark, sf_dir):
    return rounded(predictions(spark, sf_dir).select("date", "ticker", "label", "predicted_proba", "actual_return"))


def m08_daily_rank_ic(spark, sf_dir):
    return rounded(M.information_coefficient(predictions(spark, sf_dir)))


def m10_permuted_ics(spark, sf_dir):
    return rounded(M.permuted_ics(materialise(predictions(spark, sf_dir)), DRAWS))


def m11_permutation_p(spark, sf_dir):
    p = materialise(predictions(spark, sf_dir))
    actual = M.ic_summary(M.information_coefficient(p))
    return rounded(M.permutation_summary(M.permuted_ics(p, DRAWS), actual))


def m12_bundle(spark, sf_dir):
    return rounded(M.bundle(predictions(spark, sf_dir).withColumn("series", F.lit("all")), ["series"]))


def m14_per_fold(spark, sf_dir):
    return rounded(M.bundle(tested(spark, sf_dir), ["fold_id"]))


def m15_over_folds(spark, sf_dir):
    return rounded(M.over_folds(M.bundle(tested(spark, sf_dir), ["fold_id"]), ["log_loss", "auc", "ic_mean"]))


def m16_regimes_over_folds(spark, sf_dir):
    per = M.bundle(tested(spark, sf_dir), ["fold_id", "above"])
    return rounded(M.over_folds(per, ["auc", "ic_mean"], ["above"]))


def diagnosed(spark, sf_dir):
    """date, ticker, all features and the demeaned forward returns of all horizons."""
    panel = bars_once(spark, sf_dir)
    f = X.cross_section(per_ticker(panel, [*PER_TICKER, *SECTION]), special_sessions(panel))
    y = L.forward_labels(panel).select("date", "ticker", *OUTCOMES.values())
    return f.select("date", "ticker", *UNIVARIATE).join(y, ["date", "ticker"])


def p05_metadata(spark, sf_dir):
    """The metadata of all features with what the panel holds of each that is made from bars alone."""
    return P.metadata(spark).join(P.coverage(diagnosed(spark, sf_dir), UNIVARIATE), "name", "left")


def importances(spark, sf_dir):
    """A stand-in for a model's importances that SQL can repeat: each feature's size of rank correlation, per fold."""
    tested = W.fold_rows(diagnosed(spark, sf_dir), folds(spark, sf_dir)).where("role = 'test'")
    long = M.unpivoted(tested, ["fold_id", "date"], UNIVARIATE, {5: OUTCOMES[5]})
    ics = M.information_coefficient(long, ["feature", "fold_id", "date"], "x", "y")
    return ics.groupBy("fold_id", "feature").agg(F.abs(F.avg("ic")).alias("importance"))


PER_TICKER = [c for columns in FEATURES.values() for c in columns if c != "supertrend_10_3"]
UNIVARIATE = [*PER_TICKER, "ret_5d_rank_universe", "vol_20d_rank_universe", "turnover_rank_universe", "ret_5d_z_winsor", "ret_5d_rank_sector", "ret_5d_dist_sector_median"]
OUTCOMES = {h: f"forward_ret_{h}d_demeaned" for h in L.HORIZONS}
DRAWS = 1000


def m17_importance(spark, sf_dir):
    return rounded(M.importance_over_folds(importances(spark, sf_dir)))


def m18_pooled_calibration(spark, sf_dir):
    return rounded(M.pooled_calibration(M.calibration(tested(spark, sf_dir), 10, ["fold_id"])))


def fold_p_values(t):
    """The p value of each fold by the permutations of its own test rows."""
    actual = M.ic_summary(M.information_coefficient(t, ["fold_id", "date"]), ["fold_id"])
    return M.permutation_summary(M.permuted_ics(t, DRAWS, ["fold_id"]), actual, by=["fold_id"])


def m19_significance(spark, sf_dir):
    """Over folds: how many beat chance by the permutations of their own test rows, and their p values."""
    p = fold_p_values(materialise(tested(spark, sf_dir)))
    return rounded(
        p.agg(
            F.count_if(F.col("p_value") < 0.05).alias("n_p05"), F.count_if(F.col("p_value") < 0.10).alias("n_p10"),
            F.percentile("p_value", 0.5).alias("median_p"), F.min("p_value").alias("min_p"), F.max("p_value").alias("max_p"), F.count("p_value").alias("n_folds"),
        )
    )


def m20_decision(spark, sf_dir):
    t = materialise(tested(spark, sf_dir))
    return rounded(M.decision(M.bundle(t, ["fold_id"]), fold_p_values(t)))


def m21_stability(spark, sf_dir):
    return rounded(M.stability(M.bundle(tested(spark, sf_dir), ["fold_id"])))


def m22_compare(spark, sf_dir):
    t = M.bundle(tested(spark, sf_dir), ["fold_id"])
    return rounded(M.compare_versions(t.where("fold_id < 10"), t.where("fold_id > 1"), "fold_id", ["auc", "ic_mean"]))


def versions(spark, sf_dir):
    """Test rows of the two versions that are compared: all folds but the last ones, and all but the first two."""
    t = materialise(tested(spark, sf_dir))
    return t.where("fold_id < 10"), t.where("fold_id > 1")


def m22_regimes(spark, sf_dir):
    """The two versions side by side by regime."""
    a, b = (M.bundle(t.where("vol_regime IS NOT NULL"), ["vol_regime"]) for t in versions(spark, sf_dir))
    return rounded(M.compare_versions(a, b, "vol_regime", ["auc", "ic_mean"]))


def m22_calibration_gap(spark, sf_dir):
    """The two versions' pooled calibrations side by side."""
    a, b = (M.pooled_calibration(M.calibration(t, 10, ["fold_id"])) for t in versions(spark, sf_dir))
    return rounded(M.compare_calibration(a, b))


def m22_importance_delta(spark, sf_dir):
    """The two versions' mean importances side by side."""
    t = materialise(importances(spark, sf_dir))
    a, b = (M.importance_over_folds(t.where(w)) for w in ("fold_id < 10", "fold_id > 1"))
    return rounded(M.compare_versions(a, b, "feature", ["mean"]))


def univariate(spark, sf_dir):
    return M.univariate_ics(diagnosed(spark, sf_dir), UNIVARIATE, OUTCOMES)


def m23_univariate(spark, sf_dir):
    return rounded(univariate(spark, sf_dir))


def m24_two_sided_p(spark, sf_dir):
    """Per feature, against the return over 5 rows."""
    d = materialise(diagnosed(spark, sf_dir))
    actual = M.univariate_ics(d, UNIVARIATE, {5: OUTCOMES[5]})
    null = M.permuted_feature_ics(d, UNIVARIATE, OUTCOMES[5], DRAWS, seed=1)
    return rounded(M.permutation_summary(null, actual, two_sided=True, by=["feature"]))


def m25_extremes(spark, sf_dir):
    t = materialise(univariate(spark, sf_dir))
    return rounded(M.extremes(t, 10, True).withColumn("side", F.lit("top")).unionByName(M.extremes(t, 10, False).withColumn("side", F.lit("bottom"))))


def m26_modules(spark, sf_dir):
    modules = P.metadata(spark).select(F.col("name").alias("feature"), "module")
    return M.module_summary(univariate(spark, sf_dir), modules)


def m27_dispersion(spark, sf_dir):
    return rounded(M.dispersion(predictions(spark, sf_dir), "actual_return"))


def m27_eight_numbers(spark, sf_dir):
    return rounded(M.eight_numbers(M.dispersion(predictions(spark, sf_dir), "actual_return"), "std"))


def m30_regime_mix(spark, sf_dir):
    return rounded(M.regime_mix(predictions(spark, sf_dir), "vol_regime", "actual_return"))


QUERIES = {
    f.__name__: f
    for f in (p05_metadata, t05_folds, t05_fold_rows, t10_predictions)
} | {
    "m01_log_loss": _one(lambda p: p.agg(M.log_loss().alias("log_loss"))),
    "m02_auc": _one(lambda p: M.auc(p, ["above"])),
    "m03_average_precision": _one(lambda p: M.average_precision(p, ["above"])),
    "m04_input_checks": _one(M.invalid_inputs),
    "m05_precision_at_top": _one(lambda p: M.precision_at_top(p, 0.2)),
    "m06_recall_at_top": _one(lambda p: M.recall_at_top(p, 0.2)),
    "m07_calibration": _one(M.calibration),
    "m08_daily_rank_ic": m08_daily_rank_ic,
    "m09_ic_summary": _one(lambda p: M.ic_summary(M.information_coefficient(p))),
    "m10_permuted_ics": m10_permuted_ics,
    "m11_permutation_p": m11_permutation_p,
    "m12_bundle": m12_bundle,
    "m13_regime_breakdown": _one(lambda p: M.regime_breakdown(p, "vol_regime")),
    **{
        f.__name__: f
        for f in (
            m14_per_fold, m15_over_folds, m16_regimes_over_folds, m17_importance, m18_pooled_calibration, m19_significance, m20_decision,
            m21_stability, m22_compare, m22_regimes, m22_calibration_gap, m22_importance_delta, m23_univariate, m24_two_sided_p, m25_extremes, m26_modules, m27_dispersion, m27_eight_numbers,
        )
    },
    "m28_prediction_distribution": _one(M.prediction_distribution),
    "m29_top_pick_ranks": _one(lambda p: M.top_pick_ranks(p, 5)),
    "m30_regime_mix": m30_regime_mix,
}

PRED = f"""
pred AS (
  SELECT f.date, f.ticker, l.label, f.p AS predicted_proba, l.y AS actual_return, f.vol_regime, f.above
  FROM (SELECT date, ticker, vol_regime, CAST(dist_sma_20_pct > 0 AS INT) AS above, {percentile_sql('ret_5d')} AS p FROM feats) f
  JOIN (SELECT date, ticker, outperforms_universe_median_5d AS label, forward_ret_5d_demeaned AS y FROM lab) l ON f.date = l.date AND f.ticker = l.ticker
  WHERE label IS NOT NULL AND p IS NOT NULL AND y IS NOT NULL)"""
BASE = (S1, S2, S3, S4, S5, S6, LABELS, PRED)


def q_end(d: str) -> str:
    return f"CAST(last_day(date_trunc('quarter', {d}) + INTERVAL 2 MONTH) AS DATE)"


def q_add(d: str, n: str) -> str:
    m = f"(date_trunc('month', {d}) + INTERVAL (({n}) * 3) MONTH)"
    return f"make_date(year({m}), month({m}), least(day({d}), 28))"


BOUNDS = f"""
fe AS (SELECT min(date) AS first, max(date) AS last FROM bars),
fq AS (SELECT k AS fold_id, first, last, {q_add("DATE '1997-12-31'", 'k')} AS train_q FROM fe, range(0, 400) t(k)),
fv AS (SELECT *, train_q + 6 AS val_t, {q_add(q_end('(train_q + 6)'), '1')} AS val_q FROM fq),
ft AS (SELECT *, val_q + 6 AS test_t, {q_add(q_end('(val_q + 6)'), '0')} AS test_q FROM fv),
fs AS (
  SELECT *, greatest(first, DATE '1995-01-01') AS train_start,
    (SELECT max(date) FROM bars WHERE date <= train_q) AS train_end, (SELECT min(date) FROM bars WHERE date >= val_t) AS val_start,
    (SELECT max(date) FROM bars WHERE date <= val_q) AS val_end, (SELECT min(date) FROM bars WHERE date >= test_t) AS test_start,
    (SELECT max(date) FROM bars WHERE date <= test_q) AS test_end FROM ft),
fb AS (
  SELECT fold_id, train_start, train_end, val_start, val_end, test_start, test_end, test_end < test_q AS test_is_partial
  FROM fs WHERE train_end >= train_start AND val_start IS NOT NULL AND test_start IS NOT NULL AND val_end >= val_start AND test_end >= test_start),
tst AS (SELECT fold_id, pred.* FROM pred JOIN fb ON date BETWEEN test_start AND test_end)"""


def auc_sql(by: str, table: str) -> str:
    return f"""SELECT {by}, CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN
      (sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) END AS auc
      FROM (SELECT *, {rank_sql('predicted_proba', by)} AS rk FROM {table}) GROUP BY {by}"""


def ap_sql(by: str, table: str) -> str:
    return f"""SELECT {by}, sum(label * prec) / sum(label) AS avg_precision FROM (
      SELECT {by}, label, sum(label) OVER w / count(*) OVER w AS prec FROM {table}
      WINDOW w AS (PARTITION BY {by} ORDER BY predicted_proba DESC RANGE UNBOUNDED PRECEDING)) GROUP BY {by}"""


def ic_sql(by: str, table: str, x: str = "predicted_proba", y: str = "actual_return") -> str:
    return f"""SELECT {by}, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM (
      SELECT {by}, {rank_sql(x, by)} AS a, {rank_sql(y, by)} AS b FROM (SELECT * FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)) GROUP BY {by}"""


def summary_sql(source: str, by: str = "") -> str:
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {by + ',' if by else ''} avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, count(*) AS n, avg(ic) / stddev_samp(ic) AS ic_ir,
      avg(ic) * sqrt(count(*)) / stddev_samp(ic) AS ic_t FROM ({source}) WHERE ic IS NOT NULL{group}"""


LOSS = "avg(-ln(CASE WHEN label = 1 THEN greatest(1e-15, least(1 - 1e-15, predicted_proba)) ELSE 1 - greatest(1e-15, least(1 - 1e-15, predicted_proba)) END))"


def bundle_sql(by: str, table: str) -> str:
    return f"""SELECT b.*, auc, avg_precision, ic_mean, ic_std, ic_ir
      FROM (SELECT {by}, count(*) AS n_rows, sum(label) AS n_positive, {LOSS} AS log_loss FROM {table} GROUP BY {by}) b
      JOIN ({auc_sql(by, table)}) USING ({by}) JOIN ({ap_sql(by, table)}) USING ({by})
      LEFT JOIN ({summary_sql(ic_sql(by + ', date', table), by)}) USING ({by})"""


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


BUNDLED = r6("log_loss", "auc", "avg_precision", "ic_mean", "ic_std", "ic_ir")
FOLD_TABLE = f"pf AS ({bundle_sql('fold_id', 'tst')})"


def stats_sql(source: str, metrics: list[str], by: str = "") -> str:
    key = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"""SELECT {key}'{m}' AS metric, round(avg({m}), 6) + 0.0 AS mean, round(stddev_samp({m}), 6) + 0.0 AS std, round(min({m}), 6) + 0.0 AS min,
        round(max({m}), 6) + 0.0 AS max, count({m}) AS n FROM {source}{f' GROUP BY {by}' if by else ''}"""
        for m in metrics
    )


DIAGNOSED = (
    F2.replace("s2)", "feats)"),
    *SCORE,
    f"""dg AS (
  SELECT f.*, {percentile_sql('ret_5d')} AS ret_5d_rank_universe, {percentile_sql('realized_vol_20d')} AS vol_20d_rank_universe,
    {percentile_sql('open_turnover')} AS turnover_rank_universe, {SECTOR_RANK} AS ret_5d_rank_sector,
    CASE WHEN count(*) OVER (PARTITION BY date, sector) > 1 THEN ret_5d - median(ret_5d) OVER (PARTITION BY date, sector) END AS ret_5d_dist_sector_median
  FROM f2 f)""",
    "uf AS (SELECT date, ticker, unnest([" + ", ".join(f"{{'feature': '{u}', 'x': CAST({u} AS DOUBLE)}}" for u in UNIVARIATE)
    + "], recursive := true) FROM dg JOIN ret_5d_z_winsor_c USING (date, ticker))",
    "uh AS (SELECT date, ticker, unnest([" + ", ".join(f"{{'horizon': {h}, 'y': {y}}}" for h, y in OUTCOMES.items()) + "], recursive := true) FROM lab)",
    "ul AS MATERIALIZED (SELECT date, ticker, feature, x, horizon, y FROM uf JOIN uh USING (date, ticker) WHERE x IS NOT NULL AND y IS NOT NULL)",
)
UNI = f"un AS ({summary_sql(ic_sql('feature, horizon, date', 'ul', 'x', 'y'), 'feature, horizon')})"
UNI_OUT = r6("ic_mean", "ic_std", "ic_ir", "ic_t")


def permuted_sql(table: str, by: str = "", seed: int = 0) -> str:
    """CTEs ``pb``, ``pd`` and ``pm``: ranks with their places, the draws, and the mean coefficient of each draw."""
    keys = f"{by}, date" if by else "date"
    return f"""
pb AS MATERIALIZED (
  SELECT {keys}, ticker, {rank_sql('predicted_proba', keys)} AS a, {rank_sql('actual_return', keys)} AS b,
    row_number() OVER (PARTITION BY {keys} ORDER BY ticker) AS i FROM {table}),
pd AS (
  SELECT {keys}, draw, a, row_number() OVER (PARTITION BY {keys}, draw ORDER BY md5(concat_ws('|', '{seed}', draw, date, ticker)), ticker) AS i
  FROM pb, range(1, {DRAWS + 1}) r(draw)),
pm AS (
  SELECT {by + ',' if by else ''} draw, avg(ic) AS ic_mean FROM (
    SELECT {keys}, draw, CASE WHEN count(*) >= 3 AND stddev_pop(pd.a) > 0 AND stddev_pop(b) > 0 THEN corr(pd.a, b) END AS ic
    FROM pd JOIN pb USING ({keys}, i) GROUP BY {keys}, draw) GROUP BY {by + ',' if by else ''} draw)"""


CAL = "least(CAST(floor(predicted_proba * 10) AS INT), 9)"


def sql(*ctes: str, select: str) -> str:
    return with_bars(*BASE, *ctes, select=select)


ORACLE_SQL = {
    "t05_folds": with_bars(BOUNDS.split("tst AS")[0].rstrip().rstrip(","), select="SELECT * FROM fb"),
    "t05_fold_rows": with_bars(
        BOUNDS.split("tst AS")[0].rstrip().rstrip(","),
        select="""SELECT fold_id, role, count(*) AS n, min(date) AS first, max(date) AS last FROM (
          SELECT fold_id, 'train' AS role, train_start AS lo, train_end AS hi FROM fb UNION ALL SELECT fold_id, 'val', val_start, val_end FROM fb
          UNION ALL SELECT fold_id, 'test', test_start, test_end FROM fb) JOIN bars ON date BETWEEN lo AND hi GROUP BY 1, 2""",
    ),
    "t10_predictions": sql(select=f"SELECT date, ticker, label, {r6('predicted_proba', 'actual_return')} FROM pred"),
    "m01_log_loss": sql(select=f"SELECT round({LOSS}, 6) + 0.0 AS log_loss FROM pred"),
    "m02_auc": sql(select=f"SELECT above, {r6('auc')} FROM ({auc_sql('above', 'pred')})"),
    "m03_average_precision": sql(select=f"SELECT above, {r6('avg_precision')} FROM ({ap_sql('above', 'pred')})"),
    "m04_input_checks": sql(
        select="""SELECT count(*) AS n, count(*) FILTER (WHERE label NOT IN (0, 1)) AS n_not_binary,
        count(*) FILTER (WHERE NOT predicted_proba BETWEEN 0 AND 1) AS n_bad_probability FROM pred"""
    ),
    "m05_precision_at_top": sql(
        select="""SELECT round(avg(p), 6) + 0.0 AS precision_at_top, count(*) AS n_dates FROM (SELECT date, avg(label) AS p FROM (
        SELECT *, row_number() OVER (PARTITION BY date ORDER BY predicted_proba DESC, ticker) AS r, floor(count(*) OVER (PARTITION BY date) * 0.2) AS k FROM pred) WHERE r <= k GROUP BY date)"""
    ),
    "m06_recall_at_top": sql(
        select="""SELECT round(avg(h / a), 6) + 0.0 AS recall_at_top, count(*) AS n_dates FROM (SELECT date, sum(CASE WHEN r <= k THEN label ELSE 0 END) AS h, sum(label) AS a FROM (
        SELECT *, row_number() OVER (PARTITION BY date ORDER BY predicted_proba DESC, ticker) AS r, floor(count(*) OVER (PARTITION BY date) * 0.2) AS k FROM pred) GROUP BY date HAVING sum(label) > 0)"""
    ),
    "m07_calibration": sql(
        select=f"""SELECT CAST(b AS INT) AS bucket, count(label) AS n, round(avg(predicted_proba), 6) + 0.0 AS mean_predicted, round(avg(label), 6) + 0.0 AS mean_label
        FROM range(10) t(b) LEFT JOIN pred ON {CAL} = b GROUP BY b"""
    ),
    "m08_daily_rank_ic": sql(select=f"SELECT date, {r6('ic')} FROM ({ic_sql('date', 'pred')})"),
    "m09_ic_summary": sql(select=f"SELECT n, {UNI_OUT} FROM ({summary_sql(ic_sql('date', 'pred'))})"),
    "m12_bundle": sql("al AS (SELECT 'all' AS series, * FROM pred)", select=f"SELECT series, n_rows, n_positive, {BUNDLED} FROM ({bundle_sql('series', 'al')})"),
    "m13_regime_breakdown": sql(
        "vr AS (SELECT * FROM pred WHERE vol_regime IS NOT NULL)",
        select=f"SELECT CAST(vol_regime AS INT) AS vol_regime, n_rows, n_positive, {BUNDLED} FROM ({bundle_sql('vol_regime', 'vr')}) WHERE n_rows >= 50",
    ),
    "m14_per_fold": sql(BOUNDS, FOLD_TABLE, select=f"SELECT fold_id, n_rows, n_positive, {BUNDLED} FROM pf"),
    "m15_over_folds": sql(BOUNDS, FOLD_TABLE, select=stats_sql("pf", ["log_loss", "auc", "ic_mean"])),
    "m16_regimes_over_folds": sql(
        BOUNDS, "ra AS (SELECT *, fold_id * 2 + above AS g FROM tst)", f"rb AS ({bundle_sql('g', 'ra')})", "rc AS (SELECT *, CAST(g % 2 AS INT) AS above FROM rb)",
        select=stats_sql("rc", ["auc", "ic_mean"], "above"),
    ),
    "m17_importance": sql(
        *DIAGNOSED, BOUNDS, "uff AS (SELECT fold_id, ul.* FROM ul JOIN fb ON date BETWEEN test_start AND test_end WHERE horizon = 5)",
        f"im AS (SELECT fold_id, feature, abs(avg(ic)) AS importance FROM ({ic_sql('feature, fold_id, date', 'uff', 'x', 'y')}) GROUP BY 1, 2)",
        "ims AS (SELECT feature, avg(importance) AS mean, stddev_samp(importance) AS std, count(DISTINCT fold_id) AS n_folds FROM im GROUP BY 1)",
        select="SELECT feature, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, n_folds, round(mean / sum(mean) OVER (), 6) + 0.0 AS share FROM ims",
    ),
    "m18_pooled_calibration": sql(
        BOUNDS,
        select=f"""SELECT CAST(b AS INT) AS bucket, count(label) AS n, round(avg(predicted_proba), 6) + 0.0 AS mean_predicted, round(avg(label), 6) + 0.0 AS mean_label
        FROM range(10) t(b) LEFT JOIN tst ON {CAL} = b GROUP BY b""",
    ),
    "p05_metadata": sql(
        *DIAGNOSED[:-2],
        "md(name, module, source, lookback, mask_on_special) AS (VALUES " + ", ".join(f"('{n}', '{m}', '{s}', {k}, {str(x).lower()})" for n, m, s, k, x in P.METADATA) + ")",
        "cv AS (SELECT feature AS name, count(*) AS n_valid, min(date) AS first_valid FROM uf WHERE x IS NOT NULL GROUP BY 1)",
        select="SELECT md.*, n_valid, first_valid FROM md LEFT JOIN cv USING (name)",
    ),
    "m10_permuted_ics": sql(permuted_sql("pred"), select=f"SELECT CAST(draw AS INT) AS draw, {r6('ic_mean')} FROM pm"),
    "m11_permutation_p": sql(
        permuted_sql("pred"), f"ac AS ({summary_sql(ic_sql('date', 'pred'))})",
        select="""SELECT round(avg(CAST(pm.ic_mean >= ac.ic_mean AS INT)), 6) + 0.0 AS p_value, round(avg(pm.ic_mean), 6) + 0.0 AS null_mean,
        round(stddev_samp(pm.ic_mean), 6) + 0.0 AS null_std FROM pm, ac""",
    ),
    "m19_significance": sql(
        BOUNDS, permuted_sql("tst", "fold_id"), f"ac AS ({summary_sql(ic_sql('fold_id, date', 'tst'), 'fold_id')})",
        "pv AS (SELECT fold_id, avg(CAST(pm.ic_mean >= ac.ic_mean AS INT)) AS p FROM pm JOIN ac USING (fold_id) GROUP BY fold_id)",
        select="""SELECT count(*) FILTER (WHERE p < 0.05) AS n_p05, count(*) FILTER (WHERE p < 0.10) AS n_p10, round(median(p), 6) + 0.0 AS median_p,
        round(min(p), 6) + 0.0 AS min_p, round(max(p), 6) + 0.0 AS max_p, count(p) AS n_folds FROM pv""",
    ),
    "m20_decision": sql(
        BOUNDS, FOLD_TABLE, permuted_sql("tst", "fold_id"), f"ac AS ({summary_sql(ic_sql('fold_id, date', 'tst'), 'fold_id')})",
        "pv AS (SELECT fold_id, avg(CAST(pm.ic_mean >= ac.ic_mean AS INT)) AS p FROM pm JOIN ac USING (fold_id) GROUP BY fold_id)",
        "dc AS (SELECT avg(auc) AS auc, avg(ic_mean) AS ic, (SELECT avg(CAST(p < 0.10 AS INT)) FROM pv) AS share FROM pf)",
        select="""SELECT round(auc, 6) + 0.0 AS auc, round(ic, 6) + 0.0 AS ic, round(share, 6) + 0.0 AS share_p10, auc >= 0.52 AND ic >= 0.02 AS reaches_least,
        auc >= 0.55 AND ic >= 0.04 AS ideal, coalesce(share = 1, FALSE) AS beats_chance, auc >= 0.52 AND ic >= 0.02 AND coalesce(share = 1, FALSE) AS passes FROM dc""",
    ),
    "m21_stability": sql(
        BOUNDS, FOLD_TABLE,
        select="""SELECT fold_id, round(CASE WHEN count(ic_mean) OVER w = 4 THEN avg(ic_mean) OVER w END, 6) + 0.0 AS rolling_mean,
        round(CASE WHEN count(ic_mean) OVER w = 4 THEN stddev_samp(ic_mean) OVER w END, 6) + 0.0 AS rolling_std,
        round((SELECT avg(CAST(sign(ic_mean) = (SELECT sign(avg(ic_mean)) FROM pf) AS INT)) FROM pf), 6) + 0.0 AS same_sign
        FROM pf WINDOW w AS (ORDER BY fold_id ROWS 3 PRECEDING)""",
    ),
    "m22_compare": sql(
        BOUNDS, FOLD_TABLE,
        select="""SELECT coalesce(a.fold_id, b.fold_id) AS fold_id, round(a.auc, 6) + 0.0 AS auc_a, round(a.ic_mean, 6) + 0.0 AS ic_mean_a, round(b.auc, 6) + 0.0 AS auc_b,
        round(b.ic_mean, 6) + 0.0 AS ic_mean_b, round(b.auc - a.auc, 6) + 0.0 AS auc_delta, round(b.ic_mean - a.ic_mean, 6) + 0.0 AS ic_mean_delta
        FROM (SELECT * FROM pf WHERE fold_id < 10) a FULL JOIN (SELECT * FROM pf WHERE fold_id > 1) b ON a.fold_id = b.fold_id""",
    ),
    "m22_regimes": sql(
        BOUNDS, "va AS (SELECT * FROM tst WHERE fold_id < 10 AND vol_regime IS NOT NULL)", "vb AS (SELECT * FROM tst WHERE fold_id > 1 AND vol_regime IS NOT NULL)",
        f"ba AS ({bundle_sql('vol_regime', 'va')})", f"bb AS ({bundle_sql('vol_regime', 'vb')})",
        select="""SELECT CAST(coalesce(a.vol_regime, b.vol_regime) AS INT) AS vol_regime, round(a.auc, 6) + 0.0 AS auc_a, round(a.ic_mean, 6) + 0.0 AS ic_mean_a, round(b.auc, 6) + 0.0 AS auc_b,
        round(b.ic_mean, 6) + 0.0 AS ic_mean_b, round(b.auc - a.auc, 6) + 0.0 AS auc_delta, round(b.ic_mean - a.ic_mean, 6) + 0.0 AS ic_mean_delta
        FROM ba a FULL JOIN bb b ON a.vol_regime = b.vol_regime""",
    ),
    "m22_calibration_gap": sql(
        BOUNDS, f"cg AS (SELECT fold_id, {CAL} AS bucket, label, predicted_proba FROM tst)",
        *(f"g{v} AS (SELECT bucket, count(*) AS n, avg(label) - avg(predicted_proba) AS gap FROM cg WHERE fold_id {w} GROUP BY 1)" for v, w in (("a", "< 10"), ("b", "> 1"))),
        select="""SELECT CAST(t.b AS INT) AS bucket, coalesce(ga.n, 0) AS n_a, round(ga.gap, 6) + 0.0 AS gap_a, coalesce(gb.n, 0) AS n_b, round(gb.gap, 6) + 0.0 AS gap_b,
        round(abs(ga.gap) - abs(gb.gap), 6) + 0.0 AS gap_reduced FROM range(10) t(b) LEFT JOIN ga ON ga.bucket = t.b LEFT JOIN gb ON gb.bucket = t.b""",
    ),
    "m22_importance_delta": sql(
        *DIAGNOSED, BOUNDS, "uff AS (SELECT fold_id, ul.* FROM ul JOIN fb ON date BETWEEN test_start AND test_end WHERE horizon = 5)",
        f"im AS MATERIALIZED (SELECT fold_id, feature, abs(avg(ic)) AS importance FROM ({ic_sql('feature, fold_id, date', 'uff', 'x', 'y')}) GROUP BY 1, 2)",
        "ia AS (SELECT feature, avg(importance) AS m FROM im WHERE fold_id < 10 GROUP BY 1)", "ib AS (SELECT feature, avg(importance) AS m FROM im WHERE fold_id > 1 GROUP BY 1)",
        select="""SELECT coalesce(ia.feature, ib.feature) AS feature, round(ia.m, 6) + 0.0 AS mean_a, round(ib.m, 6) + 0.0 AS mean_b, round(ib.m - ia.m, 6) + 0.0 AS mean_delta
        FROM ia FULL JOIN ib ON ia.feature = ib.feature""",
    ),
    "m23_univariate": sql(*DIAGNOSED, UNI, select=f"SELECT feature, CAST(horizon AS INT) AS horizon, n, {UNI_OUT} FROM un"),
    "m25_extremes": sql(
        *DIAGNOSED, UNI.replace("un AS (", "un AS MATERIALIZED ("),
        select=f"""SELECT side, feature, CAST(horizon AS INT) AS horizon, n, {UNI_OUT} FROM (
          SELECT 'top' AS side, *, row_number() OVER (PARTITION BY horizon ORDER BY round(ic_ir, 9) DESC NULLS LAST, feature) AS place FROM un UNION ALL
          SELECT 'bottom', *, row_number() OVER (PARTITION BY horizon ORDER BY round(ic_ir, 9) NULLS LAST, feature) FROM un) WHERE place <= 10""",
    ),
    "m26_modules": sql(
        *DIAGNOSED, UNI, "md(feature, module) AS (VALUES " + ", ".join(f"('{m[0]}', '{m[1]}')" for m in P.METADATA) + ")",
        select="""SELECT CAST(horizon AS INT) AS horizon, module, count(*) AS n, count(*) FILTER (WHERE abs(ic_ir) > 3) AS n_too_good,
        arg_max(feature, row(round(ic_ir, 9), feature)) AS best, arg_min(feature, row(round(ic_ir, 9), feature)) AS worst FROM un JOIN md USING (feature) GROUP BY 1, 2""",
    ),
    "m27_dispersion": sql(
        """dp AS (SELECT date, count(*) AS n, stddev_samp(actual_return) AS std, quantile_cont(actual_return, 0.9) - quantile_cont(actual_return, 0.1) AS p10_p90,
        quantile_cont(actual_return, 0.75) - quantile_cont(actual_return, 0.25) AS p25_p75, max(actual_return) - min(actual_return) AS "range" FROM pred GROUP BY date HAVING count(*) >= 5)""",
        select='SELECT date, n, ' + r6("std", "p10_p90", "p25_p75") + ', round("range", 6) + 0.0 AS "range" FROM dp',
    ),
    "m27_eight_numbers": sql(
        "dp AS (SELECT stddev_samp(actual_return) AS s FROM pred GROUP BY date HAVING count(*) >= 5)",
        select="""SELECT count(s) AS n, round(avg(s), 6) + 0.0 AS mean, round(stddev_samp(s), 6) + 0.0 AS std, round(min(s), 6) + 0.0 AS min, round(quantile_cont(s, 0.25), 6) + 0.0 AS p25,
        round(quantile_cont(s, 0.5), 6) + 0.0 AS p50, round(quantile_cont(s, 0.75), 6) + 0.0 AS p75, round(max(s), 6) + 0.0 AS max FROM dp""",
    ),
    "m28_prediction_distribution": sql(
        select="""SELECT count(*) AS n, round(avg(p), 6) + 0.0 AS mean, round(stddev_samp(p), 6) + 0.0 AS std, round(avg(CAST(p < 0.3 AS INT)), 6) + 0.0 AS share_low,
        round(avg(CAST(p > 0.7 AS INT)), 6) + 0.0 AS share_high, """
        + ", ".join(f"count(*) FILTER (WHERE p >= CAST({i / 10} AS DOUBLE) AND {f'p < CAST({(i + 1) / 10} AS DOUBLE)' if i < 8 else 'p <= 1'}) AS bin_{i}" for i in range(9))
        + " FROM (SELECT predicted_proba AS p FROM pred)"
    ),
    "m29_top_pick_ranks": sql(
        """pk AS (SELECT (row_number() OVER (PARTITION BY date ORDER BY actual_return, ticker) - 1) / (count(*) OVER (PARTITION BY date) - 1) AS pct,
        row_number() OVER (PARTITION BY date ORDER BY predicted_proba DESC, ticker) AS rp FROM pred)""",
        select="SELECT round(avg(pct), 6) + 0.0 AS mean_percentile, " + ", ".join(f"round(avg(CAST(least(floor(pct * 5), 4) = {i} AS INT)), 6) + 0.0 AS fifth_{i}" for i in range(5)) + " FROM pk WHERE rp <= 5",
    ),
    "m30_regime_mix": sql(
        select="""SELECT CAST(vol_regime AS INT) AS vol_regime, count(*) AS n, round(avg(actual_return), 6) + 0.0 AS mean_level, round(max(actual_return), 6) + 0.0 AS max_level,
        round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM pred WHERE vol_regime IS NOT NULL GROUP BY vol_regime"""
    ),
}
