"""Queries of ingestion, data quality, calendars, daily state, model fitting and the streaming append."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.features import per_ticker
from ..operators import calendar as C
from ..operators import labels as L
from ..operators import state as D
from ..operators import training as T
from ..operators import validation as V
from ..operators import folds as W
from ..operators import metrics as M
from ..operators.folds import add_quarters, quarter_end
from ..operators.pipeline import METADATA
from ..sources import bars as S
from ..sources.scratch import materialise, new_folder
from ..streaming.append import append_bars, bar_stream, finish_windows
from .feature_queries import S1, S2, S3, S4, S5, S6
from .market_queries import NO_SPECIAL, everything, special_sessions
from .metric_queries import FOLDS, q_add, q_end
from .panel import bars, bars_once, market_index, read, rounded, with_bars
from .portfolio_queries import PICKS, SCHEDULE, SCORES, SERIES, START, picked, scores, series

SHORT = ["date", "ticker", "open", "high", "low", "close", "volume", "adj_close"]


def o03_normalise(spark, sf_dir):
    """Events as a vendor's frame: odd names, no adjusted close, some prices missing."""
    e = read(spark, sf_dir, "events").select(
        F.col("ts").alias("Datetime"), F.col("event_type").alias("Symbol"), F.col("value").alias("Open"), (F.col("value") + 1).alias("High"),
        F.when(F.col("event_id") % 7 != 0, F.col("value") - 1).alias("Low"), F.col("value").alias("Close"), F.col("event_id").alias("Volume"),
    )
    return rounded(S.normalise(e))


def loads(spark, sf_dir):
    panel = bars(spark, sf_dir).select(SHORT)
    old = panel.where("date < '2001-01-01'")
    return old, panel.where("date >= '2000-06-01'").withColumn("close", F.col("close") + 1)


def o04_upsert(spark, sf_dir):
    return rounded(S.upsert(*loads(spark, sf_dir)))


def o05_upsert_index(spark, sf_dir):
    i = market_index(bars(spark, sf_dir))
    return rounded(S.upsert(i.where("date < '2001-01-01'"), i.where("date >= '2000-06-01'").withColumn("index_close", F.col("index_close") + 1), ["date"]))


def o06_enforce(spark, sf_dir):
    return rounded(S.enforce(bars(spark, sf_dir)))


def o07_coverage(spark, sf_dir):
    return S.coverage(bars(spark, sf_dir))


def o08_watermarks(spark, sf_dir):
    panel = bars(spark, sf_dir)
    return S.watermarks(panel.where("date < '2001-06-01' AND ticker <> 'NATION_3'"), panel.select("ticker"), "2001-06-01", "1995-01-02")


def o09_sql_bars(spark, sf_dir):
    return rounded(S.query(spark, "SELECT ticker, avg(close) AS mean_close, sum(volume) AS volume FROM ohlcv WHERE date >= DATE'1999-01-01' GROUP BY ticker", ohlcv=bars(spark, sf_dir)))


def o10_sql_features(spark, sf_dir):
    f = per_ticker(bars(spark, sf_dir), ["ret_5d", "realized_vol_20d"])
    return rounded(S.query(spark, "SELECT date, avg(ret_5d) AS mean_ret, max(realized_vol_20d) AS max_vol FROM per_ticker GROUP BY date", per_ticker=f))


def o11_sql_labels(spark, sf_dir):
    y = L.forward_labels(bars(spark, sf_dir), [5])
    return S.query(spark, "SELECT ticker, sum(outperforms_universe_median_5d) AS wins, count(forward_ret_5d) AS n FROM labels GROUP BY ticker", labels=y)


def o12_feature_table(spark, sf_dir):
    """Written by ticker and read back."""
    path = new_folder(spark)
    S.write_table(per_ticker(bars(spark, sf_dir), ["ret_5d", "vol_ratio_20d"]), path, 2)
    return rounded(S.read_table(spark, path, 2).select("date", "ticker", "ret_5d", "vol_ratio_20d"))


def o13_label_table(spark, sf_dir):
    path = new_folder(spark)
    S.write_table(L.forward_labels(bars(spark, sf_dir), [5]).select("date", "ticker", "forward_ret_5d"), path)
    return rounded(S.read_table(spark, path).select("date", "ticker", "forward_ret_5d"))


def o14_csv(spark, sf_dir):
    path = new_folder(spark)
    S.write_csv(series(spark, sf_dir).where("series = 'index'").select("date", F.round("total_value", 3).alias("total_value")), path)
    return S.read_values_csv(spark, path)


def o15_json(spark, sf_dir):
    path = new_folder(spark)
    S.write_json(S.coverage(bars(spark, sf_dir)), path)
    return spark.read.schema("ticker string, first_date date, last_date date, n_rows long").json(path)


def broken(spark, sf_dir, panel=None):
    """Bars with rules broken where the day of the month says so, and some keys twice."""
    d = F.dayofmonth("date")
    b = (bars(spark, sf_dir) if panel is None else panel).select(SHORT)
    b = b.withColumns(
        {
            "open": F.when(d == 1, -F.col("open")).otherwise(F.col("open")),
            "high": F.when(d == 2, F.col("low") - 1).otherwise(F.col("high")),
            "low": F.when(d == 3, F.col("high") + 1).otherwise(F.col("low")),
            "volume": F.when(d == 4, 0).when(d == 5, -1).otherwise(F.col("volume")),
            "close": F.when(d == 6, F.col("close") * 3).otherwise(F.col("close")),
        }
    )
    return b.unionByName(b.where(d == 7))


def _rule(name):
    return lambda spark, sf_dir: V.validate(broken(spark, sf_dir), "2001-06-30").where(F.col("rule") == name)


def v01_missing_columns(spark, sf_dir):
    return V.validate(bars(spark, sf_dir).drop("volume", "adj_close"), "2001-06-30")


def v_all_rules(spark, sf_dir):
    return V.validate(broken(spark, sf_dir), "2001-06-30")


def v11_store(spark, sf_dir):
    return V.validate_store(broken(spark, sf_dir).where("ticker < 'NATION_2'").unionByName(bars(spark, sf_dir).select(SHORT).where("ticker >= 'NATION_2'")), "2001-12-31")


def days(spark, sf_dir):
    return C.spine(bars(spark, sf_dir))


def odd_dates(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()


def c01_spine(spark, sf_dir):
    return days(spark, sf_dir)


def c02_window(spark, sf_dir):
    return C.within(days(spark, sf_dir), "1996-01-01", "1996-12-31")


def c03_regular_days(spark, sf_dir):
    return C.regular(days(spark, sf_dir), special_sessions(bars(spark, sf_dir)))


def c04_special_flag(spark, sf_dir):
    return C.flagged(days(spark, sf_dir), special_sessions(bars(spark, sf_dir)))


def c05_neighbours(spark, sf_dir):
    return C.neighbours(odd_dates(spark, sf_dir), days(spark, sf_dir))


def c06_schedule(spark, sf_dir):
    from ..operators.portfolio import schedule

    return schedule(days(spark, sf_dir), 4, START)


def c07_statistics(spark, sf_dir):
    return C.statistics(days(spark, sf_dir), special_sessions(bars(spark, sf_dir)))


def c08_date_range(spark, sf_dir):
    return C.date_range(days(spark, sf_dir).agg(F.min("date").alias("first"), F.max("date").alias("last")))


def c09_projection(spark, sf_dir):
    return C.project_weekdays(days(spark, sf_dir), special_sessions(bars(spark, sf_dir)), 20)


def c10_snap(spark, sf_dir):
    return C.snapped(odd_dates(spark, sf_dir), days(spark, sf_dir))


def c11_quarters(spark, sf_dir):
    d = F.col("date")
    return days(spark, sf_dir).select("date", quarter_end(d).alias("quarter_end"), add_quarters(quarter_end(d), F.lit(3)).alias("three_on"))


def runs(spark, sf_dir):
    """A ledger over the dates: the day of the month decides the status."""
    n = F.dayofmonth("date")
    status = F.when(n % 11 == 0, "HOLIDAY").when(n % 7 == 0, "FAILED").otherwise("SUCCESS")
    return days(spark, sf_dir).select(F.col("date").alias("run_date"), status.alias("status"), F.lit("live").alias("source"))


def d04_latest(spark, sf_dir):
    return rounded(D.latest_by(bars(spark, sf_dir).select("date", "ticker", "close"), "date"))


def d05_runs_between(spark, sf_dir):
    return D.runs_between(runs(spark, sf_dir), "1999-01-01", "1999-12-31")


def positions(spark, sf_dir):
    p = picked(spark, sf_dir)
    return D.latest_by(p, "date").select("ticker", F.col("date").alias("entry_date"))


def d06_cadence(spark, sf_dir):
    return D.cadence(positions(spark, sf_dir), runs(spark, sf_dir), "2001-08-20", 10)


def labelled(spark, sf_dir):
    panel = bars(spark, sf_dir)
    f = per_ticker(panel, ["vol_regime", "dist_sma_20_pct"]).select("date", "ticker", "vol_regime", (F.col("dist_sma_20_pct") > 0).cast("int").alias("above"))
    return D.regime_inputs(f, market_index(panel))


def d07_regime_label(spark, sf_dir):
    return labelled(spark, sf_dir).select("date", D.regime_label(F.col("vol_regime"), F.col("above"), F.col("ret60")).alias("label"))


def d08_regime_inputs(spark, sf_dir):
    return rounded(labelled(spark, sf_dir))


def d09_picks(spark, sf_dir):
    return picked(spark, sf_dir).select("date", "ticker", "rank")


def d11_freshness(spark, sf_dir):
    return runs(spark, sf_dir).agg(F.max("run_date").alias("run_date"), F.max_by("status", "run_date").alias("status"))


def d12_value_curve(spark, sf_dir):
    s = series(spark, sf_dir)
    return rounded(D.value_curve(s.where("date < '2000-01-01'"), s.where("date >= '1999-06-01'")), 3)


def d13_basket(spark, sf_dir):
    return D.todays_basket(positions(spark, sf_dir), picked(spark, sf_dir, 3)).select("ticker", "entry_date", "rank")


def d14_timing(spark, sf_dir):
    last = picked(spark, sf_dir).agg(F.max("date").alias("date"))
    since = last.join(runs(spark, sf_dir), F.col("run_date") > F.col("date"), "left").groupBy("date").agg(F.count("run_date").alias("runs_since"))
    return since.join(C.project_weekdays(last, special_sessions(bars(spark, sf_dir)), 20), "date")


def d15_last_window(spark, sf_dir):
    return rounded(D.last_window(picked(spark, sf_dir), series(spark, sf_dir)))


def d16_rank_movement(spark, sf_dir):
    return D.rank_movement(scores(bars(spark, sf_dir)), "2001-06-04")


def d17_chart_window(spark, sf_dir):
    return rounded(D.chart_window(series(spark, sf_dir), 182), 3)


LABEL = "outperforms_universe_median_5d"
#: What models learn from: all features of the assembled table, and the day of the week.
MODEL = [*(name for name, *_ in METADATA), "day_of_week"]


def fold_data(spark, sf_dir):
    """The labelled rows with all features as a vector, written once, and the folds (one row each) with windows in them."""
    panel = bars_once(spark, sf_dir)
    labels = L.forward_labels(panel, [5]).select("date", "ticker", LABEL)
    rows = everything(panel).withColumn("day_of_week", F.weekday("date")).join(labels, ["date", "ticker"])
    rows = T.prepared(rows, MODEL, LABEL)
    spans = W.fold_bounds(panel, **FOLDS).orderBy("fold_id").collect()
    ends = rows.agg(F.min("date"), F.max("date")).first()
    return rows, [f for f in spans if ends[0] is not None and ends[0] <= f["train_end"] and f["val_start"] <= ends[1]]


def t06_fit_predict(spark, sf_dir):
    """Predictions of each fold's test window by its own model, which stops early on its validation window."""

    def work(fold, rows):
        return T.predict(T.fit(rows), rows.where("role = 'test'"), ["date", "ticker"])

    return T.per_fold(*fold_data(spark, sf_dir), work)


def t07_t11_saved_model(spark, sf_dir):
    """Test predictions of the model of the last fold that has labelled test rows, saved and loaded again (T-11)."""
    rows, spans = fold_data(spark, sf_dir)
    last = rows.agg(F.max("date")).first()[0]
    fold = next(f for f in reversed(spans) if f["test_start"] <= last)
    windows, path = T.of_fold(rows, fold), new_folder(spark)
    T.save(T.fit(windows), path, MODEL, label=LABEL, fold=fold.asDict())
    return T.predict(T.load(path)[0], windows.where("role = 'test'"), ["date", "ticker"])


def t08_search(spark, sf_dir):
    """Every trial of the adaptive search on each fold: 20 settings in three rounds, the best quarter of each with more trees."""
    return T.search(*fold_data(spark, sf_dir), new_folder(spark), draws=(8, 6, 6))


def t09_importance(spark, sf_dir):
    """Importances of each fold's model."""
    return T.per_fold(*fold_data(spark, sf_dir), lambda fold, rows: T.importances(T.fit(rows), MODEL, spark))


def m17_model_importance(spark, sf_dir):
    """The importances of the fitted models over folds: mean, deviation, folds and share of each feature."""
    return M.importance_over_folds(t09_importance(spark, sf_dir))


def streaming_append(spark, sf_dir):
    """Two loads arrive as files and are upserted by the stream; the table equals the upsert of both."""
    folder = new_folder(spark)
    old, new = loads(spark, sf_dir)
    S.enforce(old).write.parquet(f"{folder}/in/a")
    stream = lambda name: append_bars(bar_stream(spark, f"{folder}/in/{name}"), f"{folder}/table", f"{folder}/log-{name}")
    stream("a").awaitTermination()
    S.enforce(new).write.parquet(f"{folder}/in/b")
    stream("b").awaitTermination()
    return rounded(spark.read.schema(S.BARS).parquet(f"{folder}/table"))


#: Days of events in an arrival, and the last of them; ids that arrive one too late, and ids that are sent twice.
DAYS_A_LOAD, LAST_LOAD, TARDY, TWICE = 8, 3, 50, 7


def arrivals(spark, sf_dir):
    """Events with the load they arrive in: some days each, some events a load late and some twice."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    first = e.agg(F.to_date(F.min("ts")).alias("first"))
    day = F.datediff(F.to_date("ts"), F.col("first"))
    load = F.least(F.lit(LAST_LOAD), F.floor(day / DAYS_A_LOAD)) + F.when(F.col("event_id") % TARDY == 0, 1).otherwise(0)
    e = e.join(F.broadcast(first)).withColumn("load", load.cast("int")).drop("first")
    return e.unionByName(e.where(F.col("event_id") % TWICE == 0))


def streamed(spark, sf_dir):
    """The table of complete windows after all loads, each taken in by a run of its own, and what each run took."""
    folder, taken = new_folder(spark), []
    e = materialise(arrivals(spark, sf_dir))
    for load in range(LAST_LOAD + 2):
        e.where(F.col("load") == load).drop("load").write.parquet(f"{folder}/in/load-{load}")
        stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(f"{folder}/in/*")
        taken.append(finish_windows(stream, f"{folder}/out", f"{folder}/log"))
    return spark.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{folder}/out"), taken


def streaming_windows(spark, sf_dir):
    """Hourly counts of events of the windows that are complete, without late rows and copies."""
    return rounded(streamed(spark, sf_dir)[0], 3)


def streaming_late_rows(spark, sf_dir):
    """load, rows, late: what each run took in, and what it dropped as behind the watermark."""
    return spark.createDataFrame([(i, t.rows, t.late) for i, t in enumerate(streamed(spark, sf_dir)[1])], "load int, rows long, late long")


QUERIES = {
    f.__name__: f
    for f in (
        o03_normalise, o04_upsert, o05_upsert_index, o06_enforce, o07_coverage, o08_watermarks, o09_sql_bars, o10_sql_features,
        o11_sql_labels, o12_feature_table, o13_label_table, o14_csv, o15_json, v01_missing_columns, v_all_rules, v11_store, c01_spine, c02_window,
        c03_regular_days, c04_special_flag, c05_neighbours, c06_schedule, c07_statistics, c08_date_range, c09_projection, c10_snap, c11_quarters,
        d04_latest, d05_runs_between, d06_cadence, d07_regime_label, d08_regime_inputs, d09_picks,
        d11_freshness, d12_value_curve, d13_basket, d14_timing, d15_last_window, d16_rank_movement, d17_chart_window, t06_fit_predict,
        t07_t11_saved_model, t08_search, t09_importance, m17_model_importance, streaming_append, streaming_windows, streaming_late_rows,
    )
}

RULES = {
    "v02_price_non_positive": ("price.non_positive", "least(open, high, low, close) <= 0"),
    "v03_volume_negative": ("volume.negative", "volume < 0"),
    "v04_high_below_low": ("ohlc.high_lt_low", "high < low"),
    "v05_high_below_body": ("ohlc.high_lt_open_or_close", "high < open OR high < close"),
    "v06_low_above_body": ("ohlc.low_gt_open_or_close", "low > open OR low > close"),
    "v08_future_date": ("date.future", "date > DATE '2001-06-30'"),
    "v09_volume_zero": ("volume.zero", "volume = 0"),
    "v10_return_anomaly": ("return.anomaly", "abs(close / nullif(before, 0) - 1) > 0.5"),
}
QUERIES |= {name: _rule(rule) for name, (rule, _) in RULES.items()} | {"v07_duplicates": _rule("uniqueness.duplicates")}

BROKEN = """
b0 AS (SELECT date, ticker, CASE WHEN day(date) = 1 THEN -open ELSE open END AS open, CASE WHEN day(date) = 2 THEN low - 1 ELSE high END AS high,
  CASE WHEN day(date) = 3 THEN (CASE WHEN day(date) = 2 THEN low - 1 ELSE high END) + 1 ELSE low END AS low, CASE WHEN day(date) = 6 THEN close * 3 ELSE close END AS close,
  CASE WHEN day(date) = 4 THEN 0 WHEN day(date) = 5 THEN -1 ELSE volume END AS volume FROM bars),
bb AS (SELECT * FROM b0 UNION ALL SELECT * FROM b0 WHERE day(date) = 7),
bk AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS before FROM bb)"""


def _severity(rule: str) -> str:
    return "warning" if rule in ("volume.zero", "return.anomaly") else "error"


def _count(rule: str, where: str) -> str:
    return f"SELECT * FROM (SELECT '{rule}' AS rule, '{_severity(rule)}' AS severity, count(*) AS n FROM bk WHERE {where}) WHERE n > 0"


DUPLICATES = "SELECT * FROM (SELECT 'uniqueness.duplicates' AS rule, 'error' AS severity, count(*) AS n FROM (SELECT 1 FROM bb GROUP BY date, ticker HAVING count(*) > 1)) WHERE n > 0"
FAILED = """
good AS (SELECT ticker, max(CAST(least(open, high, low, close) <= 0 OR volume < 0 OR high < low OR high < open OR high < close OR low > open OR low > close OR date > DATE '2001-12-31' OR day(date) = 7 AS INT)) AS bad,
  max(CAST(volume = 0 OR coalesce(abs(close / nullif(before, 0) - 1) > 0.5, FALSE) AS INT)) AS warn FROM bk WHERE ticker < 'NATION_2' GROUP BY ticker
  UNION ALL SELECT ticker, 0, max(CAST(coalesce(abs(close / b - 1) > 0.5, FALSE) OR volume = 0 AS INT)) FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS b FROM bars) WHERE ticker >= 'NATION_2' GROUP BY ticker)"""
DAYS = "dy AS (SELECT DISTINCT date FROM bars)"
SPECIAL = f"sps AS (SELECT date FROM dy WHERE {NO_SPECIAL})"
ODD = "od AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"
RUNS = "rn AS (SELECT date AS run_date, CASE WHEN day(date) % 11 = 0 THEN 'HOLIDAY' WHEN day(date) % 7 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, 'live' AS source FROM dy)"
BAR_OUT = "date, ticker, round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round({close}, 6) + 0.0 AS close, volume, round(adj_close, 6) + 0.0 AS adj_close"
UPSERTED = BAR_OUT.format(close="close + CASE WHEN date >= DATE '2000-06-01' THEN 1 ELSE 0 END")
PICKED = (S1, SCHEDULE, SCORES, PICKS)
INPUTS = """
ra AS (SELECT date AS seen, min_by(vol_regime, ticker) FILTER (WHERE vol_regime IS NOT NULL) AS vol_regime, max(CAST(dist_sma_20_pct > 0 AS INT)) AS above FROM feats GROUP BY date),
rb AS (SELECT date AS seen, index_close / lag(index_close, 60) OVER (ORDER BY date) - 1 AS ret60 FROM idx),
rin AS (SELECT dy.date, ra.seen, CAST(vol_regime AS INT) AS vol_regime, above, ret60 FROM dy LEFT JOIN (SELECT d.date, max(e.date) AS seen FROM dy d JOIN dy e ON e.date < d.date GROUP BY 1) z ON dy.date = z.date
  LEFT JOIN ra ON ra.seen = z.seen LEFT JOIN rb ON rb.seen = z.seen)"""
PROJECT = "(SELECT max(w) FROM (SELECT CAST(w AS DATE) AS w FROM generate_series({d} + 1, {d} + 100, INTERVAL 1 DAY) g(w) WHERE isodow(w) < 6 AND CAST(w AS DATE) NOT IN (SELECT date FROM sps) ORDER BY w LIMIT 20))"
ARRIVED = f"""WITH e0 AS (
  SELECT event_id, ts, event_type, value, least({LAST_LOAD}, (CAST(ts AS DATE) - (SELECT CAST(min(ts) AS DATE) FROM events)) // {DAYS_A_LOAD}) + CASE WHEN event_id % {TARDY} = 0 THEN 1 ELSE 0 END AS load FROM events),
e1 AS (SELECT * FROM e0 UNION ALL SELECT * FROM e0 WHERE event_id % {TWICE} = 0),
wm AS (SELECT l.load, date_trunc('milliseconds', max(e1.ts)) - INTERVAL 10 MINUTE AS mark FROM (SELECT DISTINCT load FROM e1) l JOIN e1 ON e1.load < l.load GROUP BY 1),
ev AS (SELECT e1.*, coalesce(ts <= mark, FALSE) AS late FROM e1 LEFT JOIN wm USING (load))"""
VALUE3 = "round(total_value, 3) + 0.0 AS total_value"

ORACLE_SQL = {
    "o03_normalise": """SELECT CAST(ts AS DATE) AS date, event_type AS ticker, round(value, 6) + 0.0 AS open, round(value + 1, 6) + 0.0 AS high, round(value - 1, 6) + 0.0 AS low,
      round(value, 6) + 0.0 AS close, event_id AS volume, round(value, 6) + 0.0 AS adj_close FROM events WHERE event_id % 7 <> 0 AND value IS NOT NULL""",
    "o04_upsert": with_bars(select=f"SELECT {UPSERTED} FROM bars"),
    "o05_upsert_index": with_bars(select="SELECT date, round(index_close + CASE WHEN date >= DATE '2000-06-01' THEN 1 ELSE 0 END, 6) + 0.0 AS index_close FROM idx"),
    "o06_enforce": with_bars(select=f"SELECT {BAR_OUT.format(close='close')} FROM bars"),
    "o07_coverage": with_bars(select="SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows FROM bars GROUP BY ticker"),
    "o08_watermarks": with_bars(
        select="""SELECT t.ticker, coalesce(last + 1, DATE '1995-01-02') AS start FROM (SELECT DISTINCT ticker FROM bars) t
        LEFT JOIN (SELECT ticker, max(date) AS last FROM bars WHERE date < DATE '2001-06-01' AND ticker <> 'NATION_3' GROUP BY 1) l ON t.ticker = l.ticker WHERE coalesce(last + 1, DATE '1995-01-02') <= DATE '2001-06-01'"""
    ),
    "o09_sql_bars": with_bars(select="SELECT ticker, round(avg(close), 6) + 0.0 AS mean_close, CAST(sum(volume) AS BIGINT) AS volume FROM bars WHERE date >= DATE '1999-01-01' GROUP BY ticker"),
    "o10_sql_features": with_bars(S1, S2, select="SELECT date, round(avg(ret_5d), 6) + 0.0 AS mean_ret, round(max(realized_vol_20d), 6) + 0.0 AS max_vol FROM s2 GROUP BY date"),
    "o11_sql_labels": with_bars(
        "lr AS (SELECT date, ticker, lead(adj_close, 5) OVER (PARTITION BY ticker ORDER BY date) / adj_close - 1 AS r FROM bars)",
        "lb AS (SELECT *, r > median(r) OVER (PARTITION BY date) AS y FROM lr)",
        select="SELECT ticker, CAST(sum(CAST(y AS INT)) AS BIGINT) AS wins, count(r) AS n FROM lb GROUP BY ticker",
    ),
    "o12_feature_table": with_bars(S1, S2, select="SELECT date, ticker, round(ret_5d, 6) + 0.0 AS ret_5d, round(vol_ratio_20d, 6) + 0.0 AS vol_ratio_20d FROM s2"),
    "o13_label_table": with_bars(select="SELECT date, ticker, round(lead(adj_close, 5) OVER (PARTITION BY ticker ORDER BY date) / adj_close - 1, 6) + 0.0 AS forward_ret_5d FROM bars"),
    "o14_csv": with_bars(SERIES, select=f"SELECT date, {VALUE3} FROM ser WHERE series = 'index'"),
    "o15_json": with_bars(select="SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows FROM bars GROUP BY ticker"),
    "v01_missing_columns": with_bars(select="SELECT 'schema.missing_columns' AS rule, 'error' AS severity, CAST(2 AS BIGINT) AS n FROM bars LIMIT 1"),
    **{name: with_bars(BROKEN, select=_count(rule, where)) for name, (rule, where) in RULES.items()},
    "v07_duplicates": with_bars(BROKEN, select=DUPLICATES),
    "v_all_rules": with_bars(BROKEN, select=" UNION ALL ".join([*(_count(r, w) for r, w in RULES.values()), DUPLICATES])),
    "v11_store": with_bars(BROKEN, FAILED, select="SELECT count(*) FILTER (WHERE bad = 1) AS n_failed, count(*) FILTER (WHERE bad = 0 AND warn = 1) AS n_warned FROM good"),
    "c01_spine": with_bars(DAYS, select="SELECT date FROM dy"),
    "c02_window": with_bars(DAYS, select="SELECT date FROM dy WHERE year(date) = 1996"),
    "c03_regular_days": with_bars(DAYS, SPECIAL, select="SELECT date FROM dy EXCEPT SELECT date FROM sps"),
    "c04_special_flag": with_bars(DAYS, select=f"SELECT date, {NO_SPECIAL} AS is_special FROM dy"),
    "c05_neighbours": with_bars(DAYS, ODD, select="SELECT od.date, (SELECT min(dy.date) FROM dy WHERE dy.date > od.date) AS next_day, (SELECT max(dy.date) FROM dy WHERE dy.date < od.date) AS prev_day FROM od"),
    "c06_schedule": with_bars(
        select=f"SELECT CAST(n / 4 AS INT) AS k, date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n FROM (SELECT DISTINCT date FROM bars WHERE date >= DATE '{START}')) WHERE n % 4 = 0"
    ),
    "c07_statistics": with_bars(DAYS, SPECIAL, select="SELECT count(*) AS n_days, (SELECT count(*) FROM sps) AS n_special, min(date) AS first_day, max(date) AS last_day FROM dy"),
    "c08_date_range": with_bars(select="SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM bars"),
    "c09_projection": with_bars(
        DAYS, SPECIAL,
        """pj AS (SELECT d, w, row_number() OVER (PARTITION BY d ORDER BY w) AS n FROM (SELECT date AS d, CAST(unnest(generate_series(date + 1, date + 100, INTERVAL 1 DAY)) AS DATE) AS w FROM dy)
          WHERE isodow(w) < 6 AND w NOT IN (SELECT date FROM sps))""",
        select="SELECT d AS date, w AS projected FROM pj WHERE n = 20",
    ),
    "c10_snap": with_bars(DAYS, ODD, select="SELECT od.date, (SELECT max(dy.date) FROM dy WHERE dy.date <= od.date) AS on_or_before, (SELECT min(dy.date) FROM dy WHERE dy.date >= od.date) AS on_or_after FROM od"),
    "c11_quarters": with_bars(DAYS, select=f"SELECT date, {q_end('date')} AS quarter_end, {q_add(q_end('date'), '3')} AS three_on FROM dy"),
    "d04_latest": with_bars(select="SELECT date, ticker, round(close, 6) + 0.0 AS close FROM bars WHERE date = (SELECT max(date) FROM bars)"),
    "d05_runs_between": with_bars(DAYS, RUNS, select="SELECT * FROM rn WHERE run_date > DATE '1999-01-01' AND run_date <= DATE '1999-12-31'"),
    "d06_cadence": with_bars(
        *PICKED, DAYS, RUNS,
        select="""SELECT e AS newest_entry, n AS days_since, n >= 10 AS due FROM (SELECT e, (SELECT count(*) FROM rn WHERE run_date > e AND run_date < DATE '2001-08-20' AND status <> 'HOLIDAY') + 1 AS n
        FROM (SELECT max(date) AS e FROM pck WHERE rank <= 5))""",
    ),
    "d07_regime_label": with_bars(
        S1, S2, S3, S4, S5, S6, DAYS, INPUTS,
        select="""SELECT date, CASE WHEN vol_regime IS NULL OR above IS NULL OR ret60 IS NULL THEN 'unknown' WHEN abs(ret60) < 0.03 OR (above = 1) <> (ret60 > 0) THEN 'choppy'
        WHEN ret60 > 0 THEN (CASE WHEN vol_regime = 0 THEN 'calm_bull' ELSE 'trending_bull' END) WHEN vol_regime = 2 THEN 'high_vol_bear' ELSE 'choppy' END AS label FROM rin""",
    ),
    "d08_regime_inputs": with_bars(S1, S2, S3, S4, S5, S6, DAYS, INPUTS, select="SELECT date, seen, vol_regime, above, round(ret60, 6) + 0.0 AS ret60 FROM rin"),
    "d09_picks": with_bars(*PICKED, select="SELECT date, ticker, rank FROM pck WHERE rank <= 5"),
    "d11_freshness": with_bars(DAYS, RUNS, select="SELECT max(run_date) AS run_date, max_by(status, run_date) AS status FROM rn"),
    "d12_value_curve": with_bars(
        SERIES, select=f"SELECT series, date, {VALUE3}, CASE WHEN date < DATE '2000-01-01' THEN 'stored' ELSE 'live' END AS origin FROM ser"
    ),
    "d13_basket": with_bars(*PICKED, select="SELECT ticker, date AS entry_date, CASE WHEN rank <= 3 THEN rank END AS rank FROM pck WHERE rank <= 5 AND date = (SELECT max(date) FROM pck)"),
    "d14_timing": with_bars(
        *PICKED, DAYS, RUNS, SPECIAL,
        "ls AS (SELECT max(date) AS date FROM pck)",
        select="SELECT date, (SELECT count(*) FROM rn, ls WHERE run_date > ls.date) AS runs_since, " + PROJECT.format(d="(SELECT date FROM ls)") + " AS projected FROM ls",
    ),
    "d15_last_window": with_bars(
        *PICKED, SERIES,
        "lw AS (SELECT min(date) AS start, max(date) AS stop FROM (SELECT DISTINCT date FROM pck ORDER BY date DESC LIMIT 2))",
        select="SELECT a.series, start, stop, round(b.total_value / a.total_value - 1, 6) + 0.0 AS ret FROM lw JOIN ser a ON a.date = start JOIN ser b ON b.date = stop AND b.series = a.series",
    ),
    "d16_rank_movement": with_bars(
        S1, SCHEDULE, SCORES,
        "rr AS (SELECT date, ticker, CAST(row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS INT) AS rank FROM sco WHERE score IS NOT NULL)",
        select="""SELECT a.ticker, a.rank, b.rank AS previous_rank, b.rank - a.rank AS delta FROM rr a LEFT JOIN (SELECT * FROM rr WHERE date = (SELECT max(date) FROM bars WHERE date < DATE '2001-06-04')) b
        ON a.ticker = b.ticker WHERE a.date = DATE '2001-06-04'""",
    ),
    "d17_chart_window": with_bars(SERIES, select=f"SELECT series, date, {VALUE3} FROM ser WHERE date >= (SELECT max(date) FROM ser) - 182"),
    "streaming_append": with_bars(select=f"SELECT {UPSERTED} FROM bars"),
    "streaming_windows": f"""{ARRIVED} SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) + 0.0 AS total
      FROM (SELECT DISTINCT event_id, ts, event_type, value FROM ev WHERE NOT late) WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE GROUP BY 1, 2""",
    "streaming_late_rows": f"{ARRIVED} SELECT CAST(load AS INT) AS load, count(*) AS rows, count(*) FILTER (WHERE late) AS late FROM ev GROUP BY load",
}
