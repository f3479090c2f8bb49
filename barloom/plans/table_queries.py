"""Queries of jobs that write tables: validated loads, runs that replace dates or series together, and the backfill."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backfill as K
from ..operators import portfolio as B
from ..functions.features import per_ticker
from ..operators.labels import forward_labels
from ..operators.state import regime_inputs
from ..sources.runs import RunTables
from ..sources.scratch import materialise, new_folder
from ..sources.stored import joined, scan_panel, store_panel
from ..sources.validated import read_bars, read_quarantine, save_bars
from .data_queries import BAR_OUT, BROKEN, DAYS, INPUTS, RULES, RUNS, SHORT, VALUE3, broken, days, runs
from .feature_queries import S1, S2, S3, S4, S5, S6
from .market_queries import LABELS, r6
from .panel import bars, bars_once, market_index, rounded, with_bars
from .portfolio_queries import PICKS, SCHEDULE, SCORES, SERIES, _recursive, anchor, recursion_sql, scores, series

TODAY = "2001-12-31"
#: The second load breaks rules for the tickers before this one, in all but one of whose weeks nothing is wrong.
BAD = "NATION_2"


def saved(spark, sf_dir):
    """Folders of table and quarantine after three loads, and their reports: a sound one, one with broken tickers, one without a column."""
    folder = new_folder(spark)
    table, quarantine = f"{folder}/bars", f"{folder}/quarantine"
    panel = bars_once(spark, sf_dir).select(SHORT)
    late = broken(spark, sf_dir, panel).where(f"ticker < '{BAD}'").unionByName(panel.where(f"ticker >= '{BAD}'").withColumn("volume", F.col("volume") + 1))
    loads = (("old", panel.where("date < '2000-01-01'")), ("new", late.where("date >= '1999-06-01'")), ("short", panel.drop("volume")))
    reports = [(name, save_bars(rows, name, table, quarantine, TODAY)) for name, rows in loads]
    return table, quarantine, reports


def v12_published(spark, sf_dir):
    """The table after sound and broken loads: what a load broke is kept out, ticker by ticker."""
    return rounded(read_bars(spark, saved(spark, sf_dir)[0]).select(SHORT))


def v12_quarantined(spark, sf_dir):
    """The bars that were kept out, with the rules that each breaks."""
    rows = read_quarantine(spark, saved(spark, sf_dir)[1])
    return rounded(rows.withColumn("broken", F.array_join("broken", ",")).select("load", "broken", *SHORT))


def v12_report(spark, sf_dir):
    """load, rule, severity, n, published, quarantined, as counted while each load was staged."""
    rows = [(name, *issue, r.published, r.quarantined) for name, r in saved(spark, sf_dir)[2] for issue in r.issues or [(None, None, 0)]]
    return spark.createDataFrame(rows, "load string, rule string, severity string, n long, published long, quarantined long")


def o01_scan_bars(spark, sf_dir):
    """Three years of one ticker, from bars stored by year and ticker."""
    name = store_panel(bars(spark, sf_dir).select(SHORT))
    return rounded(scan_panel(spark, name, "NATION_3", "1996-01-01", "1998-12-31").select(SHORT))


def o02_scan_index(spark, sf_dir):
    """Three years of the index, stored by year."""
    return rounded(scan_panel(spark, store_panel(market_index(bars(spark, sf_dir))), None, "1996-01-01", "1998-12-31"))


def o16_stored_training(spark, sf_dir):
    """Features and labels, stored by year and ticker each, and joined where they are."""
    panel = bars_once(spark, sf_dir)
    features = store_panel(per_ticker(panel, ["ret_5d", "vol_ratio_20d"]))
    labels = store_panel(forward_labels(panel, [5]).select("date", "ticker", "forward_ret_5d", "outperforms_universe_median_5d"))
    return rounded(joined(spark, features, labels).where("forward_ret_5d IS NOT NULL"))


CLOSES = "date date, ticker string, close double"


def d01_replace_dates(spark, sf_dir):
    """Closes of all dates by one run, those of the last weeks replaced by another, one that fails in between leaves no trace."""
    p = bars_once(spark, sf_dir).select("date", "ticker", "close")
    store = RunTables(spark, new_folder(spark))
    done = p.select("date").distinct().withColumn("status", F.lit("SUCCESS"))
    store.replace("first", {"closes": p}, done)
    new = p.where("date >= '2001-09-01' AND ticker < 'NATION_2'").withColumn("close", F.lit(0.0))
    store.stage("failed", {"closes": new.withColumn("close", F.lit(-1.0))})
    store.replace("second", {"closes": new}, new.select("date").distinct().withColumn("status", F.lit("SUCCESS")))
    return rounded(store.read("closes", CLOSES))


def d02_pending_days(spark, sf_dir):
    """Days without a successful run, after the failed ones of 1999 have been run again."""
    store, ledger = RunTables(spark, new_folder(spark)), materialise(runs(spark, sf_dir).withColumnRenamed("run_date", "date"))
    store.commit("first", ledger)
    again = ledger.where("status = 'FAILED' AND year(date) = 1999")
    store.commit("second", again.withColumn("status", F.lit("SUCCESS")))
    return store.pending(days(spark, sf_dir))


def d02_ledger(spark, sf_dir):
    """The ledger by date, with the number of runs of each, after the same."""
    store, ledger = RunTables(spark, new_folder(spark)), materialise(runs(spark, sf_dir).withColumnRenamed("run_date", "date"))
    store.commit("first", ledger)
    store.commit("second", ledger.where("status = 'FAILED' AND year(date) = 1999").withColumn("status", F.lit("SUCCESS")))
    return store.history(["status", "source"])


POINTS = "series string, date date, total_value double"


def d03_replace_series(spark, sf_dir):
    """Two benchmark series as stored, then the index alone replaced by its live extension from the anchor; the other stays."""
    store = RunTables(spark, new_folder(spark), "series", "string")
    s, a = materialise(series(spark, sf_dir)), materialise(anchor(spark, sf_dir))
    store.replace("first", {"points": s}, s.select("series").distinct().withColumn("status", F.lit("SUCCESS")))
    live = B.live_index(market_index(bars_once(spark, sf_dir)), a).select(F.lit("index").alias("series"), "date", "total_value")
    store.replace("second", {"points": live}, live.select("series").distinct().withColumn("status", F.lit("SUCCESS")))
    return rounded(store.read("points", POINTS), 3)


START, END, EVERY, TOP = "1999-01-04", "2001-06-30", 4, 5


def filled(spark, sf_dir, ends=(("a", END),)):
    """A store after a backfill up to each of ``ends`` (run, end), and the number of days that each wrote."""
    panel = bars_once(spark, sf_dir)
    store = RunTables(spark, new_folder(spark))
    f = per_ticker(panel, ["vol_regime", "dist_sma_20_pct"]).select("date", "ticker", "vol_regime", (F.col("dist_sma_20_pct") > 0).cast("int").alias("above"))
    inputs, known = materialise(regime_inputs(f, market_index(panel))), materialise(scores(panel))
    written = [K.backfill(panel, known, inputs, store, run, START, end, EVERY, TOP) for run, end in ends]
    return store, written


def d10_backfill(spark, sf_dir):
    """State of each day: growth of the capital, shares of cash and positions, and the regime."""
    state = filled(spark, sf_dir)[0].read("state", K.STATE)
    total = F.col("total_value")
    return rounded(state.select("date", F.ln(total / 1_000_000.0).alias("log_growth"), (F.col("cash") / total).alias("cash_share"), "n_positions", "regime_label", "source"))


def d10_positions(spark, sf_dir):
    """Positions of each day: growth since entry and share of all positions."""
    p = filled(spark, sf_dir)[0].read("positions", K.POSITIONS)
    whole = p.groupBy("date").agg(F.sum("mtm_value").alias("all"))
    p = p.join(whole, "date").withColumn("grown", F.ln(F.col("current_mark") / F.col("entry_price"))).withColumn("share", F.col("mtm_value") / F.col("all"))
    return rounded(p.select("date", "ticker", "entry_date", "grown", "share"))


def d10_runs(spark, sf_dir):
    """The run rows, with the run that wrote each day and the days that each of three calls wrote: the last wrote none."""
    store, written = filled(spark, sf_dir, (("a", "2000-06-30"), ("b", END), ("c", END)))
    counts = spark.createDataFrame([(run, n) for run, n in zip("abc", written, strict=True)], "run string, days_written int")
    return store.ledger().select("date", "status", "n_picks", "source", "run").join(counts, "run", "full")


def d04_by_date(spark, sf_dir):
    """Rows of one day in the tables of the backfill, and of the latest day: table, date, number of rows."""
    store = filled(spark, sf_dir)[0]
    day = "2000-07-03"
    parts = [(name, store.at(name, schema, day)) for name, schema in K.SCHEMAS.items()] + [(f"latest_{name}", store.latest(name, schema)) for name, schema in K.SCHEMAS.items()]
    counted = [rows.groupBy("date").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "date", "n") for name, rows in parts]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        o01_scan_bars, o02_scan_index, o16_stored_training, v12_published, v12_quarantined, v12_report, d01_replace_dates, d02_pending_days, d02_ledger, d03_replace_series, d10_backfill, d10_positions, d10_runs, d04_by_date,
    )
}

#: Rows of the second load that break an error rule, the rules in order; ``nth`` counts the rows of a key.
ERRORS = {rule: where for rule, where in RULES.values() if rule not in ("volume.zero", "return.anomaly")}
LOADS = f"""
l2 AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS before, row_number() OVER (PARTITION BY ticker, date) AS nth FROM (
  SELECT date, ticker, open, high, low, close, volume, adj_close FROM (SELECT bb.*, close_0 AS adj_close FROM (SELECT b.*, o.adj_close AS close_0 FROM bb b JOIN bars o USING (date, ticker)) bb) WHERE ticker < '{BAD}' AND date >= DATE '1999-06-01'
  UNION ALL SELECT date, ticker, open, high, low, close, volume + 1, adj_close FROM bars WHERE ticker >= '{BAD}' AND date >= DATE '1999-06-01')),
j2 AS (SELECT *, concat_ws(',', {", ".join(f"CASE WHEN {where} THEN '{rule}' END" for rule, where in sorted((ERRORS | {"uniqueness.duplicates": "nth = 2"}).items()))}) AS broken FROM l2),
refused AS (SELECT DISTINCT ticker FROM j2 WHERE broken <> ''),
n2 AS (SELECT * FROM j2 WHERE ticker NOT IN (FROM refused)),
o1 AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS before FROM bars WHERE date < DATE '2000-01-01')""".replace("DATE '2001-06-30'", f"DATE '{TODAY}'")


def _issues(load: str, table: str, published: str, quarantined: str) -> str:
    rules = [(r, w.replace("DATE '2001-06-30'", f"DATE '{TODAY}'")) for r, w in RULES.values()] + ([("uniqueness.duplicates", "nth = 2")] if table == "j2" else [])
    return " UNION ALL ".join(
        f"SELECT '{load}' AS load, '{r}' AS rule, '{'warning' if r in ('volume.zero', 'return.anomaly') else 'error'}' AS severity, (SELECT count(*) FROM {table} WHERE {w}) AS n, "
        f"({published}) AS published, ({quarantined}) AS quarantined"
        for r, w in rules
    )


BENCH_LIVE = "an AS (SELECT max(date) AS d, max_by(total_value, date) AS v FROM ser WHERE series = 'index' AND date <= DATE '2000-12-31')"
LEDGER = f"""{RUNS},
l2 AS (SELECT run_date AS date, source, status = 'FAILED' AND year(run_date) = 1999 AS again, CASE WHEN status = 'FAILED' AND year(run_date) = 1999 THEN 'SUCCESS' ELSE status END AS status FROM rn)"""
FILL_SCHEDULE = SCHEDULE.replace("1996-01-01", START)
FILL = (
    S1, S2, S3, S4, S5, S6, DAYS, INPUTS, FILL_SCHEDULE, SCORES, PICKS,
    *recursion_sql("('live', 5, 1, 0.0, 1.0)", "pk AS (SELECT 'live' AS strategy_id, k, date, ticker FROM pck WHERE rank <= 5)"),
    f"dz AS (SELECT DISTINCT date FROM bars WHERE date BETWEEN DATE '{START}' AND DATE '{END}')",
)
LABEL = """CASE WHEN vol_regime IS NULL OR above IS NULL OR ret60 IS NULL THEN 'unknown' WHEN abs(ret60) < 0.03 OR (above = 1) <> (ret60 > 0) THEN 'choppy'
  WHEN ret60 > 0 THEN (CASE WHEN vol_regime = 0 THEN 'calm_bull' ELSE 'trending_bull' END) WHEN vol_regime = 2 THEN 'high_vol_bear' ELSE 'choppy' END"""
HELD = """pos AS (SELECT y.date, h.ticker, h.date AS entry_date, h.value_after, h.price, now FROM dys y JOIN dz USING (date) JOIN trd h ON h.k = y.k AND h.value_after > 0
  JOIN (SELECT hv.date, hv.ticker, px.adj_close AS now FROM hv ASOF LEFT JOIN px ON hv.ticker = px.ticker AND hv.date >= px.pd) m ON m.date = y.date AND m.ticker = h.ticker)"""
COUNTS = "SELECT '{p}{t}' AS name, date, count(*) AS n FROM {q} WHERE date = {d} GROUP BY date"
TABLES = {
    "predictions": "(SELECT dz.date, ticker FROM dz JOIN sco s ON s.date = (SELECT max(date) FROM bars b WHERE b.date < dz.date) AND score IS NOT NULL)",
    "picks": "(SELECT date, ticker FROM pck WHERE rank <= 5)",
    "state": "(SELECT date FROM dz)",
    "positions": "pos",
}
ORACLE_SQL = {
    "o01_scan_bars": with_bars(select=f"SELECT {BAR_OUT.format(close='close')} FROM bars WHERE ticker = 'NATION_3' AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"),
    "o02_scan_index": with_bars(select="SELECT date, round(index_close, 6) + 0.0 AS index_close FROM idx WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"),
    "o16_stored_training": with_bars(
        S1, S2, LABELS,
        select=f"SELECT date, ticker, {r6('ret_5d', 'vol_ratio_20d', 'forward_ret_5d')}, outperforms_universe_median_5d FROM s2 JOIN lab USING (date, ticker) WHERE forward_ret_5d IS NOT NULL",
    ),
    "v12_published": with_bars(
        BROKEN, LOADS,
        "al AS (SELECT 2 AS load, date, ticker, open, high, low, close, volume, adj_close FROM n2 UNION ALL SELECT 1, date, ticker, open, high, low, close, volume, adj_close FROM o1)",
        select=f"SELECT {BAR_OUT.format(close='close')} FROM al QUALIFY row_number() OVER (PARTITION BY date, ticker ORDER BY load DESC) = 1",
    ),
    "v12_quarantined": with_bars(BROKEN, LOADS, select=f"SELECT 'new' AS load, broken, {BAR_OUT.format(close='close')} FROM j2 WHERE ticker IN (FROM refused)"),
    "v12_report": with_bars(
        BROKEN, LOADS,
        "iss AS (" + _issues("old", "o1", "SELECT count(*) FROM o1", "SELECT 0") + " UNION ALL "
        + _issues("new", "j2", "SELECT count(*) FROM n2", "SELECT count(*) FROM j2 WHERE ticker IN (FROM refused)") + ")",
        select="""SELECT * FROM iss WHERE n > 0 UNION ALL SELECT 'short', 'schema.missing_columns', 'error', 1, 0, 0
        UNION ALL SELECT 'old', NULL, NULL, 0, (SELECT count(*) FROM o1), 0 WHERE NOT EXISTS (FROM iss WHERE load = 'old' AND n > 0)""",
    ),
    "d01_replace_dates": with_bars(
        select="""SELECT date, ticker, round(CASE WHEN date >= DATE '2001-09-01' THEN 0 ELSE close END, 6) + 0.0 AS close FROM bars b
        WHERE NOT (date >= DATE '2001-09-01' AND date IN (SELECT date FROM bars WHERE ticker < 'NATION_2') AND ticker >= 'NATION_2')"""
    ),
    "d02_pending_days": with_bars(DAYS, LEDGER, select="SELECT date FROM dy WHERE date NOT IN (SELECT date FROM l2 WHERE status = 'SUCCESS')"),
    "d02_ledger": with_bars(DAYS, LEDGER, select="SELECT date, status, source, CASE WHEN again THEN 'second' ELSE 'first' END AS run, CASE WHEN again THEN 2 ELSE 1 END::BIGINT AS n_runs FROM l2"),
    "d03_replace_series": with_bars(
        SERIES, BENCH_LIVE,
        select=f"""SELECT series, date, {VALUE3} FROM ser WHERE series = 'mean' UNION ALL
        SELECT 'index', i.date, round(v * i.index_close / a.index_close, 3) + 0.0 FROM idx i, an JOIN idx a ON a.date = d WHERE i.date > d""",
    ),
    "d10_backfill": _recursive(
        *FILL,
        select=f"""SELECT dv.date, round(ln(total_value / 1000000), 6) + 0.0 AS log_growth, round(cash / total_value, 6) + 0.0 AS cash_share, n_positions, {LABEL} AS regime_label, 'BACKTEST' AS source
        FROM dv JOIN dz USING (date) JOIN rin USING (date) UNION ALL SELECT min(date) - 1, 0.0, 1.0, 0, 'choppy', 'BACKTEST' FROM dz""",
    ),
    "d10_positions": _recursive(
        *FILL, HELD,
        select="""SELECT date, ticker, entry_date, round(ln(now / price), 6) + 0.0 AS grown,
        round(value_after * now / price / sum(value_after * now / price) OVER (PARTITION BY date), 6) + 0.0 AS share FROM pos""",
    ),
    "d10_runs": with_bars(
        S1, FILL_SCHEDULE, SCORES, PICKS,
        f"dz AS (SELECT DISTINCT date FROM bars WHERE date BETWEEN DATE '{START}' AND DATE '{END}')",
        "wr AS (SELECT CASE WHEN date <= DATE '2000-06-30' THEN 'a' ELSE 'b' END AS run, date FROM dz)",
        select="""SELECT run, wr.date, 'SUCCESS' AS status, CAST((SELECT count(*) FROM pck WHERE pck.date = wr.date AND rank <= 5) AS INT) AS n_picks, 'BACKTEST' AS source,
          CAST((SELECT count(*) FROM wr w WHERE w.run = wr.run) AS INT) AS days_written FROM wr
        UNION ALL SELECT 'a', min(date) - 1, 'SUCCESS', 0, 'BACKTEST', CAST((SELECT count(*) FROM wr WHERE run = 'a') AS INT) FROM wr UNION ALL SELECT 'c', NULL, NULL, NULL, NULL, 0""",
    ),
    "d04_by_date": _recursive(
        *FILL, HELD,
        select=" UNION ALL ".join(
            [COUNTS.format(p="", t=t, q=q, d="DATE '2000-07-03'") for t, q in TABLES.items()] + [COUNTS.format(p="latest_", t=t, q=q, d=f"(SELECT max(date) FROM {q})") for t, q in TABLES.items()]
        ),
    ),
}
