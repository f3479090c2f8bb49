"""Queries of cross-sections, regimes, feature assembly, labels and the training table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.features import per_ticker
from ..operators import cross_section as X
from ..operators import incremental as U
from ..operators import labels as L
from ..operators import pipeline as P
from ..operators import regime as R
from ..sources.runs import RunTables
from ..sources.scratch import new_folder
from .feature_queries import S1, S2, S3, S4, S5, S6, SUPERTREND, WHOLE, full
from .panel import bars, bars_once, fear_index, market_index, rounded, with_bars

SECTION = ["ret_5d", "realized_vol_20d", "turnover", "sector"]


def special_sessions(panel):
    """The stand-in for short sessions: dates in the first week of a January."""
    return panel.select("date").distinct().where("month(date) = 1 AND day(date) <= 7")


def section(panel):
    return X.cross_section(per_ticker(panel, SECTION), special_sessions(panel))


def regimes(panel):
    return R.regime(panel, market_index(panel), fear_index(panel))


def _of_section(*columns):
    return lambda spark, sf_dir: rounded(section(bars(spark, sf_dir)).select("date", "ticker", *columns))


def x08_beta(spark, sf_dir):
    panel = bars_once(spark, sf_dir)
    return rounded(X.market_beta(panel, market_index(panel)), 4)


def r01_regime_spine(spark, sf_dir):
    return rounded(regimes(bars_once(spark, sf_dir)))


def r02_vix_level(spark, sf_dir):
    return r01_regime_spine(spark, sf_dir).select("date", "vix_level")


def r03_vix_percentile(spark, sf_dir):
    return r01_regime_spine(spark, sf_dir).select("date", "vix_pct_252d")


def r04_above_sma200(spark, sf_dir):
    return r01_regime_spine(spark, sf_dir).select("date", "nifty_above_sma_200")


def r05_mean_correlation(spark, sf_dir):
    return rounded(R.mean_correlation(bars_once(spark, sf_dir)))


def r06_wide_returns(spark, sf_dir):
    """A column per nation, in order of name: a dimension, one row per ticker."""
    names = [r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name").orderBy("n_name").collect()]
    wide = R.wide_returns(bars(spark, sf_dir), names)
    return rounded(wide.select("date", *[F.col(f"`{n}`").alias(f"t{i}") for i, n in enumerate(names)]))


def i01_interaction(spark, sf_dir):
    panel = bars_once(spark, sf_dir)
    return rounded(R.interaction(section(panel), regimes(panel)))


ASSEMBLED = ["ret_1d", "ret_5d", "realized_vol_20d", "rsi_14", "vol_ratio_20d", "ret_5d_rank_universe", "mean_reversion_strength_x_vix"]


def assembled(panel):
    features = per_ticker(panel, [*SECTION, "ret_1d", "rsi_14", "vol_ratio_20d"])
    return P.assemble(X.cross_section(features, special_sessions(panel)), regimes(panel))


def everything(panel):
    """All features of a written panel."""
    return P.all_features(panel, market_index(panel), fear_index(panel), special_sessions(panel))


def p01_feature_join(spark, sf_dir):
    return rounded(everything(bars_once(spark, sf_dir)), 4)


def p02_special_mask(spark, sf_dir):
    panel = bars_once(spark, sf_dir)
    features = assembled(panel)
    masked = P.mask_special(features, special_sessions(panel), P.masked_columns(features))
    return rounded(masked.select("date", "ticker", "ret_1d", "vol_ratio_20d", "rsi_14"))


def p04_incremental(spark, sf_dir):
    """The feature table after updates with the bars up to the ends of 1998 and of 2000, and with all: that of ``p01``."""
    panel = bars_once(spark, sf_dir)
    store, special = RunTables(spark, new_folder(spark)), special_sessions(panel)
    for run, end in (("a", "1998-12-31"), ("b", "2000-12-31"), ("c", "2010-12-31")):
        U.update(panel.where(F.col("date") <= end), special, store, run)
    return rounded(store.read("features", U.FEATURES), 4)


def p06_inspect(spark, sf_dir):
    ticker = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.min("n_name")).first()[0]
    return rounded(P.inspect(per_ticker(bars(spark, sf_dir), ["ret_1d", "ret_5d"]), ticker, ["ret_1d", "ret_5d"], 10))


def _labels(*columns, digits=6):
    def run(spark, sf_dir):
        return rounded(L.forward_labels(bars(spark, sf_dir)).select("date", "ticker", *columns), digits)

    return run


def l02_universe_median(spark, sf_dir):
    r = L.forward_labels(bars(spark, sf_dir), [5])
    return rounded(r.groupBy("date").agg(F.percentile("forward_ret_5d", 0.5).alias("median_5d")))


def l06_distribution(spark, sf_dir):
    return rounded(L.label_distribution(L.forward_labels(bars(spark, sf_dir)), "outperforms_universe_median_10d"))


def l07_last_rows(spark, sf_dir):
    return rounded(L.last_per_ticker(L.forward_labels(bars(spark, sf_dir), [5]), 2).select("date", "ticker", "forward_ret_5d"))


NEEDED = ["outperforms_universe_median_5d", "forward_ret_5d_demeaned"]


def training(spark, sf_dir, start="1996-01-01", end="2001-06-30"):
    panel = bars_once(spark, sf_dir)
    features = per_ticker(panel, ["ret_5d", "realized_vol_20d", "vol_regime", "dist_sma_20_pct", "vol_ratio_20d"])
    sectors = panel.select("ticker", "sector").distinct()
    return L.training_table(features, regimes(panel), L.forward_labels(panel, [5]), sectors, NEEDED, start, end)


def t01_training_table(spark, sf_dir):
    return rounded(training(spark, sf_dir).select("date", "ticker", "sector", "ret_5d", "vix_level", *NEEDED))


def t02_profile(spark, sf_dir):
    return rounded(L.profile(training(spark, sf_dir), ["ret_5d", "realized_vol_20d", "vix_pct_252d"], NEEDED[0]))


def t03_model_inputs(spark, sf_dir):
    sectors = [r[0] for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name").collect()]  # a dimension
    return L.model_inputs(training(spark, sf_dir), sectors[1:]).select("date", "ticker", "day_of_week", "sector_code")


QUERIES = {
    "x01_return_rank": _of_section("ret_5d_rank_universe"),
    "x02_vol_rank": _of_section("vol_20d_rank_universe"),
    "x03_turnover_rank": _of_section("turnover_rank_universe"),
    "x04_return_score": _of_section("ret_5d_z_winsor"),
    "x05_vol_score": _of_section("vol_20d_z_winsor"),
    "x06_sector_rank": _of_section("ret_5d_rank_sector"),
    "x07_sector_median_distance": _of_section("ret_5d_dist_sector_median"),
    **{
        f.__name__: f
        for f in (
            x08_beta, r01_regime_spine, r02_vix_level, r03_vix_percentile, r04_above_sma200, r05_mean_correlation,
            r06_wide_returns, i01_interaction, p01_feature_join, p02_special_mask, p04_incremental, p06_inspect,
        )
    },
    "l01_forward_return": _labels("forward_ret_5d", "forward_ret_10d", "forward_ret_20d"),
    "l02_universe_median": l02_universe_median,
    "l03_binary_label": _labels(*[f"outperforms_universe_median_{h}d" for h in L.HORIZONS]),
    "l04_demeaned_return": _labels(*[f"forward_ret_{h}d_demeaned" for h in L.HORIZONS]),
    **{f.__name__: f for f in (l06_distribution, l07_last_rows, t01_training_table, t02_profile, t03_model_inputs)},
}


def rank_sql(x: str, by: str) -> str:
    """Average rank of non-null x."""
    return (
        f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x})"
        f" + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END"
    )


def percentile_sql(x: str, by: str = "date") -> str:
    n = f"count({x}) OVER (PARTITION BY {by})"
    return f"CASE WHEN {n} > 1 THEN ({rank_sql(x, by)} - 1) / ({n} - 1) END"


def nearest_sql(x: str, q: float) -> str:
    values = f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER (PARTITION BY date))"
    return f"({values})[CAST(round((len({values}) - 1) * {q}) AS INT) + 1]"


def _score_ctes(x: str, out: str) -> tuple[str, str]:
    return (
        f"{out}_q AS (SELECT *, {nearest_sql(x, 0.01)} AS qa, {nearest_sql(x, 0.99)} AS qb FROM f2)",
        f"""{out}_c AS (SELECT date, ticker, CASE WHEN stddev_samp(cut) OVER d > 0 THEN ({x} - avg(cut) OVER d) / stddev_samp(cut) OVER d END AS {out}
          FROM (SELECT *, least(greatest({x}, qa), qb) AS cut FROM {out}_q) WINDOW d AS (PARTITION BY date))""",
    )


F2 = """f2 AS (SELECT *, CASE WHEN NOT (month(date) = 1 AND day(date) <= 7) THEN turnover END AS open_turnover FROM s2)"""
SCORE = _score_ctes("ret_5d", "ret_5d_z_winsor")
REGIME = f"""
rg AS (
  SELECT s.date, v.vix_level, v.vix_pct_252d, i.nifty_above_sma_200
  FROM (SELECT DISTINCT date FROM bars) s
  LEFT JOIN (
    SELECT date, vix AS vix_level, CASE WHEN len(seen) = 252 THEN (len(list_filter(seen, lambda x: x <= vix)) - 1) / 251.0 END AS vix_pct_252d
    FROM (SELECT date, vix, list(vix) OVER (ORDER BY date ROWS 251 PRECEDING) AS seen FROM vixs WHERE vix IS NOT NULL)) v ON s.date = v.date
  LEFT JOIN (
    SELECT date, CASE WHEN count(*) OVER w = 200 THEN CAST(index_close > avg(index_close) OVER w AS INT) END AS nifty_above_sma_200
    FROM idx WINDOW w AS (ORDER BY date ROWS 199 PRECEDING)) i ON s.date = i.date)"""
LABELS = f"""
lr AS (SELECT date, ticker, {", ".join(f"lead(adj_close, {h}) OVER (PARTITION BY ticker ORDER BY date) / adj_close - 1 AS forward_ret_{h}d" for h in L.HORIZONS)} FROM bars),
lab AS (
  SELECT *, {", ".join(f'''CASE WHEN forward_ret_{h}d IS NOT NULL THEN CAST(forward_ret_{h}d > median(forward_ret_{h}d) OVER d AS INT) END AS outperforms_universe_median_{h}d,
    forward_ret_{h}d - avg(forward_ret_{h}d) OVER d AS forward_ret_{h}d_demeaned''' for h in L.HORIZONS)}
  FROM lr WINDOW d AS (PARTITION BY date))"""
TRAINING = """
tt AS (
  SELECT f.date, f.ticker, f.sector, ret_5d, realized_vol_20d, vol_regime, dist_sma_20_pct, vol_ratio_20d, vix_level, vix_pct_252d, nifty_above_sma_200,
    outperforms_universe_median_5d, forward_ret_5d, forward_ret_5d_demeaned
  FROM feats f LEFT JOIN lab l ON f.date = l.date AND f.ticker = l.ticker LEFT JOIN rg ON f.date = rg.date
  WHERE f.date BETWEEN DATE '1996-01-01' AND DATE '2001-06-30'
    AND outperforms_universe_median_5d IS NOT NULL AND forward_ret_5d_demeaned IS NOT NULL)"""
FEATS = (S1, S2, S3, S4, S5, S6)


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


def _ranked(x: str, out: str) -> str:
    return with_bars(S1, S2, F2, select=f"SELECT date, ticker, round({percentile_sql(x)}, 6) + 0.0 AS {out} FROM f2")


SECTOR_RANK = f"CASE WHEN count(*) OVER (PARTITION BY date, sector) > 1 THEN ({rank_sql('ret_5d', 'date, sector')} - 1) / (count(*) OVER (PARTITION BY date, sector) - 1) END"
VOL_SCORE = _score_ctes("realized_vol_20d", "vol_20d_z_winsor")
ASSEMBLY = (
    *FEATS,
    F2.replace("s2)", "feats)"),
    *SCORE,
    REGIME,
    f"""asm AS (
  SELECT f.*, {percentile_sql('f.ret_5d', 'f.date')} AS ret_5d_rank_universe, c.ret_5d_z_winsor * rg.vix_pct_252d AS mean_reversion_strength_x_vix
  FROM f2 f LEFT JOIN ret_5d_z_winsor_c c ON f.date = c.date AND f.ticker = c.ticker LEFT JOIN rg ON f.date = rg.date)""",
)
NO_SPECIAL = "month(date) = 1 AND day(date) <= 7"
BETA = (
    "mk AS (SELECT date, index_close / lag(index_close) OVER (ORDER BY date) - 1 AS y FROM idx)",
    "own AS (SELECT date, ticker, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS x FROM bars)",
    "xy AS (SELECT own.*, y FROM own JOIN mk ON own.date = mk.date WHERE x IS NOT NULL AND y IS NOT NULL)",
    f"bt AS (SELECT date, ticker, ({full('avg', 'x * y', 60)} - {full('avg', 'x', 60)} * {full('avg', 'y', 60)}) AS cov, ({full('avg', 'y * y', 60)} - pow({full('avg', 'y', 60)}, 2)) AS vr FROM xy)",
)
PAIRS = f"""
rr AS (SELECT date, ticker, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars),
sp AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM bars)),
rt AS (SELECT rr.*, t FROM rr JOIN sp ON rr.date = sp.date WHERE r IS NOT NULL),
ok AS (SELECT ticker, t, count(*) OVER (PARTITION BY ticker ORDER BY t RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS n FROM rt),
pr AS (
  SELECT a.t, a.ticker AS x, b.ticker AS y,
    corr(a.r, b.r) OVER (PARTITION BY a.ticker, b.ticker ORDER BY a.t RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS rho
  FROM rt a JOIN rt b ON a.t = b.t AND a.ticker < b.ticker),
mc AS (
  SELECT pr.t, avg(rho) AS m FROM pr JOIN ok p ON p.ticker = x AND p.t = pr.t AND p.n = 60 JOIN ok q ON q.ticker = y AND q.t = pr.t AND q.n = 60
  WHERE NOT isnan(rho) GROUP BY pr.t)"""

#: All features by name, before special sessions are masked: ``af``.
EVERYTHING = (
    *FEATS,
    SUPERTREND,
    F2.replace("s2)", "feats)"),
    *SCORE,
    *VOL_SCORE,
    REGIME,
    PAIRS,
    *BETA,
    f"""af AS (
  SELECT f.*, rs.ret_5d_z_winsor * rg.vix_pct_252d AS mean_reversion_strength_x_vix, CASE WHEN st.band.r THEN st.band.l ELSE st.band.u END AS supertrend_10_3,
    rs.ret_5d_z_winsor, vs.vol_20d_z_winsor, CASE WHEN vr > 0 THEN cov / vr END AS beta_60d_nifty50, rg.vix_level, rg.vix_pct_252d, rg.nifty_above_sma_200, m AS corr_regime_60d
  FROM (SELECT *, {percentile_sql('ret_5d')} AS ret_5d_rank_universe, {percentile_sql('realized_vol_20d')} AS vol_20d_rank_universe,
      {percentile_sql('open_turnover')} AS turnover_rank_universe, {SECTOR_RANK} AS ret_5d_rank_sector,
      CASE WHEN count(*) OVER (PARTITION BY date, sector) > 1 THEN ret_5d - median(ret_5d) OVER (PARTITION BY date, sector) END AS ret_5d_dist_sector_median FROM f2) f
  JOIN t4 st USING (date, ticker) LEFT JOIN ret_5d_z_winsor_c rs USING (date, ticker) LEFT JOIN vol_20d_z_winsor_c vs USING (date, ticker) LEFT JOIN bt USING (date, ticker)
  LEFT JOIN rg USING (date) LEFT JOIN sp USING (date) LEFT JOIN mc USING (t))""",
)


def whole_table(digits: int) -> str:
    """The columns of ``af``, masked on special sessions and rounded."""
    out = ["date", "ticker"]
    for name, _, _, _, mask in P.METADATA:
        x = f"CASE WHEN NOT ({NO_SPECIAL}) THEN {name} END" if mask else name
        out.append(f"CAST({x} AS INT) AS {name}" if name in {*WHOLE, "nifty_above_sma_200"} else f"round({x}, {digits}) + 0.0 AS {name}")
    return ", ".join(out)


ORACLE_SQL = {
    "x01_return_rank": _ranked("ret_5d", "ret_5d_rank_universe"),
    "x02_vol_rank": _ranked("realized_vol_20d", "vol_20d_rank_universe"),
    "x03_turnover_rank": _ranked("open_turnover", "turnover_rank_universe"),
    "x04_return_score": with_bars(S1, S2, F2, *SCORE, select=f"SELECT date, ticker, {r6('ret_5d_z_winsor')} FROM ret_5d_z_winsor_c"),
    "x05_vol_score": with_bars(S1, S2, F2, *VOL_SCORE, select=f"SELECT date, ticker, {r6('vol_20d_z_winsor')} FROM vol_20d_z_winsor_c"),
    "x06_sector_rank": with_bars(S1, S2, select=f"SELECT date, ticker, round({SECTOR_RANK}, 6) + 0.0 AS ret_5d_rank_sector FROM s2"),
    "x07_sector_median_distance": with_bars(
        S1, S2,
        select="""SELECT date, ticker, round(CASE WHEN count(*) OVER d > 1 THEN ret_5d - median(ret_5d) OVER d END, 6) + 0.0 AS ret_5d_dist_sector_median
        FROM s2 WINDOW d AS (PARTITION BY date, sector)""",
    ),
    "x08_beta": with_bars(
        *BETA,
        select="""SELECT bars.date, bars.ticker, round(CASE WHEN vr > 0 THEN cov / vr END, 4) + 0.0 AS beta_60d_nifty50
        FROM bars LEFT JOIN bt ON bars.date = bt.date AND bars.ticker = bt.ticker""",
    ),
    "r01_regime_spine": with_bars(REGIME, select=f"SELECT date, {r6('vix_level', 'vix_pct_252d')}, nifty_above_sma_200 FROM rg"),
    "r02_vix_level": with_bars(REGIME, select=f"SELECT date, {r6('vix_level')} FROM rg"),
    "r03_vix_percentile": with_bars(REGIME, select=f"SELECT date, {r6('vix_pct_252d')} FROM rg"),
    "r04_above_sma200": with_bars(REGIME, select="SELECT date, nifty_above_sma_200 FROM rg"),
    "r05_mean_correlation": with_bars(PAIRS, select="SELECT date, round(m, 6) + 0.0 AS corr_regime_60d FROM sp LEFT JOIN mc ON sp.t = mc.t"),
    "r06_wide_returns": with_bars(
        "rr AS (SELECT date, ticker, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars)",
        "nm AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS i FROM nation)",
        select="SELECT date, " + ", ".join(f"round(any_value(r) FILTER (WHERE i = {i}), 6) + 0.0 AS t{i}" for i in range(25)) + " FROM rr JOIN nm ON ticker = n_name GROUP BY date",
    ),
    "i01_interaction": with_bars(
        S1, S2, F2, *SCORE, REGIME,
        select="""SELECT c.date, c.ticker, round(ret_5d_z_winsor * vix_pct_252d, 6) + 0.0 AS mean_reversion_strength_x_vix
        FROM ret_5d_z_winsor_c c LEFT JOIN rg ON c.date = rg.date""",
    ),
    "p01_feature_join": with_bars(*EVERYTHING, select=f"SELECT {whole_table(4)} FROM af"),
    "p02_special_mask": with_bars(
        *ASSEMBLY,
        select=f"""SELECT date, ticker, {r6('ret_1d')},
        round(CASE WHEN NOT ({NO_SPECIAL}) THEN vol_ratio_20d END, 6) + 0.0 AS vol_ratio_20d, {r6('rsi_14')} FROM asm""",
    ),
    "p04_incremental": with_bars(*EVERYTHING, select=f"SELECT {whole_table(4)} FROM af"),
    "p06_inspect": with_bars(S1, select=f"SELECT date, ticker, {r6('ret_1d', 'ret_5d')} FROM s1 WHERE ticker = (SELECT min(n_name) FROM nation) ORDER BY date DESC LIMIT 10"),
    "l01_forward_return": with_bars(LABELS, select=f"SELECT date, ticker, {r6(*[f'forward_ret_{h}d' for h in L.HORIZONS])} FROM lab"),
    "l02_universe_median": with_bars(LABELS, select="SELECT date, round(median(forward_ret_5d), 6) + 0.0 AS median_5d FROM lab GROUP BY date"),
    "l03_binary_label": with_bars(LABELS, select="SELECT date, ticker, " + ", ".join(f"outperforms_universe_median_{h}d" for h in L.HORIZONS) + " FROM lab"),
    "l04_demeaned_return": with_bars(LABELS, select=f"SELECT date, ticker, {r6(*[f'forward_ret_{h}d_demeaned' for h in L.HORIZONS])} FROM lab"),
    "l06_distribution": with_bars(
        LABELS,
        select="""SELECT count(y) AS n_valid, count(*) - count(y) AS n_null, round(100.0 * avg(y), 6) + 0.0 AS pct_ones
        FROM (SELECT outperforms_universe_median_10d AS y FROM lab)""",
    ),
    "l07_last_rows": with_bars(
        LABELS,
        select=f"SELECT date, ticker, {r6('forward_ret_5d')} FROM lab QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 2",
    ),
    "t01_training_table": with_bars(
        *FEATS, LABELS, REGIME, TRAINING,
        select=f"SELECT date, ticker, sector, {r6('ret_5d', 'vix_level')}, outperforms_universe_median_5d, {r6('forward_ret_5d_demeaned')} FROM tt",
    ),
    "t02_profile": with_bars(
        *FEATS, LABELS, REGIME, TRAINING,
        select="""SELECT item, round(value, 6) + 0.0 AS value FROM (
        SELECT unnest(['rows', 'tickers', 'sectors', 'dates', 'first_date', 'last_date', 'label_mean', 'null_ret_5d', 'null_realized_vol_20d', 'null_vix_pct_252d']) AS item,
          unnest([CAST(count(*) AS DOUBLE), count(DISTINCT ticker), count(DISTINCT sector), count(DISTINCT date), date_diff('day', DATE '1970-01-01', min(date)),
            date_diff('day', DATE '1970-01-01', max(date)), avg(outperforms_universe_median_5d), avg(CAST(ret_5d IS NULL AS INT)), avg(CAST(realized_vol_20d IS NULL AS INT)),
            avg(CAST(vix_pct_252d IS NULL AS INT))]) AS value FROM tt)""",
    ),
    "t03_model_inputs": with_bars(
        *FEATS, LABELS, REGIME, TRAINING,
        "sc AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS code FROM region WHERE r_regionkey > 0)",
        select="SELECT date, ticker, CAST(isodow(date) AS INT) AS day_of_week, CAST(coalesce(code, -1) AS INT) AS sector_code FROM tt LEFT JOIN sc ON sector = r_name",
    ),
}
