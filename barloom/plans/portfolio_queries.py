"""Queries of fold routing, picks, costs, portfolios and performance statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.features import per_ticker
from ..operators import folds as W
from ..operators import performance as Q
from ..operators import portfolio as B
from ..operators.cross_section import percentile_rank
from .feature_queries import S1, full
from .market_queries import percentile_sql
from .metric_queries import BOUNDS, folds, r6
from ..sources.scratch import materialise
from .panel import bars, bars_once, market_index, rounded, with_bars

START, END, EVERY, TOP = "1996-01-01", "2001-06-30", 4, 5
#: The schedule that all scenarios take their rebalances from.
FASTEST = 1


def scores(panel):
    return per_ticker(panel, ["ret_5d"]).select("date", "ticker", percentile_rank(F.col("ret_5d")).alias("score"))


def picked(spark, sf_dir, n=TOP, panel=None, every=EVERY):
    panel = bars_once(spark, sf_dir) if panel is None else panel
    return B.top_picks(B.scores_as_of(B.schedule(panel, every, START, END), scores(panel)), n)


#: strategy, positions, every n-th rebalance of the fastest schedule, brokerage, slippage scale.
SCENARIOS = (
    ("primary", 5, 4, 0.0, 1.0), ("n3", 3, 4, 0.0, 1.0), ("n10", 10, 4, 0.0, 1.0), ("fast", 5, 1, 0.0, 1.0),
    ("slow", 5, 12, 0.0, 1.0), ("slip2x", 5, 4, 0.0, 2.0), ("brokerage20", 5, 4, 20.0, 1.0),
)


def scenarios(spark, names=None):
    rows = [s for s in SCENARIOS if names is None or s[0] in names]
    return spark.createDataFrame(rows, "strategy_id string, n_positions int, every int, brokerage double, slip_scale double")


def trades(spark, sf_dir, names=("primary",)):
    """The legs of the named scenarios: ranks are made once, and each scenario takes its share of them."""
    s, panel = scenarios(spark, names), bars_once(spark, sf_dir)
    p = picked(spark, sf_dir, 10, panel, FASTEST).join(F.broadcast(s), (F.col("rank") <= F.col("n_positions")) & (F.col("k") % F.col("every") == 0))
    p = materialise(p.select("strategy_id", (F.col("k") / F.col("every")).cast("int").alias("k"), "date", "ticker"))
    return materialise(B.rebalance(p, panel, s))


def equal_weight(spark, sf_dir):
    """The equal-weight benchmark: every ticker scores the same, and all are positions."""
    panel = bars_once(spark, sf_dir)
    n = panel.select("ticker").distinct().count()
    all_ = B.schedule(panel, EVERY, START, END).join(panel.select("ticker").distinct())
    s = spark.createDataFrame([("equal_weight", n, 1, 0.0, 1.0)], "strategy_id string, n_positions int, every int, brokerage double, slip_scale double")
    return materialise(B.rebalance(all_.select(F.lit("equal_weight").alias("strategy_id"), "k", "date", "ticker"), panel, s))


def series(spark, sf_dir):
    """series, date, total_value: the rebased index, and the compounded mean log return of all tickers."""
    panel = bars_once(spark, sf_dir)
    index = B.rebased(market_index(panel), "index_close").select(F.lit("index").alias("series"), "date", "total_value")
    mean = per_ticker(panel, ["log_ret_1d"]).groupBy("date").agg(F.coalesce(F.avg("log_ret_1d"), F.lit(0.0)).alias("m"))
    w = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    equal = mean.select(F.lit("mean").alias("series"), "date", (1_000_000.0 * F.exp(F.sum("m").over(w))).alias("total_value"))
    return index.unionByName(equal)


def windows(spark):
    return spark.sql(
        "SELECT * FROM VALUES ('early', DATE'1995-03-01', DATE'1996-12-31'), ('middle', DATE'1997-01-01', DATE'1999-06-30'), "
        "('late', DATE'1999-07-01', DATE'2001-12-31'), ('brief', DATE'1998-01-01', DATE'1998-01-15') AS t(name, start, stop)"
    )


def leg_values(spark, sf_dir):
    """date, ticker, side, value, adv: a traded value for every bar with a known turnover, its side by the day's direction."""
    panel = bars_once(spark, sf_dir)
    return B.adv(panel).where("adv IS NOT NULL").join(panel, ["date", "ticker"]).select(
        "date", "ticker", F.when(F.col("close") >= F.col("open"), "buy").otherwise("sell").alias("side"), (F.floor(F.col("close") / 10) * 1000.0).alias("value"), "adv"
    )


def b01_fold_routing(spark, sf_dir):
    return W.route(B.schedule(bars(spark, sf_dir), EVERY, START, END), folds(spark, sf_dir))


def b02_frozen_fold(spark, sf_dir):
    return W.frozen_route(B.schedule(bars(spark, sf_dir), EVERY, START, END), folds(spark, sf_dir), 2)


def b03_scores_as_of(spark, sf_dir):
    panel = bars_once(spark, sf_dir)
    return rounded(B.scores_as_of(B.schedule(panel, EVERY, START, END), scores(panel)))


def b03_missing_tickers(spark, sf_dir):
    panel = bars_once(spark, sf_dir)
    return B.missing_scores(B.scores_as_of(B.schedule(panel, EVERY, START, END), scores(panel)), panel.select("ticker").distinct())


def b04_adv(spark, sf_dir):
    return rounded(B.adv(bars(spark, sf_dir)), 4)


def b05_top_picks(spark, sf_dir):
    return rounded(picked(spark, sf_dir).select("k", "date", "score_date", "ticker", "score", "rank"))


def _costs(brokerage):
    def run(spark, sf_dir):
        v = leg_values(spark, sf_dir)
        return rounded(v.select("date", "ticker", "side", *[x.alias(n) for n, x in B.trade_costs(F.col("value"), F.col("side"), brokerage).items()]))

    return run


def b08_slippage(spark, sf_dir):
    v = leg_values(spark, sf_dir)
    bps = B.slippage_bps(F.col("value"), F.col("adv"))
    return v.select("date", "ticker", bps.alias("bps"), (bps >= B.WORST_BPS).alias("flag"))


def _shares(values):
    """Daily values as growth of the capital and shares of the value: the panel's prices jump, and equity with them."""
    total = F.col("total_value")
    return rounded(
        values.select(
            "strategy_id", "date", "n_positions", F.ln(total / 1_000_000.0).alias("log_growth"), (F.col("cash") / total).alias("cash_share"),
            (F.col("gross_value") / total).alias("gross_share"),
        )
    )


def b09_trade_legs(spark, sf_dir):
    share, cost = F.col("trade_value") / F.col("equity_before"), 1e4 * F.col("cost") / F.col("trade_value")
    t = trades(spark, sf_dir).where("side IS NOT NULL")
    return rounded(t.select("k", "date", "ticker", "side", share.alias("share_of_equity"), cost.alias("cost_bps"), "slip_bps", "flag"))


def b10_portfolio(spark, sf_dir):
    return _shares(B.daily_values(trades(spark, sf_dir), bars_once(spark, sf_dir)))


def b10_rebalance_log(spark, sf_dir):
    t = trades(spark, sf_dir)
    equity = t.groupBy("k").agg(F.max("equity_before").alias("equity"))
    log = B.rebalance_log(t).join(equity, "k").withColumn("cost_share", F.col("total_cost") / F.col("equity"))
    return rounded(log.withColumn("picks", F.array_join("picks", ",")).drop("total_cost", "equity"))


def b11_daily_mark(spark, sf_dir):
    """Last known price of every ticker on every date of the spine."""
    from ..operators.windows import as_of

    panel = bars_once(spark, sf_dir)
    spine = panel.select("date").distinct().join(panel.select("ticker").distinct())
    p = panel.select("ticker", F.col("date").alias("price_date"), F.col("adj_close").alias("price"))
    return rounded(as_of(spine, p, "date", "price_date", by=["ticker"]))


def b12_equal_weight(spark, sf_dir):
    return _shares(B.daily_values(equal_weight(spark, sf_dir), bars_once(spark, sf_dir)))


def b13_daily_returns(spark, sf_dir):
    return rounded(B.returns(series(spark, sf_dir)).select("series", "date", "ret"))


def b14_rebased_index(spark, sf_dir):
    return rounded(B.rebased(market_index(bars(spark, sf_dir)), "index_close"), 3)


def b15_sensitivity(spark, sf_dir):
    t = trades(spark, sf_dir, None)
    v = B.daily_values(t, bars_once(spark, sf_dir)).withColumnRenamed("strategy_id", "series")
    r = B.returns(v).where("ret IS NOT NULL")
    s = r.groupBy("series").agg(F.log1p(Q.cagr(F.col("ret"))).alias("log_cagr"), Q.sharpe(F.col("ret")).alias("sharpe"))
    cost = t.groupBy(F.col("strategy_id").alias("series")).agg(F.log10(F.sum("cost")).alias("log10_cost"), F.countDistinct("k").alias("n_rebalances"))
    return rounded(s.join(cost, "series"), 4)


def b16_held_positions(spark, sf_dir):
    """Ten units of each ticker bought at the first bar of June 2000, carried to a later week."""
    panel = bars_once(spark, sf_dir)
    entry = panel.where("date BETWEEN '2000-06-01' AND '2000-06-30'").groupBy("ticker").agg(F.min("date").alias("entry_date"), F.min_by("close", "date").alias("entry_price"))
    before = entry.select("ticker", F.lit(10).alias("qty"), "entry_date", "entry_price", F.col("entry_price").alias("current_mark"))
    return rounded(B.held_positions(before, panel.where("date = '2000-08-07'").select("ticker", "adj_close", "close"), "2000-08-07"))


def anchor(spark, sf_dir):
    return series(spark, sf_dir).where("series = 'index' AND date <= '2000-12-31'").agg(F.max("date").alias("date"), F.max_by("total_value", "date").alias("total_value"))


def b17_live_index(spark, sf_dir):
    return rounded(B.live_index(market_index(bars(spark, sf_dir)), anchor(spark, sf_dir)), 3)


def b18_anchor(spark, sf_dir):
    return rounded(anchor(spark, sf_dir), 3)


def b19_complete_days(spark, sf_dir):
    panel = bars_once(spark, sf_dir)
    return B.complete_days(panel, panel.select("ticker").distinct().count())


def _stat(f, digits=6):
    return lambda spark, sf_dir: rounded(f(B.returns(series(spark, sf_dir)).where("ret IS NOT NULL").groupBy("series")), digits)


def ret():
    return F.col("ret")


def q05_max_drawdown(spark, sf_dir):
    return rounded(Q.max_drawdown(series(spark, sf_dir)))


def q06_calmar(spark, sf_dir):
    return rounded(Q.bundle(series(spark, sf_dir), "mean").select("series", "calmar"), 4)


def q07_alpha_beta(spark, sf_dir):
    return rounded(Q.alpha_beta(Q.against(series(spark, sf_dir), "mean").where("series = 'index'")).drop("p_value"))


def q07_p_value(spark, sf_dir):
    return rounded(Q.alpha_beta(Q.against(series(spark, sf_dir), "mean").where("series = 'index'")))


def q08_information_ratio(spark, sf_dir):
    p = Q.against(series(spark, sf_dir), "mean").where("series = 'index' AND ret IS NOT NULL")
    return rounded(p.groupBy("series").agg(Q.information_ratio(ret(), F.col("bench")).alias("information_ratio")))


def q09_bundle(spark, sf_dir):
    return rounded(Q.bundle(series(spark, sf_dir), "mean").select("series", "n", "total_return", "cagr", "volatility", "max_drawdown", "longest_underwater"), 5)


def q10_windows(spark, sf_dir):
    return rounded(Q.window_breakdown(series(spark, sf_dir), windows(spark)), 5)


def q11_headline(spark, sf_dir):
    t = trades(spark, sf_dir)
    v = B.daily_values(t, bars_once(spark, sf_dir)).select(F.lit("primary").alias("series"), "date", "total_value").unionByName(series(spark, sf_dir))
    cost = t.agg(F.log10(F.sum("cost")).alias("log10_cost"), F.countDistinct("k").alias("n_rebalances"), F.count_if("flag").alias("n_flagged"))
    b = Q.bundle(v, "mean").select("series", F.log1p("cagr").alias("log_cagr"), "volatility", "sharpe", "max_drawdown")
    return rounded(b.join(F.broadcast(cost)), 4)


def q12_curve(spark, sf_dir):
    return rounded(Q.drawdowns(series(spark, sf_dir)).select("series", "date", "total_value", (100 * F.col("drawdown")).alias("drawdown_pct")), 4)


def q13_monthly(spark, sf_dir):
    return rounded(Q.monthly_returns(series(spark, sf_dir)))


def q13_monthly_table(spark, sf_dir):
    return rounded(Q.monthly_table(series(spark, sf_dir).where("series = 'index'")))


def q14_second_benchmark(spark, sf_dir):
    return rounded(Q.alpha_beta(Q.against(series(spark, sf_dir), "index").where("series = 'mean'")).drop("p_value"))


def contributed(spark, sf_dir):
    panel = bars_once(spark, sf_dir)
    return materialise(Q.contributions(Q.holding_periods(picked(spark, sf_dir, TOP, panel), END), panel))


def q15_attribution(spark, sf_dir):
    return rounded(Q.attribution(contributed(spark, sf_dir)), 4)


def mean_values(spark, sf_dir):
    return series(spark, sf_dir).where("series = 'mean'")


def q16_period_benchmark(spark, sf_dir):
    return rounded(Q.period_benchmark(Q.holding_periods(picked(spark, sf_dir), END), mean_values(spark, sf_dir)))


def q17_counterfactual(spark, sf_dir):
    c = contributed(spark, sf_dir)
    t = Q.counterfactual(c, Q.period_benchmark(c, mean_values(spark, sf_dir)))
    return rounded(t.select("top", F.log1p("total_return").alias("log_growth")), 5)


def q17_alpha(spark, sf_dir):
    """Yearly growth, alpha and loss of alpha without the best contributors, as signed logarithms: they span many magnitudes."""
    c = contributed(spark, sf_dir)
    t = Q.counterfactual_growth(c, Q.period_benchmark(c, mean_values(spark, sf_dir)))
    shown = [F.col("top"), F.log1p("cagr").alias("log_cagr"), *[(F.signum(x) * F.log1p(F.abs(x))).alias(f"log_{x}") for x in ("alpha", "alpha_drop")]]
    return rounded(t.select(shown), 5)


def q18_overlap(spark, sf_dir):
    return Q.overlapping_holds(Q.holding_periods(picked(spark, sf_dir), END), windows(spark))


def q19_common_favourites(spark, sf_dir):
    a, b = Q.most_held(picked(spark, sf_dir, 5), 10), Q.most_held(picked(spark, sf_dir, 3), 10)
    return a.select("ticker").intersect(b.select("ticker"))


def q20_parity(spark, sf_dir):
    s = series(spark, sf_dir)
    a, b = s.where("series = 'index'"), s.where("series = 'mean'")
    return rounded(Q.parity(a, b), 3)


def q20_largest_gaps(spark, sf_dir):
    s = series(spark, sf_dir)
    return rounded(Q.largest_gaps(s.where("series = 'index'"), s.where("series = 'mean'")), 3)


def q21_spot_check(spark, sf_dir):
    return Q.spot_check(picked(spark, sf_dir, 5), picked(spark, sf_dir, 3), "1999-03-03")


def q22_top_and_bottom(spark, sf_dir):
    a = Q.attribution(contributed(spark, sf_dir)).select("ticker", "total_bps")
    top = a.orderBy(F.col("total_bps").desc(), "ticker").limit(10).withColumn("side", F.lit("top"))
    return rounded(top.unionByName(a.orderBy("total_bps", "ticker").limit(10).withColumn("side", F.lit("bottom"))), 4)


def q22_concentration(spark, sf_dir):
    return rounded(Q.concentration(Q.attribution(contributed(spark, sf_dir))), 4)


QUERIES = {
    f.__name__: f
    for f in (
        b01_fold_routing, b02_frozen_fold, b03_scores_as_of, b03_missing_tickers, b04_adv, b05_top_picks, b08_slippage, b09_trade_legs, b10_portfolio,
        b10_rebalance_log, b11_daily_mark, b12_equal_weight, b13_daily_returns, b14_rebased_index, b15_sensitivity, b16_held_positions, b17_live_index,
        b18_anchor, b19_complete_days, q05_max_drawdown, q06_calmar, q07_alpha_beta, q07_p_value, q08_information_ratio, q09_bundle, q10_windows, q11_headline,
        q12_curve, q13_monthly, q13_monthly_table, q14_second_benchmark, q15_attribution, q16_period_benchmark, q17_counterfactual, q17_alpha, q18_overlap,
        q19_common_favourites, q20_parity, q20_largest_gaps, q21_spot_check, q22_top_and_bottom, q22_concentration,
    )
} | {
    "b06_costs": _costs(0.0),
    "b07_flat_brokerage": _costs(20.0),
    "q01_growth": _stat(lambda g: g.agg((Q.growth(ret()) - 1).alias("total_return"), Q.cagr(ret()).alias("cagr"))),
    "q02_volatility": _stat(lambda g: g.agg(Q.volatility(ret()).alias("volatility"))),
    "q03_sharpe": _stat(lambda g: g.agg(Q.sharpe(ret()).alias("sharpe"))),
    "q04_sortino": _stat(lambda g: g.agg(Q.sortino(ret()).alias("sortino"))),
}

SCHEDULE = f"""
sch AS (
  SELECT CAST(n / {EVERY} AS INT) AS k, date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n FROM (SELECT DISTINCT date FROM bars
    WHERE date BETWEEN DATE '{START}' AND DATE '{END}')) WHERE n % {EVERY} = 0)"""
SCORES = f"""
sco AS (SELECT date, ticker, {percentile_sql('ret_5d')} AS score FROM s1),
soa AS (SELECT k, date, score_date, sco.ticker, score FROM (SELECT k, date, (SELECT max(date) FROM bars b WHERE b.date < sch.date) AS score_date FROM sch) s
  JOIN (SELECT date AS d, ticker, score FROM sco) sco ON d = score_date)"""
PICKS = """
pck AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, ticker) AS INT) AS rank FROM soa WHERE score IS NOT NULL))"""
VALUES = f"""
adv AS (SELECT date, ticker, {full('avg', 'close * volume', 20)} AS adv FROM bars),
legs AS (SELECT b.date, b.ticker, CASE WHEN close >= open THEN 'buy' ELSE 'sell' END AS side, floor(close / 10) * 1000.0 AS value, adv
  FROM bars b JOIN adv ON b.date = adv.date AND b.ticker = adv.ticker WHERE adv IS NOT NULL)"""
SERIES = """
mn AS (SELECT date, coalesce(avg(ln(adj_close) - ln(pa)), 0) AS m FROM (SELECT date, adj_close, lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) AS pa FROM bars) GROUP BY date),
ser AS (
  SELECT 'index' AS series, date, 1000000.0 * index_close / first(index_close) OVER (ORDER BY date) AS total_value FROM idx
  UNION ALL SELECT 'mean', date, 1000000.0 * exp(sum(m) OVER (ORDER BY date)) FROM mn),
ret AS (SELECT * FROM (SELECT *, total_value / lag(total_value) OVER (PARTITION BY series ORDER BY date) - 1 AS ret FROM ser) WHERE ret IS NOT NULL),
dd AS (SELECT *, total_value / max(total_value) OVER (PARTITION BY series ORDER BY date) - 1 AS drawdown FROM ser),
run AS (SELECT *, sum(CAST(drawdown >= 0 AS INT)) OVER (PARTITION BY series ORDER BY date) AS run FROM dd),
mdd AS (SELECT series, min(m) AS max_drawdown, max(n) AS longest_underwater FROM (SELECT series, run, min(drawdown) AS m, count(*) FILTER (WHERE drawdown < 0) AS n FROM run GROUP BY 1, 2) GROUP BY 1),
prs AS (SELECT r.*, b.ret AS bench FROM ret r JOIN (SELECT date, ret FROM ret WHERE series = 'mean') b ON r.date = b.date),
pri AS (SELECT r.*, b.ret AS bench FROM ret r JOIN (SELECT date, ret FROM ret WHERE series = 'index') b ON r.date = b.date)"""
RF = "(pow(1.06, 1 / 252.0) - 1)"
WINDOWS = """
win(name, start, stop) AS (VALUES ('early', DATE '1995-03-01', DATE '1996-12-31'), ('middle', DATE '1997-01-01', DATE '1999-06-30'),
  ('late', DATE '1999-07-01', DATE '2001-12-31'), ('brief', DATE '1998-01-01', DATE '1998-01-15'))"""
PERIODS = f"""
per AS (SELECT k, date, ticker, coalesce((SELECT min(date) FROM sch s WHERE s.date > p.date), DATE '{END}') AS until, 1.0 / count(*) OVER (PARTITION BY k) AS weight
  FROM (SELECT * FROM pck WHERE rank <= {TOP}) p),
con AS (SELECT *, coalesce(p1 / p0 - 1, 0) AS period_return, weight * coalesce(p1 / p0 - 1, 0) AS contribution FROM (
  SELECT *, (SELECT min_by(adj_close, b.date) FROM bars b WHERE b.ticker = per.ticker AND b.date >= per.date) AS p0,
    (SELECT max_by(adj_close, b.date) FROM bars b WHERE b.ticker = per.ticker AND b.date <= per.until) AS p1 FROM per)),
att AS (SELECT ticker, sum(contribution) * 10000 AS total_bps, count(*) AS n_periods, avg(period_return) * 100 AS avg_period_return_pct FROM con GROUP BY ticker)"""
BENCH = """
mv AS (SELECT date, total_value FROM ser WHERE series = 'mean'),
ben AS (SELECT k, coalesce(coalesce(b, c) / a - 1, 0) AS bench FROM (SELECT k, (SELECT max_by(total_value, date) FROM mv WHERE mv.date <= q.date) AS a,
  (SELECT min_by(total_value, date) FROM mv WHERE mv.date >= q.until) AS b, (SELECT max_by(total_value, date) FROM mv WHERE mv.date <= q.until) AS c
  FROM (SELECT DISTINCT k, date, until FROM per) q))"""
ROUTE = "SELECT sch.date, max_by(fold_id, train_end) AS fold_id, max(train_end) AS train_end FROM sch LEFT JOIN {f} ON train_end + 5 < sch.date GROUP BY sch.date"
FB = BOUNDS.split("tst AS")[0].rstrip().rstrip(",")


def _cost_sql(fee: float) -> str:
    parts = {
        "brokerage": f"{fee}", "stt": "CASE WHEN side = 'sell' THEN value * 0.001 ELSE 0 END", "exchange_charges": "value * 0.0000345",
        "gst": f"({fee} + value * 0.0000345) * 0.18", "sebi_charges": "value * 0.000001", "stamp_duty": "CASE WHEN side = 'buy' THEN value * 0.00015 ELSE 0 END",
    }
    total = " + ".join(f"({p})" for p in parts.values())
    return with_bars(
        VALUES,
        select="SELECT date, ticker, side, " + ", ".join(f"CAST(round({p}, 6) AS DOUBLE) AS {n}" for n, p in parts.items()) + f", round({total}, 6) + 0.0 AS total FROM legs",
    )


T_STAT = "alpha / sqrt(sse / (n - 2) * (1.0 / n + mx * mx / (n * vp)))"


def _beyond(start: str) -> str:
    """The integral of cos^(n - 3) from ``start`` to a right angle, by midpoints."""
    h = f"(least(pi() / 2 - {start}, 12 / sqrt(n - 2)) / 20000)"
    return f"({h} * list_sum(list_transform(range(20000), lambda i: pow(cos({start} + (i + 0.5) * {h}), n - 3))))"


def _regress(table: str, name: str, p_value: bool = False) -> str:
    tail = f", round({_beyond('theta')} / {_beyond('0.0')}, 6) + 0.0 AS p_value" if p_value else ""
    return f"""SELECT series, round(alpha, 6) + 0.0 AS alpha, round(beta, 6) + 0.0 AS beta, round(t, 6) + 0.0 AS t{tail} FROM (
      SELECT *, {T_STAT} AS t, atan(abs({T_STAT}) / sqrt(n - 2)) AS theta FROM (
      SELECT *, my - beta * mx AS alpha, n * (vy - 2 * beta * cov + beta * beta * vp) AS sse FROM (
      SELECT series, count(*) AS n, avg(ret) AS my, avg(bench) AS mx, covar_pop(ret, bench) AS cov, var_pop(ret) AS vy, var_pop(bench) AS vp,
        covar_pop(ret, bench) / var_samp(bench) AS beta FROM {table} WHERE series = '{name}' GROUP BY series)))"""


GROW = "exp(sum(ln(1 + ret)))"

def _scenario_rows(names=None) -> str:
    return ", ".join(f"('{a}', {n}, {e}, {f}, {x})" for a, n, e, f, x in SCENARIOS if names is None or a in names)


def recursion_sql(scenarios: str, picks: str) -> tuple[str, ...]:
    """CTEs up to ``trd``, the legs of all rebalances, and ``dv``, the daily values: a recursion over a strategy's rebalances."""
    fee = "r.brokerage"
    return (
        f"scen(strategy_id, n_positions, every, brokerage, slip_scale) AS (VALUES {scenarios})",
        picks,
        "dts AS (SELECT DISTINCT strategy_id, k, date FROM pk)",
        """lg0 AS (SELECT strategy_id, k, ticker, max(p) AS is_pick, max(w) AS was_pick FROM (
          SELECT strategy_id, k, ticker, 1 AS p, 0 AS w FROM pk UNION ALL SELECT strategy_id, k + 1, ticker, 0, 1 FROM pk) GROUP BY 1, 2, 3)""",
        """lg1 AS (SELECT l.*, d.date, p.date AS prev_date FROM lg0 l JOIN dts d USING (strategy_id, k)
          LEFT JOIN dts p ON p.strategy_id = l.strategy_id AND p.k = l.k - 1)""",
        f"px AS MATERIALIZED (SELECT ticker, date AS pd, adj_close, {full('avg', 'close * volume', 20)} AS adv FROM bars)",
        "lg2 AS (SELECT lg1.*, px.adj_close AS price, px.adv FROM lg1 ASOF LEFT JOIN px ON lg1.ticker = px.ticker AND lg1.date >= px.pd)",
        "lg3 AS (SELECT lg2.*, px.adj_close AS before FROM lg2 ASOF LEFT JOIN px ON lg2.ticker = px.ticker AND lg2.prev_date >= px.pd)",
        """lg4 AS (SELECT *, CASE WHEN was_pick = 1 THEN coalesce(price / nullif(before, 0), 1) ELSE 1 END AS growth,
          row_number() OVER (PARTITION BY strategy_id, k ORDER BY ticker) AS i FROM lg3)""",
        "lg5 AS (SELECT *, CASE WHEN was_pick = 1 THEN lag(i) OVER (PARTITION BY strategy_id, ticker ORDER BY k) END AS prev FROM lg4)",
        """stp AS MATERIALIZED (SELECT strategy_id, k, date, list(struct_pack(ticker := ticker, is_pick := is_pick, growth := CAST(growth AS DOUBLE),
          adv := coalesce(adv, 0), price := price, prev := coalesce(prev, 0)) ORDER BY i) AS legs FROM lg5 GROUP BY ALL)""",
        f"""rec AS (
          SELECT strategy_id, n_positions, brokerage, slip_scale, CAST(-1 AS BIGINT) AS k, CAST(NULL AS DATE) AS date, CAST(0 AS DOUBLE) AS equity, CAST(1000000 AS DOUBLE) AS cash,
            CAST([] AS DOUBLE[]) AS held, CAST([] AS STRUCT(ticker VARCHAR, side VARCHAR, size DOUBLE, cost DOUBLE, bps DOUBLE, value DOUBLE, paid DOUBLE, price DOUBLE)[]) AS out
          FROM scen
          UNION ALL
          SELECT strategy_id, n_positions, brokerage, slip_scale, k, date, equity, equity - list_sum(list_transform(out, lambda x: x.paid + x.value)) AS cash,
            list_transform(out, lambda x: x.value) AS held, out
          FROM (SELECT *, list_transform(w4, lambda x: struct_pack(ticker := x.ticker, side := CASE WHEN x.size = 0 THEN NULL WHEN x.goal > x.now THEN 'buy' ELSE 'sell' END,
              size := x.size, cost := x.cost, bps := x.bps, value := CASE WHEN x.is_pick = 1 THEN (CASE WHEN x.size = 0 THEN x.now ELSE x.goal END) ELSE 0.0 END,
              paid := x.cost + x.size * x.bps / 1e4, price := x.price)) AS out
          FROM (SELECT *, list_transform(w3, lambda x: struct_insert(x, cost := CASE WHEN x.size = 0 THEN 0.0 ELSE
              ({fee} + x.size * {B.EXCHANGE}) * {1 + B.GST} + x.size * {B.SEBI} + x.size * (CASE WHEN x.goal > x.now THEN {B.STAMP_BUY} ELSE {B.STT_SELL} END)
              + x.size * x.bps / 1e4 END)) AS w4
          FROM (SELECT *, list_transform(w2, lambda x: struct_insert(x, bps := CASE WHEN x.size = 0 THEN 0.0 ELSE r.slip_scale * CASE WHEN x.adv <= 0 THEN {B.WORST_BPS}
              WHEN x.size / x.adv < {B.SLIPPAGE[0][0]} THEN {B.SLIPPAGE[0][1]} WHEN x.size / x.adv <= {B.SLIPPAGE[1][0]} THEN {B.SLIPPAGE[1][1]}
              WHEN x.size / x.adv <= {B.SLIPPAGE[2][0]} THEN {B.SLIPPAGE[2][1]} ELSE {B.WORST_BPS} END END)) AS w3
          FROM (SELECT *, list_transform(w1, lambda x: struct_insert(x, size := CASE WHEN abs(x.goal - x.now) >= 1 THEN abs(x.goal - x.now) ELSE 0.0 END)) AS w2
          FROM (SELECT *, list_transform(w0, lambda x: struct_insert(x, goal := CASE WHEN x.is_pick = 1 THEN r.equity / r.n_positions ELSE 0.0 END)) AS w1
          FROM (SELECT *, r.cash + list_sum(list_transform(w0, lambda x: x.now)) AS equity
          FROM (SELECT r.strategy_id, r.n_positions, r.brokerage, r.slip_scale, r.cash, s.k, s.date,
              list_transform(s.legs, lambda x: struct_insert(x, now := coalesce(r.held[x.prev], 0.0) * x.growth)) AS w0
            FROM rec r JOIN stp s ON s.strategy_id = r.strategy_id AND s.k = r.k + 1) r) r) r) r) r) r))""",
        """trd AS (SELECT strategy_id, k, date, cash, equity, slip_scale, x.ticker AS ticker, x.side AS side, x.size AS trade_value, x.cost AS cost, x.bps AS slip_bps,
          x.value AS value_after, x.price AS price FROM (SELECT *, unnest(out) AS x FROM rec WHERE k >= 0))""",
        """dys AS (SELECT t.strategy_id, d.date, t.k, t.cash FROM (SELECT strategy_id, date, k, cash FROM rec WHERE k >= 0) t
          JOIN (SELECT DISTINCT date FROM bars) d ON d.date >= t.date QUALIFY row_number() OVER (PARTITION BY t.strategy_id, d.date ORDER BY t.date DESC) = 1)""",
        """hv AS (SELECT y.strategy_id, y.date, h.ticker, h.value_after, h.price FROM dys y JOIN trd h ON h.strategy_id = y.strategy_id AND h.k = y.k AND h.value_after > 0)""",
        """hg AS (SELECT strategy_id, date, sum(value_after * coalesce(now / nullif(price, 0), 1)) AS gross_value, count(*) AS n_positions
          FROM (SELECT hv.*, px.adj_close AS now FROM hv ASOF LEFT JOIN px ON hv.ticker = px.ticker AND hv.date >= px.pd) GROUP BY 1, 2)""",
        """dv AS (SELECT y.strategy_id, y.date, coalesce(gross_value, 0) + cash AS total_value, cash, coalesce(n_positions, 0) AS n_positions, coalesce(gross_value, 0) AS gross_value
          FROM dys y LEFT JOIN hg USING (strategy_id, date))""",
    )


def _recursive(*ctes: str, select: str) -> str:
    return with_bars(*ctes, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


FASTEST_SCHEDULE = SCHEDULE.replace(f"% {EVERY} =", f"% {FASTEST} =").replace(f"n / {EVERY} AS", f"n / {FASTEST} AS")
TOP_OF = "pk AS (SELECT strategy_id, CAST(k / every AS INT) AS k, date, ticker FROM pck JOIN scen ON rank <= n_positions AND k % every = 0)"
PRIMARY = (S1, FASTEST_SCHEDULE, SCORES, PICKS, *recursion_sql(_scenario_rows(("primary",)), TOP_OF))
EVERY_SCENARIO = (S1, FASTEST_SCHEDULE, SCORES, PICKS, *recursion_sql(_scenario_rows(), TOP_OF))
EQUAL = (
    SCHEDULE,
    *recursion_sql(
        "('equal_weight', (SELECT count(DISTINCT ticker) FROM bars), 1, 0.0, 1.0)",
        "pk AS (SELECT 'equal_weight' AS strategy_id, k, date, ticker FROM sch, (SELECT DISTINCT ticker FROM bars))",
    ),
)


def _r4(*names: str) -> str:
    return ", ".join(f"round({n}, 4) + 0.0 AS {n}" for n in names)


DAILY = """SELECT strategy_id, date, n_positions, round(ln(total_value / 1000000), 6) + 0.0 AS log_growth, round(cash / total_value, 6) + 0.0 AS cash_share,
  round(gross_value / total_value, 6) + 0.0 AS gross_share FROM dv"""


ORACLE_SQL = {
    "b09_trade_legs": _recursive(
        *PRIMARY,
        select=f"""SELECT k, date, ticker, side, round(trade_value / equity, 6) + 0.0 AS share_of_equity, round(1e4 * cost / trade_value, 6) + 0.0 AS cost_bps,
        round(slip_bps, 6) + 0.0 AS slip_bps, slip_bps >= {B.WORST_BPS} * slip_scale AS flag FROM trd WHERE side IS NOT NULL""",
    ),
    "b10_portfolio": _recursive(*PRIMARY, select=DAILY),
    "b10_rebalance_log": _recursive(
        *PRIMARY,
        select=f"""SELECT strategy_id, k, date, count(*) FILTER (WHERE value_after > 0) AS n_picks, coalesce(string_agg(ticker, ',' ORDER BY ticker) FILTER (WHERE value_after > 0), '') AS picks,
        count(side) AS n_trades, count(*) FILTER (WHERE side IS NOT NULL AND slip_bps >= {B.WORST_BPS} * slip_scale) AS n_problematic_trades, round(sum(cost) / max(equity), 6) + 0.0 AS cost_share
        FROM trd GROUP BY 1, 2, 3""",
    ),
    "b12_equal_weight": _recursive(*EQUAL, select=DAILY),
    "b15_sensitivity": _recursive(
        *EVERY_SCENARIO,
        "rt AS (SELECT * FROM (SELECT strategy_id AS series, total_value / lag(total_value) OVER (PARTITION BY strategy_id ORDER BY date) - 1 AS ret FROM dv) WHERE ret IS NOT NULL)",
        f"st AS (SELECT series, pow({GROW}, 252.0 / count(*)) - 1 AS cagr, (avg(ret) - {RF}) / stddev_samp(ret) * sqrt(252) AS sharpe FROM rt GROUP BY series)",
        "ct AS (SELECT strategy_id AS series, sum(cost) AS total_cost, count(DISTINCT k) AS n_rebalances FROM trd GROUP BY 1)",
        select="SELECT series, n_rebalances, round(ln(1 + cagr), 4) + 0.0 AS log_cagr, round(sharpe, 4) + 0.0 AS sharpe, round(log10(total_cost), 4) + 0.0 AS log10_cost FROM st JOIN ct USING (series)",
    ),
    "q11_headline": _recursive(
        *PRIMARY, SERIES.split("ret AS (")[0].rstrip().rstrip(","),
        "sv AS (SELECT 'primary' AS series, date, total_value FROM dv UNION ALL SELECT * FROM ser)",
        "rt AS (SELECT * FROM (SELECT *, total_value / lag(total_value) OVER (PARTITION BY series ORDER BY date) - 1 AS ret FROM sv) WHERE ret IS NOT NULL)",
        "md AS (SELECT series, min(d) AS max_drawdown FROM (SELECT series, total_value / max(total_value) OVER (PARTITION BY series ORDER BY date) - 1 AS d FROM sv) GROUP BY 1)",
        f"""st AS (SELECT series, pow({GROW}, 252.0 / count(*)) - 1 AS cagr, stddev_samp(ret) * sqrt(252) AS volatility,
        (avg(ret) - {RF}) / stddev_samp(ret) * sqrt(252) AS sharpe FROM rt GROUP BY series)""",
        f"""ct AS (SELECT sum(cost) AS total_cost, count(DISTINCT k) AS n_rebalances, count(*) FILTER (WHERE side IS NOT NULL AND slip_bps >= {B.WORST_BPS} * slip_scale) AS n_flagged FROM trd)""",
        select=f"""SELECT series, n_rebalances, n_flagged, round(ln(1 + cagr), 4) + 0.0 AS log_cagr, {_r4('volatility', 'sharpe', 'max_drawdown')},
        round(log10(total_cost), 4) + 0.0 AS log10_cost FROM st JOIN md USING (series), ct""",
    ),
    "b01_fold_routing": with_bars(SCHEDULE, FB, select=ROUTE.format(f="fb")),
    "b02_frozen_fold": with_bars(SCHEDULE, FB, select=ROUTE.format(f="(SELECT * FROM fb WHERE fold_id = 2)")),
    "b03_scores_as_of": with_bars(S1, SCHEDULE, SCORES, select=f"SELECT k, date, score_date, ticker, {r6('score')} FROM soa"),
    "b03_missing_tickers": with_bars(
        S1, SCHEDULE, SCORES,
        select="SELECT k, t.ticker FROM (SELECT DISTINCT k FROM soa), (SELECT DISTINCT ticker FROM bars) t EXCEPT SELECT k, ticker FROM soa WHERE score IS NOT NULL",
    ),
    "b04_adv": with_bars(VALUES, select="SELECT date, ticker, round(adv, 4) + 0.0 AS adv FROM adv"),
    "b05_top_picks": with_bars(S1, SCHEDULE, SCORES, PICKS, select=f"SELECT k, date, score_date, ticker, {r6('score')}, rank FROM pck WHERE rank <= {TOP}"),
    "b06_costs": _cost_sql(0.0),
    "b07_flat_brokerage": _cost_sql(20.0),
    "b08_slippage": with_bars(
        VALUES,
        select="""SELECT date, ticker, CAST(bps AS DOUBLE) AS bps, bps >= 50 AS flag FROM (SELECT *, CASE WHEN adv <= 0 THEN 50 WHEN value / adv < 0.001 THEN 5
        WHEN value / adv <= 0.005 THEN 10 WHEN value / adv <= 0.01 THEN 20 ELSE 50 END AS bps FROM legs)""",
    ),
    "b11_daily_mark": with_bars(
        "sp AS (SELECT * FROM (SELECT DISTINCT date FROM bars), (SELECT DISTINCT ticker FROM bars))",
        select="""SELECT sp.date, sp.ticker, b.date AS price_date, round(b.adj_close, 6) + 0.0 AS price FROM sp ASOF LEFT JOIN bars b ON sp.ticker = b.ticker AND sp.date >= b.date""",
    ),
    "b13_daily_returns": with_bars(
        SERIES, select="SELECT series, date, round(total_value / lag(total_value) OVER (PARTITION BY series ORDER BY date) - 1, 6) + 0.0 AS ret FROM ser"
    ),
    "b14_rebased_index": with_bars(SERIES, select="SELECT date, round(total_value, 3) + 0.0 AS total_value FROM ser WHERE series = 'index'"),
    "b16_held_positions": with_bars(
        "en AS (SELECT ticker, min(date) AS entry_date, min_by(close, date) AS entry_price FROM bars WHERE date BETWEEN DATE '2000-06-01' AND DATE '2000-06-30' GROUP BY ticker)",
        select="""SELECT DATE '2000-08-07' AS date, en.ticker, 10 AS qty, entry_date, round(entry_price, 6) + 0.0 AS entry_price, round(coalesce(adj_close, close, entry_price), 6) + 0.0 AS current_mark,
        round(10 * coalesce(adj_close, close, entry_price), 6) + 0.0 AS mtm_value FROM en LEFT JOIN bars b ON en.ticker = b.ticker AND b.date = DATE '2000-08-07'""",
    ),
    "b17_live_index": with_bars(
        SERIES, "an AS (SELECT max(date) AS d, max_by(total_value, date) AS v FROM ser WHERE series = 'index' AND date <= DATE '2000-12-31')",
        select="SELECT i.date, round(v * i.index_close / a.index_close, 3) + 0.0 AS total_value FROM idx i, an JOIN idx a ON a.date = d WHERE i.date > d",
    ),
    "b18_anchor": with_bars(
        SERIES, select="SELECT max(date) AS date, round(max_by(total_value, date), 3) + 0.0 AS total_value FROM ser WHERE series = 'index' AND date <= DATE '2000-12-31'"
    ),
    "b19_complete_days": with_bars(select="SELECT date FROM bars GROUP BY date HAVING count(DISTINCT ticker) >= (SELECT count(DISTINCT ticker) FROM bars)"),
    "q01_growth": with_bars(SERIES, select=f"SELECT series, round({GROW} - 1, 6) + 0.0 AS total_return, round(pow({GROW}, 252.0 / count(*)) - 1, 6) + 0.0 AS cagr FROM ret GROUP BY series"),
    "q02_volatility": with_bars(SERIES, select="SELECT series, round(stddev_samp(ret) * sqrt(252), 6) + 0.0 AS volatility FROM ret GROUP BY series"),
    "q03_sharpe": with_bars(SERIES, select=f"SELECT series, round((avg(ret) - {RF}) / stddev_samp(ret) * sqrt(252), 6) + 0.0 AS sharpe FROM ret GROUP BY series"),
    "q04_sortino": with_bars(
        SERIES, select=f"SELECT series, round((avg(ret) - {RF}) / sqrt(avg(pow(ret - {RF}, 2)) FILTER (WHERE ret < {RF})) * sqrt(252), 6) + 0.0 AS sortino FROM ret GROUP BY series"
    ),
    "q05_max_drawdown": with_bars(SERIES, select=f"SELECT series, {r6('max_drawdown')}, longest_underwater FROM mdd"),
    "q06_calmar": with_bars(
        SERIES, select=f"SELECT ret.series, round((pow({GROW}, 252.0 / count(*)) - 1) / abs(any_value(max_drawdown)), 4) + 0.0 AS calmar FROM ret JOIN mdd ON ret.series = mdd.series GROUP BY 1"
    ),
    "q07_alpha_beta": with_bars(SERIES, select=_regress("prs", "index")),
    "q07_p_value": with_bars(SERIES, select=_regress("prs", "index", True)),
    "q08_information_ratio": with_bars(
        SERIES, select="SELECT series, round(avg(ret - bench) / stddev_samp(ret - bench) * sqrt(252), 6) + 0.0 AS information_ratio FROM prs WHERE series = 'index' GROUP BY series"
    ),
    "q09_bundle": with_bars(
        SERIES,
        select=f"""SELECT ret.series, count(*) AS n, round({GROW} - 1, 5) + 0.0 AS total_return, round(pow({GROW}, 252.0 / count(*)) - 1, 5) + 0.0 AS cagr,
        round(stddev_samp(ret) * sqrt(252), 5) + 0.0 AS volatility, round(any_value(max_drawdown), 5) + 0.0 AS max_drawdown, any_value(longest_underwater) AS longest_underwater
        FROM ret JOIN mdd ON ret.series = mdd.series GROUP BY 1""",
    ),
    "q10_windows": with_bars(
        SERIES, WINDOWS,
        """wv AS (SELECT name, ser.*, total_value / lag(total_value) OVER w - 1 AS r, total_value / max(total_value) OVER w - 1 AS dd FROM ser JOIN win ON date BETWEEN start AND stop
          WINDOW w AS (PARTITION BY name, series ORDER BY date))""",
        select="""SELECT name, series, count(*) AS n_days, round(max_by(total_value, date) / min_by(total_value, date) - 1, 5) + 0.0 AS cumulative_return,
        round(pow(max_by(total_value, date) / min_by(total_value, date), 252.0 / count(*)) - 1, 5) + 0.0 AS annualized_return, round(stddev_samp(r) * sqrt(252), 5) + 0.0 AS annualized_vol,
        round(min(dd), 5) + 0.0 AS max_drawdown FROM wv GROUP BY 1, 2 HAVING count(*) >= 5""",
    ),
    "q12_curve": with_bars(SERIES, select="SELECT series, date, round(total_value, 4) + 0.0 AS total_value, round(100 * drawdown, 4) + 0.0 AS drawdown_pct FROM dd"),
    "q13_monthly": with_bars(
        SERIES, select=f"SELECT series, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, round({GROW} - 1, 6) + 0.0 AS ret FROM ret GROUP BY 1, 2, 3"
    ),
    "q13_monthly_table": with_bars(
        SERIES,
        select="SELECT series, CAST(year(date) AS INT) AS year, " + ", ".join(f"round(exp(sum(ln(1 + ret)) FILTER (WHERE month(date) = {m})) - 1, 6) + 0.0 AS m{m}" for m in range(1, 13)) + " FROM ret WHERE series = 'index' GROUP BY 1, 2",
    ),
    "q14_second_benchmark": with_bars(SERIES, select=_regress("pri", "mean")),
    "q15_attribution": with_bars(
        S1, SCHEDULE, SCORES, PICKS, PERIODS,
        select="SELECT ticker, round(total_bps, 4) + 0.0 AS total_bps, n_periods, round(avg_period_return_pct, 4) + 0.0 AS avg_period_return_pct FROM att",
    ),
    "q16_period_benchmark": with_bars(S1, SCHEDULE, SCORES, PICKS, PERIODS, SERIES, BENCH, select=f"SELECT k, {r6('bench')} FROM ben"),
    "q17_counterfactual": with_bars(
        S1, SCHEDULE, SCORES, PICKS, PERIODS, SERIES, BENCH,
        "rk AS (SELECT ticker, row_number() OVER (ORDER BY total_bps DESC, ticker) AS place FROM att)",
        """pt AS (SELECT top, con.k, sum(CASE WHEN place <= top THEN weight * bench ELSE contribution END) AS r FROM con JOIN rk ON con.ticker = rk.ticker JOIN ben ON con.k = ben.k,
          (SELECT unnest([1, 3, 5, 10]) AS top) GROUP BY 1, 2)""",
        select="SELECT top, round(sum(ln(1 + r)), 5) + 0.0 AS log_growth FROM pt GROUP BY top",
    ),
    "q17_alpha": with_bars(
        S1, SCHEDULE, SCORES, PICKS, PERIODS, SERIES, BENCH,
        "rk AS (SELECT ticker, row_number() OVER (ORDER BY total_bps DESC, ticker) AS place FROM att)",
        """pt AS (SELECT top, con.k, sum(CASE WHEN place <= top THEN weight * bench ELSE contribution END) AS r FROM con JOIN rk ON con.ticker = rk.ticker JOIN ben ON con.k = ben.k,
          (SELECT unnest([0, 1, 3, 5, 10]) AS top) GROUP BY 1, 2)""",
        "yr AS (SELECT date_diff('day', min(date), max(until)) / 365.25 AS years FROM con)",
        "ix AS (SELECT exp(sum(ln(1 + bench)) / (SELECT years FROM yr)) - 1 AS g FROM ben)",
        "cf AS (SELECT top, exp(sum(ln(1 + r)) / (SELECT years FROM yr)) - 1 AS cagr FROM pt GROUP BY top)",
        "al AS (SELECT top, cagr, cagr - (SELECT g FROM ix) AS alpha, (SELECT cagr FROM cf WHERE top = 0) - cagr AS lost FROM cf)",
        select="""SELECT top, round(ln(1 + cagr), 5) + 0.0 AS log_cagr, round(sign(alpha) * ln(1 + abs(alpha)), 5) + 0.0 AS log_alpha,
        round(sign(lost) * ln(1 + abs(lost)), 5) + 0.0 AS log_alpha_drop FROM al""",
    ),
    "q18_overlap": with_bars(
        S1, SCHEDULE, SCORES, PICKS, PERIODS, WINDOWS,
        select="SELECT name, count(*) AS n_holds, count(DISTINCT ticker) AS n_tickers FROM per JOIN win ON date <= stop AND until >= start GROUP BY name",
    ),
    "q19_common_favourites": with_bars(
        S1, SCHEDULE, SCORES, PICKS,
        select=" INTERSECT ".join(f"(SELECT ticker FROM (SELECT ticker, count(*) AS n FROM pck WHERE rank <= {n} GROUP BY 1 ORDER BY n DESC, ticker LIMIT 10))" for n in (5, 3)),
    ),
    "q20_parity": with_bars(
        SERIES,
        select="""SELECT count(*) AS n, round(max(abs(a.total_value - b.total_value)), 3) + 0.0 AS max_abs, round(max(abs(a.total_value - b.total_value) / abs(a.total_value)), 3) + 0.0 AS max_rel
        FROM ser a JOIN ser b ON a.date = b.date WHERE a.series = 'index' AND b.series = 'mean'""",
    ),
    "q20_largest_gaps": with_bars(
        SERIES,
        """lg AS (SELECT a.date, a.total_value AS x, b.total_value AS y, abs(a.total_value - b.total_value) / abs(a.total_value) AS rel
        FROM ser a JOIN ser b ON a.date = b.date WHERE a.series = 'index' AND b.series = 'mean')""",
        select="""SELECT CAST(row_number() OVER (ORDER BY round(rel, 9) DESC, date) AS INT) AS place, date, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(rel, 3) + 0.0 AS rel
        FROM lg ORDER BY round(rel, 9) DESC, date LIMIT 5""",
    ),
    "q21_spot_check": with_bars(
        S1, SCHEDULE, SCORES, PICKS,
        "nr AS (SELECT date FROM sch ORDER BY abs(date_diff('day', date, DATE '1999-03-03')), date LIMIT 1)",
        select="""SELECT max(a.date) AS date, bool_and(a.ticker IS NOT NULL AND b.ticker IS NOT NULL) AS same_set, bool_and(coalesce(a.rank = b.rank, FALSE)) AS same_order,
        bool_and(coalesce(abs(a.score - b.score) <= 0.00005, FALSE)) AS same_score FROM (SELECT * FROM pck WHERE rank <= 5 AND date IN (SELECT date FROM nr)) a
        FULL JOIN (SELECT * FROM pck WHERE rank <= 3 AND date IN (SELECT date FROM nr)) b ON a.ticker = b.ticker""",
    ),
    "q22_top_and_bottom": with_bars(
        S1, SCHEDULE, SCORES, PICKS, PERIODS,
        select="""SELECT ticker, round(total_bps, 4) + 0.0 AS total_bps, 'top' AS side FROM (SELECT * FROM att ORDER BY total_bps DESC, ticker LIMIT 10)
        UNION ALL SELECT ticker, round(total_bps, 4) + 0.0, 'bottom' FROM (SELECT * FROM att ORDER BY total_bps, ticker LIMIT 10)""",
    ),
    "q22_concentration": with_bars(
        S1, SCHEDULE, SCORES, PICKS, PERIODS,
        "tp AS (SELECT total_bps, row_number() OVER (ORDER BY total_bps DESC, ticker) AS p FROM att WHERE total_bps > 0)",
        "tq AS (SELECT sum(total_bps) FILTER (WHERE p <= 3) AS b, sum(total_bps) AS a FROM tp)",
        select="SELECT round(b / a, 4) + 0.0 AS top_share, round(b, 4) + 0.0 AS top_bps, b / a > 0.5 AND b > 200 AS concentrated FROM tq",
    ),
}
