"""Rules of warm-up, ties, nulls and recursion on hand-made panels, and the portfolio recursion against a plain loop."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions import smoothers as S
from barloom.functions.features import per_ticker
from barloom.operators import folds, labels, metrics, performance, portfolio, validation
from barloom.operators.windows import as_of, average_rank
from barloom.plans.panel import bars
from barloom.sources import bars as sources

BARS = "date date, ticker string, open double, high double, low double, close double, volume long, adj_close double"
DAY = dt.date(2020, 1, 1)


def panel(spark, n, tickers=2):
    rows = []
    for k in range(tickers):
        price, noise = 100.0 + 10 * k, 7 + k
        for i in range(n):
            noise = (noise * 1103515245 + 12345) % 2**31
            price += math.sin(i / 30) * 0.5 + (noise / 2**31 - 0.5)
            rows.append((DAY + dt.timedelta(i), f"T{k}", price - 0.3, price + 1.0, price - 1.5, price, 1000 + noise % 500, price))
    return spark.createDataFrame(rows, BARS)


def test_smoothers():
    assert S.ewm([None, 1.0, 3.0], 0.5, 2) == [None, None, 2.0]
    made = lambda high, low, close: S.Smoothers(close, high, low, close, close)
    assert made([1.0] * 20, [1.0] * 20, [1.0] * 20).rsi(14) == [50.0] * 20
    flat = made([2.0] * 30, [1.0] * 30, [1.5] * 30).directional
    assert flat[0][12] is None and flat[0][13] == 0.0
    assert made([1.0] * 10, [1.0] * 10, [1.0] * 10).supertrend() == [None] * 10
    assert made([3.0, 5.0], [1.0, 4.0], [2.0, 4.5]).true_range == [2.0, 3.0]


@pytest.mark.parametrize("cut", [0, 1, 9, 10, 11, 60, 119])
def test_smoothers_go_on_from_their_state(cut):
    rng = random.Random(3)
    close = [100.0]
    for _ in range(119):
        close.append(close[-1] + rng.uniform(-3, 3))
    bars = {"open_": [c - 0.5 for c in close], "high": [c + rng.random() for c in close], "low": [c - 1 for c in close], "close": close, "adj_close": close}
    whole = S.Smoothers(**bars)
    state = {}
    first = S.Smoothers(**{k: v[:cut] for k, v in bars.items()}, state=state)
    a = {name: make(first) for name, make in S.MAKE.items()}
    second = S.Smoothers(**{k: v[cut:] for k, v in bars.items()}, state=first.end())
    for name, make in S.MAKE.items():
        assert a[name] + make(second) == make(whole), name
    assert second.end() == whole.end()


def test_features_do_not_look_ahead(spark):
    columns = ["dist_sma_20_pct", "dist_ema_20_pct", "rsi_14", "adx_14", "supertrend_10_3", "realized_vol_20d", "obv", "up_streak_length", "trend_strength_smoothed", "aroon_up_25"]
    whole = panel(spark, 120)
    cut = DAY + dt.timedelta(79)
    a = {(r.date, r.ticker): r for r in per_ticker(whole, columns).where(F.col("date") <= cut).collect()}
    b = {(r.date, r.ticker): r for r in per_ticker(whole.where(F.col("date") <= cut), columns).collect()}
    assert a.keys() == b.keys()
    for key, r in a.items():
        for c in columns:
            assert r[c] == b[key][c] or r[c] == pytest.approx(b[key][c], abs=1e-9), (key, c)


def test_warm_up(spark):
    rows = per_ticker(panel(spark, 40, 1), ["ret_5d", "dist_sma_20_pct", "rsi_14", "trend_aligned_5_20_50", "realized_vol_20d", "up_streak_length"]).orderBy("date").collect()
    assert rows[4].ret_5d is None and rows[5].ret_5d is not None
    assert rows[18].dist_sma_20_pct is None and rows[19].dist_sma_20_pct is not None
    assert rows[19].realized_vol_20d is None and rows[20].realized_vol_20d is not None
    assert rows[0].rsi_14 == 50.0 and rows[0].trend_aligned_5_20_50 == 0 and rows[0].up_streak_length == 0


def test_average_rank_and_labels_on_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, None), (1, 1.0)], "d int, x double")
    assert sorted((r[0] is None, r[0] or 0) for r in df.select(average_rank(F.col("x"), ["d"])).collect()) == [(False, 1.0), (False, 2.5), (False, 2.5), (True, 0)]
    flat = spark.createDataFrame([(DAY + dt.timedelta(i), f"T{k}", 1.0) for i in range(7) for k in range(3)], "date date, ticker string, adj_close double")
    found = labels.forward_labels(flat, [5]).where("forward_ret_5d IS NOT NULL").collect()
    assert {r.outperforms_universe_median_5d for r in found} == {0} and len(found) == 6
    with pytest.raises(ValueError):
        labels.forward_labels(flat, [0])


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("strict,forward,want", [(False, False, 3), (True, False, 1), (False, True, 3), (True, True, 5)])
def test_as_of(spark, by, strict, forward, want):
    left = spark.createDataFrame([("a", 3), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", x) for x in (1, 3, 5)], "k string, u int")
    right = right if by else right.select("u")
    found = {r.k: r.u for r in as_of(left, right, "t", "u", by=by, strict=strict, forward=forward).collect()}
    assert found == {"a": want, "b": None if by else want}


def test_quarters_keep_the_day_cap(spark):
    d = spark.sql("SELECT DATE'2021-11-05' AS d").select(folds.quarter_end(F.col("d")).alias("q"), folds.add_quarters(folds.quarter_end(F.col("d")), F.lit(0)).alias("c")).first()
    assert (d.q, d.c) == (dt.date(2021, 12, 31), dt.date(2021, 12, 28))


def test_embargo_is_strict(spark):
    f = spark.createDataFrame([(0, dt.date(2020, 1, 1)), (1, dt.date(2020, 2, 1))], "fold_id int, train_end date")
    days = spark.createDataFrame([(dt.date(2020, 1, 6),), (dt.date(2020, 1, 7),), (dt.date(2020, 3, 1),)], "date date")
    assert {r.date.isoformat(): r.fold_id for r in folds.route(days, f, 5).collect()} == {"2020-01-06": None, "2020-01-07": 0, "2020-03-01": 1}


def test_permutations_are_centred(spark):
    rows = [(DAY + dt.timedelta(d), f"T{i}", 1, i / 20, float(i)) for d in range(10) for i in range(20)]
    df = spark.createDataFrame(rows, "date date, ticker string, label int, predicted_proba double, actual_return double")
    null = metrics.permuted_ics(df, 30)
    found = metrics.permutation_summary(null, metrics.ic_summary(metrics.information_coefficient(df))).first()
    assert found.p_value == 0.0 and abs(found.null_mean) < 0.1 and null.count() == 30


def test_permutations_of_many_features_are_those_of_one(spark):
    rng = random.Random(2)
    rows = []
    for d in range(8):
        for i in range(12):
            x = None if rng.random() < 0.1 else float(rng.randint(0, 5))
            rows.append((DAY + dt.timedelta(d), f"T{i}", x, rng.random(), None if rng.random() < 0.1 else rng.random(), 1.0))
    df = spark.createDataFrame(rows, "date date, ticker string, f double, g double, actual_return double, flat double")
    many = {(r.feature, r.draw): r.ic_mean for r in metrics.permuted_feature_ics(df, ["f", "g", "flat"], "actual_return", 20, seed=3).collect()}
    assert {k[0] for k in many} == {"f", "g"} and len(many) == 40
    for name in ("f", "g"):
        one = metrics.permuted_ics(df.withColumn("predicted_proba", F.col(name)), 20, seed=3).collect()
        assert {(name, r.draw): pytest.approx(r.ic_mean) for r in one} == {k: v for k, v in many.items() if k[0] == name}
    assert metrics.permuted_feature_ics(df.limit(0), ["f"], "actual_return", 5).collect() == []


@pytest.mark.parametrize("t,df,want", [(0.0, 10, 1.0), (2.228, 10, 0.05), (1.96, 1_000_000, 0.05), (12.706, 1, 0.05), (3.499, 7, 0.01), (3.3, 350, 0.001067)])
def test_p_value_of_student_t(spark, t, df, want):
    one = spark.range(1).select(performance.p_value(F.lit(t), F.lit(df)).alias("p")).first()
    assert one.p == pytest.approx(want, abs=2e-5)


def plain_portfolio(prices, picks, n, capital):
    """Daily values by a loop over days: prices[day][ticker], picks[day] (all turnover unknown: the worst slippage)."""
    cash, shares, out = capital, {}, []
    for day in sorted(prices):
        p = prices[day]
        if day in picks:
            equity = cash + sum(s * p[t] for t, s in shares.items())
            goal = {t: 0.0 for t in shares} | {t: equity / n for t in picks[day]}
            for t, g in goal.items():
                gap = g - shares.get(t, 0.0) * p[t]
                if abs(gap) < 1.0:
                    continue
                v = abs(gap)
                charges = v * 0.0000345 * 1.18 + v * 0.000001 + (v * 0.00015 if gap > 0 else v * 0.001)
                cash -= gap + charges + 2 * v * 50 / 1e4
                shares[t] = shares.get(t, 0.0) + gap / p[t]
            shares = {t: s for t, s in shares.items() if t in picks[day]}
        out.append(cash + sum(s * p[t] for t, s in shares.items()))
    return out


def test_portfolio_equals_a_plain_loop(spark):
    b = panel(spark, 19, 4)
    rows = b.collect()
    prices = {}
    for r in rows:
        prices.setdefault(r.date, {})[r.ticker] = r.adj_close
    days = sorted(prices)
    picks = {days[0]: ["T0", "T1"], days[6]: ["T1", "T2"], days[12]: ["T3", "T1"]}
    frame = spark.createDataFrame([("s", k, d, t) for k, d in enumerate(sorted(picks)) for t in picks[d]], "strategy_id string, k int, date date, ticker string")
    scenario = spark.createDataFrame([("s", 2, 0.0, 1.0)], "strategy_id string, n_positions int, brokerage double, slip_scale double")
    trades = portfolio.rebalance(frame, b, scenario)
    found = [r.total_value for r in portfolio.daily_values(trades, b).orderBy("date").collect()]
    assert found == pytest.approx(plain_portfolio(prices, picks, 2, 1_000_000.0), rel=1e-12)


@pytest.mark.parametrize("share,bps", [(0.0005, 5.0), (0.001, 10.0), (0.005, 10.0), (0.01, 20.0), (0.011, 50.0)])
def test_slippage_bounds(spark, share, bps):
    one = spark.range(1).select(portfolio.slippage_bps(F.lit(share * 1e6), F.lit(1e6)).alias("a"), portfolio.slippage_bps(F.lit(1.0), F.lit(0.0)).alias("b")).first()
    assert (one.a, one.b) == (bps, 50.0)


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([("2020-01-02", 1.0, 2.0, 0.5, 1.5, 10), ("2020-01-03", None, 2.0, 0.5, 1.5, 10)], "Datetime string, Open double, High double, Low double, Close double, Volume long")
    found = sources.normalise(raw, "X").collect()
    assert len(found) == 1 and found[0].adj_close == 1.5 and found[0].ticker == "X"
    with pytest.raises(ValueError):
        sources.enforce(raw)
    b = panel(spark, 3)
    path = sources.write_table(b, str(tmp_path / "t"))
    sources.write_table(b.where("ticker = 'T0'").limit(1), str(tmp_path / "t"))
    assert {r.ticker: r["count"] for r in spark.read.parquet(path).groupBy("ticker").count().collect()} == {"T0": 1, "T1": 3}
    merged = sources.upsert(b, b.where("ticker = 'T1'").withColumn("close", F.lit(0.0)))
    assert merged.count() == 6 and merged.where("close = 0").count() == 3
    assert validation.validate(b.limit(0), "2030-01-01").collect() == []


def test_bars_of_the_tables(spark, sf_dir):
    found = bars(spark, sf_dir)
    assert found.columns == ["date", "ticker", "open", "high", "low", "close", "volume", "adj_close", "sector"]
    assert validation.validate(found, "2030-01-01").where("severity = 'error'").count() == 0
