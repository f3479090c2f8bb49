"""Performance statistics of value series (series, date, total_value), attribution of holdings, and comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_join, points_in
from .portfolio import returns
from .windows import as_of

YEAR = 252.0
RISK_FREE = 0.06


def _daily_risk_free() -> float:
    return (1 + RISK_FREE) ** (1 / YEAR) - 1


def growth(r: Column) -> Column:
    """Product of 1 + r."""
    return F.product(1 + r)


def cagr(r: Column) -> Column:
    return F.pow(growth(r), YEAR / F.count(r)) - 1


def volatility(r: Column) -> Column:
    return F.stddev_samp(r) * math.sqrt(YEAR)


def sharpe(r: Column) -> Column:
    return F.try_divide(F.avg(r) - _daily_risk_free(), F.nullif(F.stddev_samp(r), F.lit(0.0))) * math.sqrt(YEAR)


def sortino(r: Column) -> Column:
    """Mean excess over the root mean square of the negative excesses alone; infinite without any."""
    x = r - _daily_risk_free()
    down = F.sqrt(F.avg(F.when(x < 0, x * x)))
    return F.when(F.count(r) < 2, None).when(F.coalesce(down, F.lit(0.0)) == 0, float("inf")).otherwise(F.avg(x) / F.nullif(down, F.lit(0.0)) * math.sqrt(YEAR))


def drawdowns(values: DataFrame, by: Sequence[str] = ("series",)) -> DataFrame:
    """Adds ``drawdown`` against the running peak, and ``run``, which numbers the stretches between peaks."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    v = values.withColumn("drawdown", F.try_divide(F.col("total_value"), F.max("total_value").over(w)) - 1)
    return v.withColumn("run", F.sum((F.col("drawdown") >= 0).cast("int")).over(w))


def max_drawdown(values: DataFrame, by: Sequence[str] = ("series",)) -> DataFrame:
    """max_drawdown (not positive) and longest_underwater, in rows, per series."""
    d = drawdowns(values, by).groupBy(*by, "run").agg(F.min("drawdown").alias("m"), F.count_if(F.col("drawdown") < 0).alias("n"))
    return d.groupBy(*by).agg(F.min("m").alias("max_drawdown"), F.max("n").alias("longest_underwater"))


def p_value(t: Column, df: Column, steps: int = 20_000) -> Column:
    """Two-sided p-value of Student's t >= 0: the share of the integral of cos^(df - 1) that lies beyond atan(t / sqrt(df)).

    Both integrals are sums over ``steps`` midpoints, so that this is an expression like any other: one row per series.
    Further than 12 / sqrt(df) on, a share of e^-72 is left.
    """

    def integral(start: Column) -> Column:
        h = F.least(F.lit(math.pi / 2) - start, 12.0 / F.sqrt(df.cast("double"))) / steps
        points = F.sequence(F.lit(0), F.lit(steps - 1))
        return h * F.aggregate(points, F.lit(0.0), lambda total, i: total + F.pow(F.cos(start + (i + 0.5) * h), df - 1))

    return integral(F.atan(t / F.sqrt(df.cast("double")))) / integral(F.lit(0.0))


def alpha_beta(pairs: DataFrame, by: Sequence[str] = ("series",), y: str = "ret", x: str = "bench") -> DataFrame:
    """alpha (per row), beta, t and p_value of the regression of y on x; beta divides the population covariance by the
    sample variance. Under 30 rows alpha and beta are null and p is 1. All of it follows from one pass of sums."""
    ok = pairs.where(f"{y} IS NOT NULL AND {x} IS NOT NULL AND NOT isnan({y}) AND NOT isnan({x})")
    s = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.avg(x).alias("mx"), F.covar_pop(y, x).alias("cov"),
        F.var_samp(x).alias("vx"), F.var_pop(y).alias("vy"), F.var_pop(x).alias("vp"),
    )
    beta = F.when(F.col("vx") > 0, F.try_divide("cov", "vx")).otherwise(0.0)
    s = s.withColumn("beta", beta).withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx"))
    sse = F.col("n") * (F.col("vy") - 2 * F.col("beta") * F.col("cov") + F.col("beta") * F.col("beta") * F.col("vp"))
    se = F.sqrt(F.try_divide(sse, F.col("n") - 2) * (F.lit(1.0) / F.col("n") + F.try_divide(F.col("mx") * F.col("mx"), F.col("n") * F.col("vp"))))
    s = s.withColumn("t", F.coalesce(F.try_divide("alpha", se), F.lit(0.0)))
    few = F.col("n") < 30
    return s.select(
        *by, F.when(~few, F.col("alpha")).alias("alpha"), F.when(~few, F.col("beta")).alias("beta"),
        F.when(~few, F.col("t")).alias("t"), F.when(few, 1.0).otherwise(p_value(F.abs("t"), F.col("n") - 2)).alias("p_value"),
    )


def information_ratio(y: Column, x: Column) -> Column:
    d = y - x
    return F.when(F.count(d) < 2, None).when(F.stddev_samp(d) == 0, 0.0).otherwise(F.avg(d) / F.nullif(F.stddev_samp(d), F.lit(0.0)) * math.sqrt(YEAR))


def against(values: DataFrame, benchmark: str) -> DataFrame:
    """Returns of every series on the dates it shares with the benchmark, whose return is ``bench``."""
    r = returns(values)
    b = r.where(F.col("series") == benchmark).select("date", F.col("ret").alias("bench"))
    return r.join(b, "date")


def bundle(values: DataFrame, benchmark: str) -> DataFrame:
    """One row per series: return, growth rate, volatility, ratios, drawdown, and alpha and beta against the benchmark."""
    pairs = against(values, benchmark).where("ret IS NOT NULL")
    r = F.col("ret")
    stats = pairs.groupBy("series").agg(
        F.count(r).alias("n"), (growth(r) - 1).alias("total_return"), cagr(r).alias("cagr"), volatility(r).alias("volatility"),
        sharpe(r).alias("sharpe"), sortino(r).alias("sortino"), information_ratio(r, F.col("bench")).alias("information_ratio"),
    )
    out = stats.join(max_drawdown(values), "series").join(alpha_beta(pairs).select("series", "alpha", "beta"), "series")
    return out.withColumn("calmar", F.try_divide("cagr", F.abs("max_drawdown")))


def window_breakdown(values: DataFrame, windows: DataFrame, least: int = 5) -> DataFrame:
    """Per named window (name, start, stop: a small table) and series: rows, return, yearly return, volatility, drawdown."""
    v = points_in(values, windows, "date", "start", "stop").drop("start", "stop")
    by = ["name", "series"]
    r = returns(v, by)
    first, last = F.min_by("total_value", "date"), F.max_by("total_value", "date")
    n = F.count(F.lit(1))
    s = r.groupBy(*by).agg(
        n.alias("n_days"), (last / first - 1).alias("cumulative_return"), (F.pow(last / first, YEAR / n) - 1).alias("annualized_return"),
        volatility(F.col("ret")).alias("annualized_vol"),
    )
    return s.where(F.col("n_days") >= least).join(max_drawdown(v, by).drop("longest_underwater"), by)


def monthly_returns(values: DataFrame) -> DataFrame:
    """series, year, month, ret: returns compounded within each month."""
    r = returns(values).where("ret IS NOT NULL")
    return r.groupBy("series", F.year("date").alias("year"), F.month("date").alias("month")).agg((growth(F.col("ret")) - 1).alias("ret"))


def monthly_table(values: DataFrame) -> DataFrame:
    """Years by months of one series or more: columns m1 to m12."""
    t = monthly_returns(values).groupBy("series", "year").pivot("month", list(range(1, 13))).agg(F.first("ret"))
    return t.select("series", "year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


def holding_periods(picks: DataFrame, end: str) -> DataFrame:
    """picks (k, date, ticker) with ``until``, the next rebalance or ``end``, and the ``weight`` of each pick."""
    d = picks.select("k", "date").distinct()
    d = d.withColumn("until", F.coalesce(F.lead("date").over(Window.partitionBy(F.lit(1)).orderBy("k")), F.lit(end).cast("date")))
    n = F.count(F.lit(1)).over(Window.partitionBy("k"))
    return picks.select("k", "ticker").join(d, "k").withColumn("weight", 1.0 / n)


def contributions(periods: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds ``period_return`` (first price from the start on, to the last up to the end; 0 if missing) and ``contribution``."""
    p = bars.select("ticker", F.col("date").alias("first_date"), F.col("adj_close").alias("first_price"))
    q = bars.select("ticker", F.col("date").alias("last_date"), F.col("adj_close").alias("last_price"))
    out = as_of(as_of(periods, p, "date", "first_date", by=["ticker"], forward=True), q, "until", "last_date", by=["ticker"])
    r = F.coalesce(F.try_divide("last_price", "first_price") - 1, F.lit(0.0))
    return out.withColumn("period_return", r).withColumn("contribution", F.col("weight") * r).drop("first_date", "first_price", "last_date", "last_price")


def attribution(contributed: DataFrame) -> DataFrame:
    """Per ticker: total contribution in basis points, periods held, and mean return of a period in percent."""
    return contributed.groupBy("ticker").agg(
        (F.sum("contribution") * 10_000).alias("total_bps"), F.count(F.lit(1)).alias("n_periods"), (F.avg("period_return") * 100).alias("avg_period_return_pct")
    )


def period_benchmark(periods: DataFrame, values: DataFrame) -> DataFrame:
    """k, bench: the benchmark's return from the last value up to the start to the first from the end on (else the last before it)."""
    p = periods.select("k", "date", "until").distinct()
    s = values.select(F.col("date").alias("_s"), F.col("total_value").alias("_a"))
    e = values.select(F.col("date").alias("_e"), F.col("total_value").alias("_b"))
    z = values.select(F.col("date").alias("_z"), F.col("total_value").alias("_c"))
    p = as_of(as_of(as_of(p, s, "date", "_s"), e, "until", "_e", forward=True), z, "until", "_z")
    return p.select("k", F.coalesce(F.try_divide(F.coalesce("_b", "_c"), F.col("_a")) - 1, F.lit(0.0)).alias("bench"))


def counterfactual(contributed: DataFrame, bench: DataFrame, tops: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """top, total_return: the strategy if its best contributors had earned the benchmark's return of each period."""
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("total_bps").desc(), "ticker"))  # one row per ticker
    ranked = attribution(contributed).select("ticker", place.alias("place"))
    rows = contributed.join(ranked, "ticker").join(bench, "k").withColumn("top", F.explode(F.array(*[F.lit(t) for t in tops])))
    part = F.when(F.col("place") <= F.col("top"), F.col("weight") * F.col("bench")).otherwise(F.col("contribution"))
    per = rows.groupBy("top", "k").agg(F.sum(part).alias("r"))
    return per.groupBy("top").agg((growth(F.col("r")) - 1).alias("total_return"))


def counterfactual_growth(contributed: DataFrame, bench: DataFrame, tops: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """top, cagr, alpha, alpha_drop: yearly growth without the best contributors, over the benchmark's, and what that loses.

    Years have 365.25 days, from the first holding to the end of the last; the benchmark compounds its returns of the same
    periods, and the loss is against nobody replaced (top 0, which is returned too).
    """
    yearly = lambda total: F.pow(1 + total, 1 / F.col("years")) - 1
    span = contributed.agg((F.datediff(F.max("until"), F.min("date")) / 365.25).alias("years"))
    index = bench.join(contributed.select("k").distinct(), "k").agg((growth(F.col("bench")) - 1).alias("index_return"))
    found = counterfactual(contributed, bench, (0, *tops)).crossJoin(span.crossJoin(index))  # one row
    found = found.select("top", yearly(F.col("total_return")).alias("cagr"), (yearly(F.col("total_return")) - yearly(F.col("index_return"))).alias("alpha"))
    before = found.where("top = 0").select(F.col("alpha").alias("before"))
    return found.crossJoin(before).select("top", "cagr", "alpha", (F.col("before") - F.col("alpha")).alias("alpha_drop"))  # one row


def overlapping_holds(periods: DataFrame, windows: DataFrame) -> DataFrame:
    """name, n_holds, n_tickers: holding periods that overlap each named window."""
    return (
        overlap_join(periods, windows, ("date", "until"), ("start", "stop"))
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("n_holds"), F.countDistinct("ticker").alias("n_tickers"))
    )


def most_held(picks: DataFrame, n: int) -> DataFrame:
    """The n tickers picked most often."""
    return picks.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_holds")).orderBy(F.col("n_holds").desc(), "ticker").limit(n)


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """n, max_abs, max_rel: the differences of two value series on their common dates."""
    both = a.select("date", F.col("total_value").alias("x")).join(b.select("date", F.col("total_value").alias("y")), "date")
    gap = F.abs(F.col("x") - F.col("y"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("max_abs"), F.max(F.try_divide(gap, F.abs("x"))).alias("max_rel"))


def largest_gaps(a: DataFrame, b: DataFrame, n: int = 5) -> DataFrame:
    """place, date, x, y, rel: the n common dates on which two value series differ most in proportion, ties to the earlier."""
    both = a.select("date", F.col("total_value").alias("x")).join(b.select("date", F.col("total_value").alias("y")), "date")
    both = both.withColumn("rel", F.try_divide(F.abs(F.col("x") - F.col("y")), F.abs("x"))).where("rel IS NOT NULL")
    best = both.orderBy(F.round("rel", 9).desc(), "date").limit(n)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.round("rel", 9).desc(), "date")))


def spot_check(picks: DataFrame, others: DataFrame, target: str, tolerance: float = 5e-5) -> DataFrame:
    """date, same_set, same_order, same_score: two runs compared at the rebalance nearest to a date."""
    gap = F.abs(F.datediff(F.col("date"), F.lit(target).cast("date")))
    nearest = picks.agg(F.min_by("date", F.struct(gap, F.col("date"))).alias("date"))
    a = picks.join(nearest, "date").select("date", "ticker", F.col("rank").alias("ra"), F.col("score").alias("sa"))
    b = others.join(nearest, "date").select("ticker", F.col("rank").alias("rb"), F.col("score").alias("sb"))
    both = a.join(b, "ticker", "full")
    known = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    return both.agg(
        F.max("date").alias("date"), F.every(known).alias("same_set"), F.every(known & (F.col("ra") == F.col("rb"))).alias("same_order"),
        F.every(known & (F.abs(F.col("sa") - F.col("sb")) <= tolerance)).alias("same_score"),
    )


def concentration(attributed: DataFrame, n: int = 3, broad_bps: float = 200.0) -> DataFrame:
    """top_share: what the n best give of all that is positive; concentrated if they hold over half of it and ``broad_bps``."""
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("total_bps").desc(), "ticker"))
    t = attributed.withColumn("_p", place)
    best = F.sum(F.when((F.col("_p") <= n) & (F.col("total_bps") > 0), F.col("total_bps")))
    everything = F.sum(F.when(F.col("total_bps") > 0, F.col("total_bps")))
    one = t.agg(F.try_divide(best, everything).alias("top_share"), best.alias("top_bps"))
    return one.withColumn("concentrated", (F.col("top_share") > 0.5) & (F.col("top_bps") > broad_bps))
