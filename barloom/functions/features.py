"""Per-ticker features of dated bars, as window expressions over one partitioning by ticker.

Every window counts rows, not days, and is null until it is full, unless its comment says otherwise. Returns,
averages and oscillators of the close use ``adj_close``; ranges, gaps and volumes use the bars as traded.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import change, dealt, forward_fill, full, lag, last_rows, nearest, over, run_id, so_far, sorted_rows
from .smoothers import COLUMNS as SMOOTHED
from .smoothers import with_smoothers

YEAR = math.sqrt(252)
c = F.col
#: Features made from recursive columns, and which.
OF_SMOOTHED = {
    **{f"dist_ema_{n}_pct": [f"ema_{n}"] for n in (20, 50, 200)},
    "macd_hist": ["macd", "macd_signal"],
    "momentum_div_flag": ["rsi_14"],
    "regime_adjusted_rsi": ["rsi_14"],
}


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def per_ticker(bars: DataFrame, columns: Iterable[str] | None = None, parts: int | None = None) -> DataFrame:
    """``bars`` with the features named in ``columns`` (all by default).

    The frame is a chain of projections, each with the windows whose inputs the one before has made; all share the
    partitioning by ticker, so there is one shuffle and one sort, and columns that nobody asks for are pruned. The
    grouped pass of the recursive smoothers is part of the plan only if a feature needs it and ``bars`` does not bring its column.
    Where the bars before are known by what they came to, ``bars`` has ``is_new`` and, in each ticker's last row that is not, ``seed``
    (obv, accum_dist_line, consecutive_days_above_sma50): sums without a bound go on from there.
    """
    wanted = None if columns is None else set(columns)
    smoothed = {x for x in SMOOTHED if wanted is None or x in wanted}
    smoothed |= {x for name, needs in OF_SMOOTHED.items() if wanted is None or name in wanted for x in needs}
    have = set(bars.columns)
    df = dealt(bars, "ticker", parts=parts)
    df = with_smoothers(df, smoothed - have) if smoothed - have else df

    def seeded(step: Column, name: str) -> Column:
        return step if "seed" not in have else F.when(c("seed").isNotNull(), c(f"seed.{name}")).when(c("is_new"), step).otherwise(0)

    adj = c("adj_close")
    spread = c("high") - c("low")
    df = df.withColumns(
        {
            **{f"ret_{n}d": change(adj, n) for n in (1, 5, 10, 20, 60)},
            **{f"roc_{n}d": 100 * change(adj, n) for n in (5, 10, 20)},
            "log_ret_1d": F.ln(adj) - lag(F.ln(adj)),
            "_pc": lag(c("close")),
            **{f"_sma{n}": full(F.avg, adj, n) for n in (5, 20, 50, 200)},
            "_hi252": full(F.max, adj, 252),
            "_lo252": full(F.min, adj, 252),
            "_hl2": F.pow(F.ln(_ratio(c("high"), c("low"))), 2),
            "_gk": 0.5 * F.pow(F.ln(_ratio(c("high"), c("low"))), 2)
            - (2 * math.log(2) - 1) * F.pow(F.ln(_ratio(c("close"), c("open"))), 2),
            "_hh14": full(F.max, c("high"), 14),
            "_ll14": full(F.min, c("low"), 14),
            "range_pct_close": 100 * _ratio(spread, c("close")),
            "close_pos_in_range": F.when(spread != 0, _ratio(c("close") - c("low"), spread)),
            "body_to_range": F.when(spread != 0, _ratio(F.abs(c("close") - c("open")), spread)),
            "typical_price_dev_pct": 100 * _ratio(c("close") - (c("high") + c("low") + c("close")) / 3, (c("high") + c("low") + c("close")) / 3),
            "_ha": (c("open") + c("high") + c("low") + c("close")) / 4,
            "_row": F.row_number().over(over()),
            "_vol": c("volume").cast("double"),
            "turnover": c("close") * c("volume"),
        }
    )
    gap = _ratio(c("open") - c("_pc"), c("_pc"))
    money = _ratio((c("close") - c("low")) - (c("high") - c("close")), spread) * c("_vol")
    df = df.withColumns(
        {
            "gap_overnight": gap,
            "gap_fill_rate": F.when(F.abs(gap) >= 0.001, _ratio(c("close") - c("_pc"), c("open") - c("_pc"))),
            **{f"dist_sma_{n}_pct": 100 * _ratio(adj - c(f"_sma{n}"), c(f"_sma{n}")) for n in (20, 50, 200)},
            "pos_in_52w_range_pct": F.when(
                c("_hi252") != c("_lo252"), 100 * _ratio(adj - c("_lo252"), c("_hi252") - c("_lo252"))
            ),
            **{f"realized_vol_{n}d": full(F.stddev_samp, c("log_ret_1d"), n) * YEAR for n in (5, 10, 20, 60)},
            "parkinson_vol_20d": F.sqrt(full(F.avg, c("_hl2"), 20) / (4 * math.log(2))) * YEAR,
            "_gk20": full(F.avg, c("_gk"), 20),
            **_aroon(25),
            "trend_aligned_5_20_50": F.when((adj > c("_sma5")) & (adj > c("_sma20")) & (adj > c("_sma50")), 1)
            .when((adj < c("_sma5")) & (adj < c("_sma20")) & (adj < c("_sma50")), -1)
            .otherwise(0),
            "trend_persistence_60d": full(F.avg, (adj > c("_sma20")).cast("double"), 60),
            "pct_days_above_sma200_252d": full(F.avg, (adj > c("_sma200")).cast("double"), 252),
            "_up": _flag(c("ret_1d") > 0),
            "_above50": _flag(adj > c("_sma50")),
            "stoch_k_14": F.when(c("_hh14") != c("_ll14"), 100 * _ratio(c("close") - c("_ll14"), c("_hh14") - c("_ll14"))),
            "williams_r_14": F.when(c("_hh14") != c("_ll14"), -100 * _ratio(c("_hh14") - c("close"), c("_hh14") - c("_ll14"))),
            "vol_ratio_20d": _ratio(c("_vol"), full(F.avg, c("_vol"), 20)),
            "obv": F.sum(seeded(F.coalesce(F.signum(c("close") - c("_pc")), F.lit(0.0)) * c("_vol"), "obv")).over(so_far()),
            "accum_dist_line": F.sum(seeded(F.when(spread != 0, money).otherwise(0.0), "accum_dist_line")).over(so_far()),
            # with 20 rows the 1 % and 99 % quantiles nearest by index are the extremes, and clipping changes nothing
            "_vmean": full(F.avg, c("_vol"), 20),
            "_vstd": full(F.stddev_samp, c("_vol"), 20),
            "range_expansion_20d": _ratio(c("range_pct_close"), full(F.avg, c("range_pct_close"), 20)),
            "_ha_move": F.signum(c("_ha") - lag(c("_ha"))),
            "_pos20": full(F.sum, (c("ret_5d") > 0).cast("int"), 20),
            "_neg20": full(F.sum, (c("ret_5d") < 0).cast("int"), 20),
            **_volume_sides(),
        }
    )
    streak = {"_up_run": run_id(c("_up") == 0), "_above_run": run_id(c("_above50") == 0)}
    df = df.withColumns(
        {
            "gap_fill_rate_winsor": F.when(c("gap_fill_rate") < -2, -2.0).when(c("gap_fill_rate") > 2, 2.0).otherwise(c("gap_fill_rate")),
            "garman_klass_vol_20d": F.when(c("_gk20") > 0, F.sqrt("_gk20") * YEAR),
            "vol_of_vol_20d": full(F.stddev_samp, c("realized_vol_20d"), 20),
            "_vols": sorted_rows(c("realized_vol_20d"), 252),
            "stoch_d_3": full(F.avg, c("stoch_k_14"), 3),
            "unusual_vol_z_20d": F.when(c("_vstd") != 0, (c("_vol") - c("_vmean")) / c("_vstd")),
            "_ha_dir": F.coalesce(forward_fill(F.when(c("_ha_move") != 0, c("_ha_move"))), F.lit(0.0)),
            "roc_consistency_20d": F.when(c("ret_5d") > 0, c("_pos20") / 20.0).when(c("ret_5d") < 0, c("_neg20") / 20.0),
            "volume_trend_alignment": F.when((c("ret_5d") > 0) & (c("_vup") > c("_vdown")), 1)
            .when((c("ret_5d") < 0) & (c("_vdown") > c("_vup")), -1)
            .otherwise(0),
            **streak,
        }
    )
    low, high = (c("_vols")[nearest(252, q)] for q in (0.33, 0.67))
    regime = F.when(c("_vols").isNull(), None).when(c("realized_vol_20d") < low, 0).when(c("realized_vol_20d") < high, 1).otherwise(2)
    df = df.withColumn("vol_regime", regime).drop("_vols")  # at once: later windows are not to carry the arrays
    df = df.withColumns(
        {
            "up_streak_length": F.least(F.sum("_up").over(_in_run("_up_run")), F.lit(20)),
            "consecutive_days_above_sma50": F.sum(seeded(c("_above50"), "consecutive_days_above_sma50")).over(_in_run("_above_run")),
            "_ha_run": run_id(F.coalesce(c("_ha_dir") != lag(c("_ha_dir")), F.lit(True))),
        }
    )
    df = df.withColumn("_run_row", F.row_number().over(Window.partitionBy("ticker", "_ha_run").orderBy("date")))
    df = df.withColumn("trend_strength_smoothed", F.greatest(F.lit(-60), F.least(F.lit(60), (c("_run_row") * c("_ha_dir")).cast("int"))))
    made = {
        **{f"dist_ema_{n}_pct": 100 * _ratio(adj - c(f"ema_{n}"), c(f"ema_{n}")) for n in (20, 50, 200)},
        "macd_hist": c("macd") - c("macd_signal"),
        "_phi": full(F.max, adj, 20),
        "_plo": full(F.min, adj, 20),
        "_rhi": full(F.max, c("rsi_14"), 20),
        "_rlo": full(F.min, c("rsi_14"), 20),
        "_rsis": sorted_rows(c("rsi_14"), 252),
    }
    df = df.withColumns({name: x for name, x in made.items() if smoothed.issuperset(OF_SMOOTHED.get(name, ["rsi_14"]))})
    if "rsi_14" in smoothed:
        df = df.withColumn("regime_adjusted_rsi", c("rsi_14") - (c("_rsis")[125] + c("_rsis")[126]) / 2).drop("_rsis")
        df = df.withColumn(
            "momentum_div_flag",
            F.when((adj == c("_plo")) & (c("rsi_14") != c("_rlo")), 1)
            .when((adj == c("_phi")) & (c("rsi_14") != c("_rhi")), -1)
            .otherwise(0),
        )
    keep = [x for x in df.columns if not x.startswith("_")]
    if wanted is not None:
        keep = [x for x in keep if x in {"date", "ticker", *wanted}]
    return df.select(keep)


def _in_run(run: str):
    return Window.partitionBy("ticker", run).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def _aroon(n: int) -> dict[str, Column]:
    """Rows since the first highest high and the first lowest low of the last n rows, as a share of n."""
    w = last_rows(n)
    out = {}
    for name, x in (("up", F.max_by("_row", F.struct(c("high"), -c("_row")))), ("down", F.min_by("_row", F.struct(c("low"), c("_row"))))):
        since = c("_row") - x.over(w)
        out[f"aroon_{name}_{n}"] = F.when(F.count(F.lit(1)).over(w) == n, 100.0 * (n - since) / n)
    return out


def _volume_sides(n: int = 20) -> dict[str, Column]:
    """Mean volume of the up and of the down rows among the last n (fewer at the start); 0 without any."""
    w = last_rows(n)
    out = {}
    for name, side in (("_vup", c("ret_1d") > 0), ("_vdown", c("ret_1d") < 0)):
        out[name] = F.coalesce(F.avg(F.when(side, c("_vol"))).over(w), F.lit(0.0))
    return out
