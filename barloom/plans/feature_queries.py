"""Queries of the per-ticker features, with the same formulas in DuckDB SQL."""

from __future__ import annotations

from ..functions.features import per_ticker
from .panel import bars, rounded, with_bars

#: Query name: feature columns.
FEATURES = {
    "f01_returns": ["ret_1d", "ret_5d", "ret_10d", "ret_20d", "ret_60d"],
    "f02_log_return": ["log_ret_1d"],
    "f03_gap_overnight": ["gap_overnight"],
    "f04_gap_fill_rate": ["gap_fill_rate"],
    "f05_gap_fill_rate_winsor": ["gap_fill_rate_winsor"],
    "f06_sma_distance": ["dist_sma_20_pct", "dist_sma_50_pct", "dist_sma_200_pct"],
    "f07_ema_distance": ["dist_ema_20_pct", "dist_ema_50_pct", "dist_ema_200_pct"],
    "f08_range_position_52w": ["pos_in_52w_range_pct"],
    "f09_realized_vol": ["realized_vol_5d", "realized_vol_10d", "realized_vol_20d", "realized_vol_60d"],
    "f10_parkinson_vol": ["parkinson_vol_20d"],
    "f11_garman_klass_vol": ["garman_klass_vol_20d"],
    "f12_atr": ["atr_14"],
    "f13_vol_of_vol": ["vol_of_vol_20d"],
    "f14_vol_regime": ["vol_regime"],
    "f15_macd": ["macd"],
    "f16_macd_signal": ["macd_signal"],
    "f17_macd_hist": ["macd_hist"],
    "f18_adx": ["adx_14"],
    "f19_adx_directional": ["adx_directional_persistence"],
    "f20_aroon": ["aroon_up_25", "aroon_down_25"],
    "f21_heikin_ashi": ["heikin_ashi_close_smooth_5"],
    "f22_supertrend": ["supertrend_10_3"],
    "f23_trend_aligned": ["trend_aligned_5_20_50"],
    "f24_trend_persistence": ["trend_persistence_60d"],
    "f25_days_above_sma200": ["pct_days_above_sma200_252d"],
    "f26_up_streak": ["up_streak_length"],
    "f27_days_above_sma50": ["consecutive_days_above_sma50"],
    "f28_rsi": ["rsi_14", "rsi_21"],
    "f29_stoch_k": ["stoch_k_14"],
    "f30_stoch_d": ["stoch_d_3"],
    "f31_williams_r": ["williams_r_14"],
    "f32_roc": ["roc_5d", "roc_10d", "roc_20d"],
    "f33_momentum_divergence": ["momentum_div_flag"],
    "f34_volume_ratio": ["vol_ratio_20d"],
    "f35_obv": ["obv"],
    "f36_typical_price": ["typical_price_dev_pct"],
    "f37_accumulation": ["accum_dist_line"],
    "f38_unusual_volume": ["unusual_vol_z_20d"],
    "f39_range_pct": ["range_pct_close"],
    "f40_range_expansion": ["range_expansion_20d"],
    "f41_close_position": ["close_pos_in_range"],
    "f42_body_to_range": ["body_to_range"],
    "f43_trend_strength": ["trend_strength_smoothed"],
    "f44_roc_consistency": ["roc_consistency_20d"],
    "f45_volume_trend": ["volume_trend_alignment"],
    "f46_regime_adjusted_rsi": ["regime_adjusted_rsi"],
}
WHOLE = {
    "vol_regime", "trend_aligned_5_20_50", "up_streak_length", "consecutive_days_above_sma50", "momentum_div_flag",
    "trend_strength_smoothed", "volume_trend_alignment",
}

ALL = "PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def w(n: int) -> str:
    return f"PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


def full(f: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER ({w(n)}) = {n} THEN {f}({x}) OVER ({w(n)}) END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY ticker ORDER BY date)"


def ewm(x: str, alpha: str, n: int) -> str:
    """Fold over the non-null values so far; null until there are n."""
    values = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER ({ALL})"
    return (
        f"CASE WHEN count({x}) OVER ({ALL}) >= {n} AND {x} IS NOT NULL THEN "
        f"list_reduce({values}, lambda y, z: {alpha} * z + (1.0 - {alpha}) * y) END"
    )


def span(x: str, n: int) -> str:
    return ewm(x, f"(2.0 / {n + 1})", n)


def wilder(x: str, n: int) -> str:
    return ewm(x, f"(1.0 / {n})", n)


PCT = ", ".join(f"adj_close / {lag('adj_close', n)} - 1 AS ret_{n}d" for n in (1, 5, 10, 20, 60))
S1 = f"""
s1 AS (
  SELECT *, {PCT}, ln(adj_close) - {lag('ln(adj_close)')} AS log_ret_1d, {lag('close')} AS pc,
    {lag('high')} AS ph, {lag('low')} AS pl, {", ".join(f"{full('avg', 'adj_close', n)} AS sma{n}" for n in (5, 20, 50, 200))},
    {full('max', 'adj_close', 252)} AS hi252, {full('min', 'adj_close', 252)} AS lo252,
    {full('max', 'high', 14)} AS hh14, {full('min', 'low', 14)} AS ll14,
    (high - low) / close * 100 AS range_pct_close,
    CASE WHEN high <> low THEN (close - low) / (high - low) END AS close_pos_in_range,
    CASE WHEN high <> low THEN abs(close - open) / (high - low) END AS body_to_range,
    (close - (high + low + close) / 3) / ((high + low + close) / 3) * 100 AS typical_price_dev_pct,
    (open + high + low + close) / 4 AS ha, CAST(volume AS DOUBLE) AS vol, close * volume AS turnover,
    row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn,
    adj_close - {lag('adj_close')} AS move
  FROM bars)"""
S2 = f"""
s2 AS (
  SELECT *, (open - pc) / pc AS gap_overnight,
    CASE WHEN abs((open - pc) / pc) >= 0.001 THEN (close - pc) / (open - pc) END AS gap_fill_rate,
    {", ".join(f"(adj_close - sma{n}) / sma{n} * 100 AS dist_sma_{n}_pct" for n in (20, 50, 200))},
    CASE WHEN hi252 <> lo252 THEN (adj_close - lo252) / (hi252 - lo252) * 100 END AS pos_in_52w_range_pct,
    {", ".join(f"{full('stddev_samp', 'log_ret_1d', n)} * sqrt(252) AS realized_vol_{n}d" for n in (5, 10, 20, 60))},
    sqrt({full('avg', 'pow(ln(high / low), 2)', 20)} / (4 * ln(2))) * sqrt(252) AS parkinson_vol_20d,
    {full('avg', '(0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2))', 20)} AS gk20,
    CASE WHEN count(*) OVER ({w(25)}) = 25 THEN 100.0 * (25 - (rn - arg_max(rn, row(high, -rn)) OVER ({w(25)}))) / 25 END AS aroon_up_25,
    CASE WHEN count(*) OVER ({w(25)}) = 25 THEN 100.0 * (25 - (rn - arg_min(rn, row(low, rn)) OVER ({w(25)}))) / 25 END AS aroon_down_25,
    CASE WHEN adj_close > sma5 AND adj_close > sma20 AND adj_close > sma50 THEN 1
      WHEN adj_close < sma5 AND adj_close < sma20 AND adj_close < sma50 THEN -1 ELSE 0 END AS trend_aligned_5_20_50,
    {full('avg', 'CAST(adj_close > sma20 AS INT)', 60)} AS trend_persistence_60d,
    {full('avg', 'CAST(adj_close > sma200 AS INT)', 252)} AS pct_days_above_sma200_252d,
    CASE WHEN ret_1d > 0 THEN 1 ELSE 0 END AS up, CASE WHEN adj_close > sma50 THEN 1 ELSE 0 END AS above50,
    CASE WHEN hh14 <> ll14 THEN (close - ll14) / (hh14 - ll14) * 100 END AS stoch_k_14,
    CASE WHEN hh14 <> ll14 THEN (hh14 - close) / (hh14 - ll14) * -100 END AS williams_r_14,
    ret_5d * 100 AS roc_5d, ret_10d * 100 AS roc_10d, ret_20d * 100 AS roc_20d,
    vol / {full('avg', 'vol', 20)} AS vol_ratio_20d,
    sum(coalesce(sign(close - pc), 0) * vol) OVER ({ALL}) AS obv,
    sum(CASE WHEN high <> low THEN ((close - low) - (high - close)) / (high - low) * vol ELSE 0 END) OVER ({ALL}) AS accum_dist_line,
    {full('avg', 'vol', 20)} AS vmean, {full('stddev_samp', 'vol', 20)} AS vstd,
    range_pct_close / {full('avg', 'range_pct_close', 20)} AS range_expansion_20d,
    sign(ha - {lag('ha')}) AS ha_move,
    {full('sum', 'CAST(ret_5d > 0 AS INT)', 20)} AS pos20, {full('sum', 'CAST(ret_5d < 0 AS INT)', 20)} AS neg20,
    coalesce(avg(CASE WHEN ret_1d > 0 THEN vol END) OVER ({w(20)}), 0) AS vup,
    coalesce(avg(CASE WHEN ret_1d < 0 THEN vol END) OVER ({w(20)}), 0) AS vdown,
    {", ".join(f"{span('adj_close', n)} AS ema{n}" for n in (12, 20, 26, 50, 200))},
    {span('ha', 5)} AS heikin_ashi_close_smooth_5,
    greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
    CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS pdm,
    CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS mdm,
    greatest(coalesce(move, 0.0), 0.0) AS gain, greatest(-coalesce(move, 0.0), 0.0) AS loss
  FROM s1)"""
S3 = f"""
s3 AS (
  SELECT *, CASE WHEN gap_fill_rate < -2 THEN -2.0 WHEN gap_fill_rate > 2 THEN 2.0 ELSE gap_fill_rate END AS gap_fill_rate_winsor,
    {", ".join(f"(adj_close - ema{n}) / ema{n} * 100 AS dist_ema_{n}_pct" for n in (20, 50, 200))},
    CASE WHEN gk20 > 0 THEN sqrt(gk20) * sqrt(252) END AS garman_klass_vol_20d,
    {full('stddev_samp', 'realized_vol_20d', 20)} AS vol_of_vol_20d,
    CASE WHEN count(realized_vol_20d) OVER ({w(252)}) = 252 THEN list_sort(list(realized_vol_20d) OVER ({w(252)})) END AS vols,
    {full('avg', 'stoch_k_14', 3)} AS stoch_d_3,
    CASE WHEN vstd <> 0 THEN (vol - vmean) / vstd END AS unusual_vol_z_20d,
    coalesce(last_value(nullif(ha_move, 0) IGNORE NULLS) OVER ({ALL}), 0) AS ha_dir,
    CASE WHEN ret_5d > 0 THEN pos20 / 20.0 WHEN ret_5d < 0 THEN neg20 / 20.0 END AS roc_consistency_20d,
    CASE WHEN ret_5d > 0 AND vup > vdown THEN 1 WHEN ret_5d < 0 AND vdown > vup THEN -1 ELSE 0 END AS volume_trend_alignment,
    sum(1 - up) OVER ({ALL}) AS up_run, sum(1 - above50) OVER ({ALL}) AS above_run,
    ema12 - ema26 AS macd, {wilder('tr', 14)} AS atr_14,
    100 * {wilder('pdm', 14)} / {wilder('tr', 14)} AS pdi, 100 * {wilder('mdm', 14)} / {wilder('tr', 14)} AS mdi,
    {", ".join(f"CASE WHEN coalesce({wilder('gain', n)} + {wilder('loss', n)}, 0) > 0 THEN 100 * {wilder('gain', n)} / ({wilder('gain', n)} + {wilder('loss', n)}) ELSE 50.0 END AS rsi_{n}" for n in (14, 21))}
  FROM s2)"""
S4 = f"""
s4 AS (
  SELECT *, CASE WHEN vols IS NULL THEN NULL WHEN realized_vol_20d < vols[84] THEN 0 WHEN realized_vol_20d < vols[169] THEN 1 ELSE 2 END AS vol_regime,
    least(sum(up) OVER (PARTITION BY ticker, up_run ORDER BY date ROWS UNBOUNDED PRECEDING), 20) AS up_streak_length,
    sum(above50) OVER (PARTITION BY ticker, above_run ORDER BY date ROWS UNBOUNDED PRECEDING) AS consecutive_days_above_sma50,
    CASE WHEN coalesce(ha_dir <> {lag('ha_dir')}, TRUE) THEN 1 ELSE 0 END AS turned,
    {span('macd', 9)} AS macd_signal,
    CASE WHEN coalesce(pdi + mdi, 0) > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) ELSE 0.0 END AS dx,
    {full('max', 'adj_close', 20)} AS phi, {full('min', 'adj_close', 20)} AS plo,
    {full('max', 'rsi_14', 20)} AS rhi, {full('min', 'rsi_14', 20)} AS rlo,
    rsi_14 - {full('median', 'rsi_14', 252)} AS regime_adjusted_rsi
  FROM s3)"""
S5 = f"""
s5 AS (
  SELECT *, macd - macd_signal AS macd_hist, {wilder('dx', 14)} AS adx_14, sum(turned) OVER ({ALL}) AS ha_run,
    CASE WHEN adj_close = plo AND rsi_14 <> rlo THEN 1 WHEN adj_close = phi AND rsi_14 <> rhi THEN -1 ELSE 0 END AS momentum_div_flag
  FROM s4)"""
S6 = """
feats AS (
  SELECT *, adx_14 * sign(pdi - mdi) AS adx_directional_persistence,
    greatest(-60, least(60, CAST(row_number() OVER (PARTITION BY ticker, ha_run ORDER BY date) * ha_dir AS INT))) AS trend_strength_smoothed
  FROM s5)"""
#: The trailing band as a fold over the bars so far: its state is (upper, lower, rising, close before).
SUPERTREND = f"""
t1 AS (
  SELECT date, ticker, high, low, close, rn, {lag('close')} AS pc, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM s1),
t2 AS (
  SELECT *, CASE WHEN rn >= 10 THEN list_reduce(
      list_prepend(list_avg((list(tr) OVER ({ALL}))[1:10]), (list(tr) OVER ({ALL}))[11:]), lambda a, x: (a * 9 + x) / 10) END AS atr
  FROM t1),
t3 AS (
  SELECT *, list(struct_pack(u := (high + low) / 2 + 3 * atr, l := (high + low) / 2 - 3 * atr, r := FALSE, c := close))
    FILTER (WHERE rn > 10) OVER ({ALL}) AS steps FROM t2),
t4 AS (
  SELECT date, ticker, CASE WHEN rn > 10 THEN list_reduce(
    list_prepend(struct_pack(u := steps[1].u, l := steps[1].l, r := steps[1].c > steps[1].u, c := steps[1].c), steps[2:]),
    lambda a, x: struct_pack(
      u := CASE WHEN x.u < a.u OR a.c > a.u THEN x.u ELSE a.u END,
      l := CASE WHEN x.l > a.l OR a.c < a.l THEN x.l ELSE a.l END,
      r := CASE WHEN a.r THEN x.c >= (CASE WHEN x.l > a.l OR a.c < a.l THEN x.l ELSE a.l END)
                ELSE x.c > (CASE WHEN x.u < a.u OR a.c > a.u THEN x.u ELSE a.u END) END,
      c := x.c)) END AS band
  FROM t3)"""


def _query(columns: list[str]):
    def run(spark, sf_dir):
        return rounded(per_ticker(bars(spark, sf_dir), columns).select("date", "ticker", *columns))

    return run


def _oracle(columns: list[str]) -> str:
    if columns == ["supertrend_10_3"]:
        out = "round(CASE WHEN band.r THEN band.l ELSE band.u END, 6) + 0.0 AS supertrend_10_3"
        return with_bars(S1, SUPERTREND, select=f"SELECT date, ticker, {out} FROM t4")
    out = ", ".join(f"CAST({c} AS INT) AS {c}" if c in WHOLE else f"round({c}, 6) + 0.0 AS {c}" for c in columns)
    return with_bars(S1, S2, S3, S4, S5, S6, select=f"SELECT date, ticker, {out} FROM feats")


QUERIES = {name: _query(columns) for name, columns in FEATURES.items()}
ORACLE_SQL = {name: _oracle(columns) for name, columns in FEATURES.items()}
