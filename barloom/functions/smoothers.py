"""Recursive smoothers of price series: one grouped pass per ticker computes those that are asked for, and can go on from its state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, MutableMapping, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Series = Sequence[float | None]
#: What the recursions of a ticker have come to, by name: enough to go on with the next bars.
State = MutableMapping[str, float]
STATE = "map<string,double>"


def ewm(xs: Series, alpha: float, least: int, state: State | None = None, key: str = "") -> list[float | None]:
    """y0 = x0, y = alpha x + (1 - alpha) y; null until ``least`` non-null values; leading nulls are skipped."""
    y, n = (state.get(key), int(state.get(f"{key}.n", 0))) if state is not None else (None, 0)
    out = []
    for x in xs:
        if x is not None:
            y = x if y is None else alpha * x + (1.0 - alpha) * y
            n += 1
        out.append(y if n >= least and x is not None else None)
    if state is not None and y is not None:
        state[key], state[f"{key}.n"] = y, n
    return out


class Smoothers:
    """The recursive columns of one ticker's bars in order of date, each made once, after those that ``state`` has seen."""

    def __init__(self, open_: Series, high: Series, low: Series, close: Series, adj_close: Series, state: State | None = None):
        self.open, self.high, self.low, self.close, self.adj = (np.asarray(x, float) for x in (open_, high, low, close, adj_close))
        self.state: State = {} if state is None else state
        self.seen = dict(self.state)  # the bar before the first is in it

    def _before(self, x: np.ndarray, name: str) -> np.ndarray:
        """Each value's predecessor, NaN for the very first bar."""
        return np.concatenate([[self.seen.get(name, np.nan)], x[:-1]])

    def span(self, xs: Series, n: int, key: str) -> list[float | None]:
        return ewm(xs, 2.0 / (n + 1), n, self.state, key)

    def wilder(self, xs: Series, n: int, key: str) -> list[float | None]:
        return ewm(xs, 1.0 / n, n, self.state, key)

    @cached_property
    def true_range(self) -> list[float]:
        """The widest of today's range and the moves from yesterday's close; the first row has its range only."""
        before = self._before(self.close, "close")
        moves = np.fmax(np.abs(self.high - before), np.abs(self.low - before))
        return np.fmax(self.high - self.low, moves).tolist()

    @cached_property
    def macd(self) -> list[float | None]:
        adj = self.adj.tolist()
        fast, slow = self.span(adj, 12, "ema_12"), self.span(adj, 26, "ema_26")
        return [None if x is None or y is None else x - y for x, y in zip(fast, slow, strict=True)]

    @cached_property
    def atr(self) -> list[float | None]:
        return self.wilder(self.true_range, 14, "atr_14")

    @cached_property
    def directional(self) -> tuple[list, list]:
        """Average directional index, and the same signed by the leading side. Undefined strength counts as 0 throughout."""
        up, down = self.high - self._before(self.high, "high"), self._before(self.low, "low") - self.low
        plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        sides = []
        for tr, p, m in zip(self.atr, self.wilder(plus.tolist(), 14, "plus"), self.wilder(minus.tolist(), 14, "minus"), strict=True):
            sides.append((100.0 * p / tr, 100.0 * m / tr) if tr else (None, None))
        strength = [100.0 * abs(p - m) / (p + m) if p is not None and p + m > 0 else 0.0 for p, m in sides]
        adx = self.wilder(strength, 14, "adx")
        return adx, [None if a is None or p is None else a * ((p > m) - (p < m)) for a, (p, m) in zip(adx, sides, strict=True)]

    def rsi(self, n: int) -> list[float]:
        """Relative strength of smoothed gains; 50 while it is undefined."""
        moves = np.nan_to_num(self.adj - self._before(self.adj, "adj_close"))
        gain = self.wilder(np.maximum(moves, 0.0).tolist(), n, f"gain_{n}")
        loss = self.wilder(np.maximum(-moves, 0.0).tolist(), n, f"loss_{n}")
        return [100.0 * g / (g + l) if g is not None and g + l > 0 else 50.0 for g, l in zip(gain, loss, strict=True)]

    def supertrend(self, period: int = 10, width: float = 3.0) -> list[float | None]:
        """The trailing band a trend stands on: bands only tighten until the close before has crossed them.

        The range is seeded by the mean of its first ``period`` values; rows up to ``period`` are null.
        """
        s, out = self.state, []
        n, atr = int(s.get("bands.n", 0)), s.get("bands.range", 0.0)
        upper, lower, rising, before = s.get("bands.upper"), s.get("bands.lower"), bool(s.get("bands.rising", 0.0)), self.seen.get("close")
        for h, l, c, tr in zip(self.high.tolist(), self.low.tolist(), self.close.tolist(), self.true_range, strict=True):
            if n < period:
                atr += tr  # a sum, until it is a mean
                out.append(None)
            else:
                atr = atr / period if n == period else atr
                atr += (tr - atr) / period
                middle = (h + l) / 2.0
                top, bottom = middle + width * atr, middle - width * atr
                if upper is None:
                    upper, lower, rising = top, bottom, c > top
                else:
                    upper = top if before > upper else min(top, upper)
                    lower = bottom if before < lower else max(bottom, lower)
                    rising = c >= lower if rising else c > upper
                out.append(lower if rising else upper)
            n, before = n + 1, c
        s |= {"bands.n": n, "bands.range": atr}
        if upper is not None:
            s |= {"bands.upper": upper, "bands.lower": lower, "bands.rising": float(rising)}
        return out

    def end(self) -> State:
        """The state after these bars."""
        if len(self.close):
            self.state |= {n: float(x[-1]) for n, x in (("high", self.high), ("low", self.low), ("close", self.close), ("adj_close", self.adj))}
        return self.state


#: What makes each column from a ticker's bars.
MAKE: dict[str, Callable[[Smoothers], list[float | None]]] = {
    "ema_20": lambda s: s.span(s.adj.tolist(), 20, "ema_20"),
    "ema_50": lambda s: s.span(s.adj.tolist(), 50, "ema_50"),
    "ema_200": lambda s: s.span(s.adj.tolist(), 200, "ema_200"),
    "macd": lambda s: s.macd,
    "macd_signal": lambda s: s.span(s.macd, 9, "macd_signal"),
    "atr_14": lambda s: s.atr,
    "adx_14": lambda s: s.directional[0],
    "adx_directional_persistence": lambda s: s.directional[1],
    "heikin_ashi_close_smooth_5": lambda s: s.span(((s.open + s.high + s.low + s.close) / 4.0).tolist(), 5, "heikin_ashi"),
    "rsi_14": lambda s: s.rsi(14),
    "rsi_21": lambda s: s.rsi(21),
    "supertrend_10_3": lambda s: s.supertrend(),
}
COLUMNS = tuple(MAKE)
PRICES = ("open", "high", "low", "close", "adj_close")


def _smoothed(rows: pa.Table, names: Sequence[str], state: State) -> tuple[pa.Table, State]:
    rows = rows.sort_by("date")
    made = Smoothers(*(rows[n].to_numpy() for n in PRICES), state)
    for name in names:
        rows = rows.append_column(name, pa.array(MAKE[name](made), pa.float64()))
    return rows, made.end()


def _shape(bars: DataFrame, names: Sequence[str]) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields] + [f"{c} double" for c in names])


def with_smoothers(bars: DataFrame, columns: Iterable[str] = COLUMNS) -> DataFrame:
    """``bars`` with the recursive ``columns``: one shuffle on the ticker, whose history is one group.

    Bars hold no null prices (``normalise`` drops them); a ticker's history is bounded by the calendar.
    """
    names = [c for c in COLUMNS if c in set(columns)]
    return bars.groupBy("ticker").applyInArrow(lambda rows: _smoothed(rows, names, {})[0], _shape(bars, names))


def resumed(bars: DataFrame, states: DataFrame) -> DataFrame:
    """New ``bars`` with all recursive columns and, in each ticker's last row, ``state``: as if its bars before were there too.

    ``states`` is (ticker, state), one row for each ticker that has bars before; its recursions go on from it.
    """

    def each(rows: pa.Table, seen: pa.Table) -> pa.Table:
        state = dict(seen["state"][0].as_py()) if seen.num_rows else {}
        rows, state = _smoothed(rows, COLUMNS, state)
        last = [None] * (rows.num_rows - 1) + [list(state.items())] if rows.num_rows else []
        return rows.append_column("state", pa.array(last, pa.map_(pa.string(), pa.float64())))

    both = bars.groupBy("ticker").cogroup(states.select("ticker", "state").groupBy("ticker"))
    return both.applyInArrow(each, f"{_shape(bars, COLUMNS)}, state {STATE}")
