"""Window idioms of dated panels: warm-up rules, ranks, nearest quantiles, runs, smoothers and as-of joins."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = "ticker"


def over(key: str | Sequence[str] = KEY, order: str = "date") -> WindowSpec:
    """A key's rows in order of date."""
    return Window.partitionBy(key).orderBy(order)


def dealt(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` over ``parts``, or all shuffle partitions, which the windows and groups of these keys then share.

    Adaptive execution puts small partitions together by their bytes; rows that much work is done on are not to be.
    """
    return df.repartition(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def parts_for(written: DataFrame, least: int = 1_000) -> int:
    """The shuffle partitions, but no more than hold ``least`` rows each of a written table, whose footers tell its rows.

    A task that starts a long chain of windows costs far more than its rows do while they are few: a session set up for large
    inputs is not to cut a small panel into hundreds of them.
    """
    return max(1, min(int(written.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-written.count() // least)))


def last_rows(n: int, key: str | Sequence[str] = KEY, order: str = "date") -> WindowSpec:
    """The current row and the n - 1 before it."""
    return over(key, order).rowsBetween(-(n - 1), 0)


def so_far(key: str | Sequence[str] = KEY, order: str = "date") -> WindowSpec:
    """All rows of the key up to the current one."""
    return over(key, order).rowsBetween(Window.unboundedPreceding, 0)


def full(function: Callable[[Column], Column], x: Column, n: int) -> Column:
    """An aggregate of the last n rows; null until all n values are there."""
    w = last_rows(n)
    return F.when(F.count(x).over(w) == n, function(x).over(w))


def lag(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(over())


def change(x: Column, n: int) -> Column:
    """x / x n rows ago - 1; null where that is missing or zero."""
    return F.try_divide(x, lag(x, n)) - 1


def sorted_rows(x: Column, n: int) -> Column:
    """The values of the last n rows in order; null until all n are there. Make it a column of its own: each use would sort again."""
    values = F.collect_list(x).over(last_rows(n))
    return F.when(F.size(values) == n, F.sort_array(values))


def nearest(n: int, q: float) -> int:
    """The index of the nearest of n sorted values to a quantile: half of the way counts up."""
    return math.floor((n - 1) * q + 0.5)


def average_rank(x: Column, by: Sequence[str]) -> Column:
    """Rank with ties at their mean; null for null."""
    ordered = Window.partitionBy(*by, x.isNull()).orderBy(x)
    ties = Window.partitionBy(*by, x)
    return F.when(x.isNotNull(), F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def forward_fill(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(so_far())


def run_id(changed: Column) -> Column:
    """Numbers runs: how many rows so far are true in ``changed``."""
    return F.sum(F.when(changed, 1).otherwise(0)).over(so_far())


def as_of(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str] = (), strict: bool = False, forward: bool = False
) -> DataFrame:
    """Each row of ``left`` with the nearest earlier (or later) row of ``right`` of the same ``by``, left outer.

    Both sides are united and sorted once per key, and the last seen right row is carried along: one shuffle on the
    key, no join that multiplies rows. At equal times a right row counts unless ``strict``. Without ``by`` the right
    side must be a small dimension: the distinct times of the left are united with it, and found rows come back by an
    equality join. Right columns must not clash with left ones but for ``by``.
    """
    carried = [c for c in right.columns if c not in by]
    if not by:
        times = left.select(F.col(left_on).alias("_time"), F.lit(0).alias("_all")).distinct()  # one row per date
        found = as_of(times, right.withColumn("_all", F.lit(0)), "_time", right_on, ["_all"], strict, forward)
        found = found.where(F.col("_time").isNotNull()).drop("_all")
        return left.join(found, F.col(left_on) == F.col("_time"), "left").select(*left.columns, *carried)
    right_first = not strict
    l = left.withColumns({"_t": F.col(left_on), "_r": F.lit(None).cast(right.select(F.struct(*carried).alias("s")).schema["s"].dataType)})  # noqa: E741
    l = l.withColumn("_side", F.lit(1))  # noqa: E741
    r = right.select(*by, F.col(right_on).alias("_t"), F.struct(*carried).alias("_r"), F.lit(0 if right_first else 2).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    time = F.col("_t").desc() if forward else F.col("_t")
    w = Window.partitionBy(*by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*left.columns, "_r.*")
