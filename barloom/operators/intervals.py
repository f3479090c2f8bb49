"""Joins of intervals and points of time by equality on dyadic bins, for intervals of very unlike length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _width() -> Column:
    """The days of a bin at a row's level."""
    return F.expr("shiftleft(1L, _level)")


def _level(start: Column, end: Column) -> Column:
    """The least k for which bins of 2 ** k days are at least as wide as the closed interval, which then meets two at most."""
    return F.ceil(F.log2((end - start + 1).cast("double"))).cast("int")


def _levels(df: DataFrame, start: Column, end: Column) -> list[int]:
    """The levels that intervals have: some 16 at most for dates, whatever the rows."""
    found = df.where(end >= start).select(_level(start, end).alias("level")).distinct().collect()
    return sorted(r["level"] for r in found)


def _dealt(df: DataFrame, start: Column, end: Column, levels: Sequence[int]) -> DataFrame:
    """A row for each bin that an interval meets at each of ``levels`` that is not finer than its own: two a level at most."""
    own = _level(start, end)
    df = df.where(end >= start).withColumns({"_s": start, "_e": end, "_own": own})
    coarser = F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k >= F.col("_own"))
    df = df.withColumn("_level", F.explode(coarser))
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / _width()), F.floor(F.col("_e") / _width()))))


def overlap_join(
    left: DataFrame, right: DataFrame, left_on: tuple[str, str], right_on: tuple[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Every pair of a left and a right row whose closed date intervals share a day (and whose ``by`` are equal).

    Intervals are dealt to bins of 2 ** k days. A pair meets at the coarser of both levels, k >= log2 of its length, where
    neither interval is in more than two bins, and is kept in its first common bin only. So the join is one of
    equality on level and bin, an interval of any length is dealt to two bins for each level that occurs, and nothing is
    compared but what lies as near as the longer of two intervals is long. Rows with a null or reversed interval join nothing.
    Columns of both sides must differ but for ``by``.
    """
    (ls, le), (rs, re) = ([F.unix_date(F.col(c)).cast("long") for c in pair] for pair in (left_on, right_on))
    levels = sorted({*_levels(left, ls, le), *_levels(right, rs, re)})
    if not levels:
        return left.limit(0).join(right.limit(0), list(by)) if by else left.limit(0).join(right.limit(0))
    a = _dealt(left, ls, le, levels)
    b = _dealt(right, rs, re, levels).withColumnsRenamed({"_s": "_rs", "_e": "_re", "_own": "_rown"})
    found = a.join(b, [*by, "_level", "_bin"])
    first = F.floor(F.greatest("_s", "_rs") / _width())
    met = (F.col("_level") == F.greatest("_own", "_rown")) & (F.col("_bin") == first) & (F.col("_s") <= F.col("_re")) & (F.col("_rs") <= F.col("_e"))
    return found.where(met).select(*left.columns, *[c for c in right.columns if c not in by])


def points_in(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    """Every pair of a point and a closed interval that holds it: a point is an interval of one day."""
    levels = _levels(intervals, *(F.unix_date(F.col(c)).cast("long") for c in (start, end)))
    if not levels:
        return points.limit(0).join(intervals.limit(0), list(by)) if by else points.limit(0).join(intervals.limit(0))
    s, e, p = (F.unix_date(F.col(c)).cast("long") for c in (start, end, at))
    own = _level(s, e)
    dealt = intervals.where(e >= s).withColumn("_level", own)
    dealt = dealt.withColumn("_bin", F.explode(F.sequence(F.floor(s / _width()), F.floor(e / _width()))))
    found = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]))).withColumn("_bin", F.floor(p / _width()))
    found = found.join(dealt, [*by, "_level", "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    return found.select(*points.columns, *[c for c in intervals.columns if c not in by])
