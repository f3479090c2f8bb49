"""Walk-forward folds: bounds on quarter ends snapped to trading days, and their range join to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import points_in
from .windows import as_of


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def add_quarters(d: Column, n: Column) -> Column:
    """The date n quarters on, its day at most 28."""
    first = F.add_months(F.trunc(d, "month"), n * 3)
    return F.date_add(first, F.least(F.dayofmonth(d), F.lit(28)) - 1)


def fold_bounds(
    days: DataFrame, train_start: str, initial_train_end: str, val_quarters: int = 2, test_quarters: int = 1, embargo: int = 5
) -> DataFrame:
    """fold_id, train_start, train_end, val_start, val_end, test_start, test_end, test_is_partial.

    Training grows by a quarter a fold; validation and test follow, each after an embargo of calendar days. Bounds
    snap to trading days of ``days`` (date), and a test may be cut short by the end of the data. Folds stop with
    the first that has no room; such as have no training days yet are passed over.
    """
    if val_quarters <= 0 or test_quarters <= 0 or embargo < 0:
        raise ValueError("quarters must be positive and the embargo not negative")
    spine = days.select("date").distinct()
    ends = spine.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    start = F.greatest(F.lit(train_start).cast("date"), F.col("first"))
    k = F.col("fold_id").cast("int")
    # a fold for each quarter from the first end of training to the last date: one row per fold
    ahead = F.greatest(F.lit(0), F.ceil(F.months_between("last", F.lit(initial_train_end).cast("date")) / 3).cast("long") + 2)
    f = ends.withColumn("fold_id", F.explode(F.sequence(F.lit(0).cast("long"), ahead)))
    f = f.withColumn("train_q", add_quarters(quarter_end(F.lit(initial_train_end).cast("date")), k))
    f = f.withColumn("val_t", F.date_add("train_q", 1 + embargo))
    f = f.withColumn("val_q", add_quarters(quarter_end(F.col("val_t")), F.lit(val_quarters - 1)))
    f = f.withColumn("test_t", F.date_add("val_q", 1 + embargo))
    f = f.withColumn("test_q", add_quarters(quarter_end(F.col("test_t")), F.lit(test_quarters - 1)))
    f = f.withColumn("train_start", start).where("train_q <= add_months(last, 3)")

    # each bound looks for the last trading day up to its target, or the first from it on
    bounds = (("train_end", "train_q", False), ("val_start", "val_t", True), ("val_end", "val_q", False), ("test_start", "test_t", True), ("test_end", "test_q", False))
    keys = ["fold_id", "train_start", "test_q"]
    sought = F.array(*[F.struct(F.lit(n).alias("name"), F.col(q).alias("target"), F.lit(up).alias("up")) for n, q, up in bounds])
    sought = f.select(*keys, F.explode(sought).alias("b")).select(*keys, "b.*")
    day = spine.select(F.col("date").alias("day"))
    found = as_of(sought.where("NOT up"), day, "target", "day").unionByName(as_of(sought.where("up"), day, "target", "day", forward=True))
    snapped = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("day"))).alias(n) for n, _, _ in bounds])
    skipped = F.col("train_end").isNull() | (F.col("train_end") < F.col("train_start"))
    room = (
        F.col("val_start").isNotNull() & F.col("test_start").isNotNull() & (F.col("val_end") >= F.col("val_start"))
        & (F.col("test_end") >= F.col("test_start"))
    )
    broke = F.max((~skipped & ~F.coalesce(room, F.lit(False))).cast("int")).over(
        Window.partitionBy(F.lit(1)).orderBy("fold_id").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        snapped.withColumns({"_skip": skipped, "_broke": broke})
        .where(~F.col("_skip") & (F.col("_broke") == 0))
        .select(
            "fold_id", "train_start", "train_end", "val_start", "val_end", "test_start", "test_end",
            (F.col("test_end") < F.col("test_q")).alias("test_is_partial"),
        )
    )


def fold_rows(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows of ``df`` by (fold_id, role): each row in every window that holds its date.

    The distinct dates meet the windows by bins of time, and rows find their windows by an equality join on the date.
    """
    roles = bounds.select(
        "fold_id",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(r).alias("role"), F.col(f"{r}_start").alias("lo"), F.col(f"{r}_end").alias("hi"))
                    for r in ("train", "val", "test")
                ]
            )
        ).alias("w"),
    ).select("fold_id", "w.*")
    dated = points_in(df.select("date").distinct(), roles, "date", "lo", "hi").drop("lo", "hi")
    return df.join(dated, "date").select(*df.columns, "fold_id", "role")


def route(dates: DataFrame, folds: DataFrame, embargo: int = 5) -> DataFrame:
    """date, fold_id, train_end: the latest fold whose training ended more than ``embargo`` days before, else null."""
    free = folds.groupBy("train_end").agg(F.max("fold_id").alias("fold_id")).withColumn("_free", F.date_add("train_end", embargo))
    found = as_of(dates.select("date").distinct(), free, "date", "_free", strict=True)
    return found.select("date", "fold_id", "train_end")


def frozen_route(dates: DataFrame, folds: DataFrame, fold_id: int, embargo: int = 5) -> DataFrame:
    """The same for one fixed fold: dates that its embargo does not cover have a null fold."""
    return route(dates, folds.where(F.col("fold_id") == fold_id), embargo)
