"""Interval joins against all pairs, on intervals of very unlike length, and their plans."""

import datetime as dt
import random

import pytest

import __spark_entry__  # noqa: F401
from barloom import plans
from barloom.operators.intervals import overlap_join, points_in

DAY = dt.date(2000, 1, 1)


def intervals(rng, n, key):
    rows = []
    for i in range(n):
        start = rng.randint(-4000, 4000)
        length = rng.choice([0, 0, 1, 2, 3, 7, 8, 30, 400, 9000, -3])
        rows.append((f"{key}{i}", rng.choice("xy"), DAY + dt.timedelta(start), DAY + dt.timedelta(start + length)))
    return [*rows, (f"{key}null", "x", None, DAY), (f"{key}open", "x", DAY, None)]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_overlaps_equal_all_pairs(spark, by):
    rng = random.Random(3)
    a, b = intervals(rng, 90, "a"), intervals(rng, 120, "b")
    left = spark.createDataFrame(a, "a string, g string, s date, e date")
    right = spark.createDataFrame(b, "b string, h string, t date, u date")
    right = right.withColumnRenamed("h", "g") if by else right
    found = overlap_join(left, right, ("s", "e"), ("t", "u"), by).select("a", "b").collect()
    sound = lambda rows: [r for r in rows if r[2] and r[3] and r[2] <= r[3]]
    plain = [(x[0], y[0]) for x in sound(a) for y in sound(b) if x[2] <= y[3] and y[2] <= x[3] and (not by or x[1] == y[1])]
    assert sorted(map(tuple, found)) == sorted(plain)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_points_equal_all_pairs(spark, by):
    rng = random.Random(5)
    b = intervals(rng, 120, "b")
    p = [(f"p{i}", rng.choice("xy"), DAY + dt.timedelta(rng.randint(-4100, 13000))) for i in range(300)] + [("null", "x", None)]
    right = spark.createDataFrame(b, "b string, h string, t date, u date")
    right = right.withColumnRenamed("h", "g") if by else right
    found = points_in(spark.createDataFrame(p, "p string, g string, d date"), right, "d", "t", "u", by).select("p", "b").collect()
    plain = [(x[0], y[0]) for x in p for y in b if x[2] and y[2] and y[3] and y[2] <= x[2] <= y[3] and (not by or x[1] == y[1])]
    assert sorted(map(tuple, found)) == sorted(plain)


def test_no_intervals(spark):
    none = spark.createDataFrame([], "b string, t date, u date")
    points = spark.createDataFrame([("p", DAY)], "p string, d date")
    assert points_in(points, none, "d", "t", "u").collect() == []
    assert overlap_join(none, none.toDF("c", "v", "w"), ("t", "u"), ("v", "w")).collect() == []


@pytest.mark.parametrize("name", ["q10_windows", "q18_overlap", "t05_folds", "t05_fold_rows", "b01_fold_routing", "b10_portfolio"])
def test_no_nested_loops(spark, sf_dir, name):
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
