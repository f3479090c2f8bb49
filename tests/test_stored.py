"""Stored panels: what scans prune, and joins without a shuffle."""

from pyspark.sql import functions as F

from barloom.sources.stored import colocated, joined, scan_panel, store_panel

from .test_operators import panel


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_scans_prune_and_joins_do_not_shuffle(spark):
    bars = panel(spark, 500, 5)
    name, other = store_panel(bars, buckets=4), store_panel(bars.select("date", "ticker", (F.col("close") * 2).alias("twice")), buckets=4)
    one = scan_panel(spark, name, "T3", "2020-03-01", "2020-12-31")
    text = plan(one)
    assert "PartitionFilters: [isnotnull(year" in text and "EqualTo(ticker,T3)" in text
    assert sorted(map(tuple, one.select(bars.columns).collect())) == sorted(map(tuple, bars.where("ticker = 'T3' AND date BETWEEN '2020-03-01' AND '2020-12-31'").collect()))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with colocated(spark):
            text = plan(spark.table(name).join(spark.table(other), ["ticker", "date"]))
        assert "SortMergeJoin" in text and "Exchange" not in text
        both = joined(spark, name, other)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert both.count() == bars.count() and both.where("abs(twice - 2 * close) > 1e-9").isEmpty() and "year" not in both.columns
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_panels_without_tickers(spark):
    name = store_panel(panel(spark, 400, 1).drop("ticker"))
    text = plan(scan_panel(spark, name, None, "2021-01-01", None))
    assert "PartitionFilters: [isnotnull(year" in text and scan_panel(spark, name, None, "2021-01-01").count() == 34
