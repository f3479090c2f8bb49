"""A query of each kind against its DuckDB SQL on the smallest tables."""

import datetime as dt
import math

import pytest

import __spark_entry__
from barloom import plans

SOME = [
    "f01_returns", "f14_vol_regime", "f18_adx", "f22_supertrend", "f43_trend_strength", "x04_return_score", "x08_beta", "r05_mean_correlation", "p01_feature_join",
    "l04_demeaned_return", "t05_folds", "m08_daily_rank_ic", "m12_bundle", "m23_univariate", "b05_top_picks", "b07_flat_brokerage", "q09_bundle", "q17_counterfactual",
    "o04_upsert", "v_all_rules", "c10_snap", "d07_regime_label", "d16_rank_movement", "streaming_append", "streaming_windows", "streaming_late_rows", "p05_metadata", "m19_significance",
    "m25_extremes", "b09_trade_legs", "b12_equal_weight", "b15_sensitivity", "q07_p_value", "q15_attribution", "r06_wide_returns", "v12_published", "v12_quarantined", "v12_report", "d01_replace_dates", "d02_ledger", "d03_replace_series",
    "d10_backfill", "d10_positions", "d10_runs", "b10_portfolio", "q10_windows", "q18_overlap",
]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)[:10]
    return f"{float(v) + 0.0:.5g}"


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = plans.QUERIES[name](spark, sf_dir)
    names = sorted(found.columns)
    mine = sorted(tuple(plain(r[n]) for n in names) for r in found.collect())
    cursor = con.execute(plans.ORACLE_SQL[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == names
    theirs = sorted(tuple(plain(row[order.index(n)]) for n in names) for row in cursor.fetchall())
    assert mine == theirs


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["p01_feature_join", "t01_training_table", "q15_attribution", "r05_mean_correlation", "b03_scores_as_of", "m23_univariate"])
def test_trades_are_not_scanned_again_and_nothing_is_multiplied(spark, sf_dir, name):
    """The panel of a query is written once, so its plan reads no trades, and no join is a product of two tables."""
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "CartesianProduct" not in plan


def test_models_of_all_folds(spark, sf_dir):
    found = plans.QUERIES["t09_importance"](spark, sf_dir).groupBy("fold_id").agg({"importance": "sum"}).collect()
    folds = plans.QUERIES["t05_folds"](spark, sf_dir).select("fold_id").collect()
    assert {r[0] for r in found} == {r[0] for r in folds} and all(abs(r[1] - 1) < 1e-6 for r in found)
    assert plans.data_queries.MODEL[:-1] == [name for name, *_ in plans.data_queries.METADATA]


def test_one_shuffle_of_the_panel_by_ticker(spark, sf_dir):
    """All windows of the per-ticker features share one partitioning: bars are shuffled once, by ticker."""
    from barloom.functions.features import per_ticker
    from barloom.sources.scratch import materialise

    panel = materialise(plans.feature_queries.bars(spark, sf_dir))
    plan = per_ticker(panel, ["ret_5d", "realized_vol_20d", "vol_of_vol_20d", "obv", "stoch_d_3"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_small_panel_is_not_cut_by_the_session(spark, sf_dir):
    """A session set up for large inputs has many shuffle partitions; the assembled table has as many as its panel is worth."""
    from barloom.operators.windows import parts_for
    from barloom.plans.market_queries import everything
    from barloom.plans.panel import bars_once

    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        panel = bars_once(spark, sf_dir)
        plan = everything(panel)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and ", 64), REPARTITION_BY_NUM" not in plan
        assert parts_for(panel) == -(-panel.count() // 1000) and parts_for(panel, 1) == 64 and parts_for(panel.where("ticker IS NULL")) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
