"""Jobs that write tables: what a failure leaves, what a rerun changes, and that loads are read once."""

import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from barloom.operators import backfill as K
from barloom.sources import validated as V
from barloom.sources.runs import RunTables
from barloom.sources.scratch import exists, new_folder, shared_folder, subfolders

from .test_operators import BARS, DAY, panel


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(spark):
    return set(subfolders(spark, shared_folder(spark)))


@pytest.fixture
def places(spark):
    folder = new_folder(spark)
    return f"{folder}/bars", f"{folder}/quarantine"


def test_sound_load_is_published_and_broken_ticker_kept_out(spark, places):
    table, quarantine = places
    bars = panel(spark, 30, 3)
    assert V.save_bars(bars, "a", table, quarantine, "2030-01-01").errors == []
    bad = bars.where("ticker = 'T1' OR date > '2020-01-20'").withColumn("high", F.when((F.col("ticker") == "T1") & (F.dayofmonth("date") == 5), 0.0).otherwise(F.col("high") + 1))
    found = V.save_bars(bad, "b", table, quarantine, "2030-01-01")
    assert {r for r, *_ in found.errors} == {"price.non_positive", "ohlc.high_lt_low", "ohlc.high_lt_open_or_close"}
    assert (found.published, found.quarantined) == (20, 30)
    stored = V.read_bars(spark, table)
    assert rows(stored.where("ticker = 'T1'").select(bars.columns)) == rows(bars.where("ticker = 'T1'"))
    assert rows(stored.where("ticker <> 'T1'").select(bars.columns)) == rows(bars.where("ticker <> 'T1' AND date <= '2020-01-20'").unionByName(bad.where("ticker <> 'T1'")))
    kept_out = V.read_quarantine(spark, quarantine)
    assert kept_out.where("size(broken) > 0").count() == 1 and kept_out.count() == 30
    before = rows(stored), rows(kept_out)
    V.save_bars(bad, "b", table, quarantine, "2030-01-01")
    assert before == (rows(V.read_bars(spark, table)), rows(V.read_quarantine(spark, quarantine)))
    assert V.save_bars(bars, "b", table, quarantine, "2030-01-01").errors == [] and V.read_quarantine(spark, quarantine).count() == 0


def test_duplicates_future_and_warnings(spark, places):
    bars = panel(spark, 10, 2)
    twice = bars.unionByName(bars.where("ticker = 'T0' AND date < '2020-01-03'")).withColumn("volume", F.lit(0).cast("long"))
    found = V.save_bars(twice, "a", *places, "2020-01-09")
    assert dict((r, n) for r, _, n in found.issues) == {V.DUPLICATES: 2, "date.future": 2, "volume.zero": 22}
    assert (found.published, found.quarantined) == (0, 22) and not V.read_bars(spark, places[0]).count()


def test_missing_columns_empty_loads_and_nulls(spark, places):
    bars = panel(spark, 5, 1)
    assert V.save_bars(bars.drop("volume", "open"), "a", *places, "2030-01-01").issues == [("schema.missing_columns", "error", 2)]
    assert not exists(spark, places[0])
    assert V.save_bars(bars.limit(0), "a", *places, "2030-01-01") == V.Report([], 0, 0)
    nulls = spark.createDataFrame([(DAY, "X", None, None, None, None, None, None), (None, None, 1.0, 1.0, 1.0, 1.0, 1, 1.0)], BARS).withColumn("extra", F.lit(1))
    assert V.save_bars(nulls, "b", *places, "2030-01-01").errors == []


def test_a_load_is_read_once_and_staging_goes(spark, places):
    source = new_folder(spark)
    panel(spark, 10, 2).write.parquet(source)
    load = spark.read.parquet(source)
    plan = V.staged(load, "a", "2030-01-01", 0.5, Observation())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
    before = files(spark)
    V.save_bars(load.withColumn("high", F.lit(0.0)), "a", *places, "2030-01-01")
    assert files(spark) - before <= {places[0].split("/")[-2]}


CLOSES = "date date, ticker string, close double"


def test_failure_between_tables_leaves_no_trace(spark):
    bars = panel(spark, 6, 2)
    store = RunTables(spark, new_folder(spark))
    closes, opens = bars.select("date", "ticker", "close"), bars.select("date", "ticker", F.col("open").alias("close"))
    done = bars.select("date").distinct().withColumn("status", F.lit("SUCCESS"))
    store.replace("first", {"a": closes, "b": opens}, done)
    before = rows(store.read("a", CLOSES)), rows(store.read("b", CLOSES))
    late = F.col("date") > F.lit("2020-01-03")
    store.stage("broken", {"a": closes.where(late).withColumn("close", F.lit(-1.0))})  # and nothing further
    assert (rows(store.read("a", CLOSES)), rows(store.read("b", CLOSES))) == before
    assert store.pending(done.select("date")).isEmpty()
    new = {"a": opens.where(late & (F.col("ticker") == "T0")), "b": closes.where(late)}
    for _ in range(2):  # a run that is repeated changes nothing
        store.replace("second", new, done.where(late))
        assert rows(store.read("a", CLOSES)) == rows(closes.where(~late).unionByName(new["a"]))
        assert rows(store.read("b", CLOSES)) == rows(opens.where(~late).unionByName(new["b"]))
    assert store.vacuum(["a", "b"]) == 9  # three days of the broken run, and of the first in both tables
    assert rows(store.read("b", CLOSES)) == rows(opens.where(~late).unionByName(new["b"])) and store.vacuum(["a", "b"]) == 0


def test_ledger(spark):
    store = RunTables(spark, new_folder(spark))
    days = spark.createDataFrame([(DAY + dt.timedelta(i),) for i in range(3)], "date date")
    assert store.pending(days).count() == 3 and store.ledger().isEmpty() and store.read("a", CLOSES).isEmpty()
    store.commit("x", days.withColumn("status", F.when(F.dayofmonth("date") == 1, "FAILED").otherwise("SUCCESS")))
    assert [r[0] for r in store.pending(days).collect()] == [DAY] and store.unrun(days).isEmpty()
    store.commit("y", days.limit(1).withColumns({"status": F.lit("SUCCESS"), "note": F.lit("again")}))
    assert store.pending(days).isEmpty() and {(r.run, r.note) for r in store.ledger().collect()} == {("x", None), ("y", "again")}
    with pytest.raises(ValueError):
        store.stage("z", {"a": days.withColumn("run", F.lit(1))})


def test_backfill_in_parts_equals_one_and_ends(spark):
    bars = panel(spark, 40, 4)
    scores = bars.select("date", "ticker", (F.crc32(F.concat_ws("", "date", "ticker").cast("binary")) % 100).cast("double").alias("score"))
    inputs = bars.select("date", F.lit(1).alias("vol_regime"), F.lit(1).alias("above"), F.lit(0.1).alias("ret60")).distinct()
    stores = []
    for ends in (["2020-02-09"], ["2020-01-20", "2020-02-09"]):
        store = RunTables(spark, new_folder(spark))
        written = [K.backfill(bars, scores, inputs, store, f"r{i}", "2020-01-03", end, 5, 2) for i, end in enumerate([*ends, ends[-1]])]
        assert sum(written) == 38 and written[-1] == 0
        stores.append(store)
    for name, schema in K.SCHEMAS.items():
        a, b = (rows(s.read(name, schema)) for s in stores)
        assert a == b and a, name
    positions = stores[0].read("positions", K.POSITIONS)
    assert positions.where("entry_date > date OR abs(mtm_value - qty * current_mark) > 1e-6").isEmpty()
    state = {r.date: r for r in stores[0].read("state", K.STATE).collect()}
    assert state[dt.date(2020, 1, 2)].cash == 1_000_000.0 and len(state) == 39
    marked = {r[0]: r[1] for r in positions.groupBy("date").agg(F.sum("mtm_value")).collect()}
    assert all(abs(r.cash + marked.get(d, 0.0) - r.total_value) < 1e-6 for d, r in state.items())
