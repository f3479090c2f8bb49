"""The feature table after appends equals a recomputation of everything, for every feature, from the rows looked back on alone."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barloom.operators import incremental as U
from barloom.operators import pipeline as P
from barloom.plans.panel import fear_index, market_index
from barloom.sources.runs import RunTables
from barloom.sources.scratch import materialise, new_folder

from .test_operators import DAY, panel

DAYS = 530


@pytest.fixture(scope="module")
def bars(spark):
    # one ticker rests now and then, so its rows reach further back in days
    rests = (F.col("ticker") == "T2") & (F.dayofmonth("date") % 5 == 0)
    p = panel(spark, DAYS, 3).where(~rests).withColumn("sector", F.when(F.col("ticker") == "T0", "a").otherwise("b"))
    return materialise(p.withColumn("close", F.col("adj_close")))


def test_closure():
    assert P.closure("vol_regime") == 272 and P.closure("pct_days_above_sma200_252d") >= 451 and P.closure("ret_1d") == 2
    assert U.LOOK_BACK == max(P.closure(n) for n, *_ in P.METADATA)
    assert set(P.WINDOWS_OF) <= {n for n, *_ in P.METADATA} and all(of in {n for n, *_ in P.METADATA} for _, of in P.WINDOWS_OF.values())


def test_two_appends_equal_a_full_recompute(spark, bars):
    special = bars.where("month(date) = 1 AND day(date) < 8").select("date").distinct()
    whole = {(r.date, r.ticker): r for r in P.all_features(bars, market_index(bars), fear_index(bars), special).collect()}
    store = RunTables(spark, new_folder(spark))
    cuts = [DAY + dt.timedelta(n) for n in (DAYS - 31, DAYS - 11, DAYS - 1)]
    assert U.update(bars.where(F.col("date") <= cuts[0]), special, store, "a") == DAYS - 30
    back = store.read("ends", U.ENDS).groupBy("ticker").agg(F.max("back_to")).collect()
    assert all(b > DAY for _, b in back if _ != "T2")
    # what lies behind the look-back is not needed: it may as well be wrong
    begin = min(b for _, b in back)
    spoilt = bars.withColumn("close", F.when(F.col("date") < F.lit(begin), 1e9).otherwise(F.col("close")))
    assert U.update(spoilt.where(F.col("date") <= cuts[1]), special, store, "b") == 20
    assert U.update(spoilt.where(F.col("date") <= cuts[1]), special, store, "c") == 0
    store.stage("broken", {"features": store.read("features", U.FEATURES).where(F.col("date") > F.lit(cuts[0]))})  # a run that got no further
    assert U.update(spoilt, special, store, "d") == 10
    found = {(r.date, r.ticker): r for r in store.read("features", U.FEATURES).collect()}
    assert found.keys() == whole.keys()
    known = dict.fromkeys((n for n, *_ in P.METADATA), 0)
    for key, r in whole.items():
        for name in known:
            a, b = r[name], found[key][name]
            known[name] += a is not None and key[0] > cuts[0]
            assert (a is None and b is None) or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), (key, name, a, b)
    assert {n for n, k in known.items() if not k} <= {"gap_fill_rate", "gap_fill_rate_winsor"}, [n for n, k in known.items() if not k]
