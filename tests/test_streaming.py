"""Windows that finish: late rows and copies are left out, state goes with the watermark, runs go on where the last one ended."""

import datetime as dt
import random

from barloom.sources.scratch import new_folder
from barloom.streaming.append import finish_windows

SCHEMA = "event_id long, ts timestamp, event_type string, value double"
START = dt.datetime(2024, 1, 1)


def plain(loads):
    """Counts by window and type, and late rows of each load, by the rule of the watermark."""
    mark, seen, counts, late = None, set(), {}, []
    for load in loads:
        late.append(sum(mark is not None and ts <= mark for _, ts, *_ in load))
        for i, ts, kind, value in load:
            if (mark is None or ts > mark) and i not in seen:
                seen.add(i)
                key = ts.replace(minute=0, second=0), kind
                n, total = counts.get(key, (0, 0.0))
                counts[key] = n + 1, total + value
        mark = max([ts for load_ in [load] for _, ts, *_ in load_] + ([mark + dt.timedelta(minutes=10)] if mark else [])) - dt.timedelta(minutes=10)
    return {k: v for k, v in counts.items() if k[0] + dt.timedelta(hours=1) <= mark}, late


def test_windows_equal_plain_and_state_is_bounded(spark):
    rng = random.Random(4)
    events = [(i, START + dt.timedelta(seconds=97 * i), rng.choice("ab"), float(i % 13)) for i in range(1500)]
    loads = [[] for _ in range(6)]
    for e in events:
        k = e[0] // 300
        loads[min(5, k + (e[0] % 40 == 0))].append(e)
        if e[0] % 9 == 0:
            loads[k].append(e)  # sent twice
    folder, taken = new_folder(spark), []
    for k, load in enumerate(loads):
        spark.createDataFrame(load, SCHEMA).write.parquet(f"{folder}/in/{k}")
        taken.append(finish_windows(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in/*"), f"{folder}/out", f"{folder}/log"))
    counts, late = plain(loads)
    found = spark.read.parquet(f"{folder}/out").collect()
    assert {(r.start, r.event_type): (r.n, r.total) for r in found} == counts and len(found) == len(counts)
    assert [t.late for t in taken] == late and sum(late) > 10 and [t.rows for t in taken] == [len(x) for x in loads]
    # at the end of each run: the open hour's windows and the ids of the last minutes, however much went through
    assert max(t.state for t in taken) < 40
    again = finish_windows(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in/*"), f"{folder}/out", f"{folder}/log")
    assert (again.rows, again.late) == (0, 0)
    assert spark.read.parquet(f"{folder}/out").count() == len(found)
