"""The load of the last minute at each request, as a stream over several micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from passagework.operators import telemetry
from passagework.streaming import live, load

SCHEMA = "request_id long, key string, ts timestamp, tokens long"


def requests(n=400, seed=1):
    rng = random.Random(seed)
    start = 1_700_000_000 + 82_000  # the day ends within
    return sorted((start + rng.randrange(6000), i, rng.choice("abc"), rng.randrange(100)) for i in range(n))


def feed(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(r, k, float(at), t) for at, r, k, t in rows], "request_id long, key string, at double, tokens long").select("request_id", "key", F.timestamp_seconds("at").alias("ts"), "tokens").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        out = live.run_available(load.request_load(stream), str(folder), settings=load.ROCKSDB)
    return {r["request_id"]: (r["recent_requests"], r["recent_tokens"], r["day_requests"]) for r in out.collect()}


def batch_load(spark, rows):
    frame = spark.createDataFrame([(r, k, at, t) for at, r, k, t in rows], "request_id long, key string, timestamp long, tokens long")
    return {r["request_id"]: (r["recent_requests"], r["recent_tokens"], r["day_requests"]) for r in telemetry.sliding_load(frame).collect()}


def test_batches_in_order_of_time(spark, tmp_path):
    """Seconds aren't torn apart between micro-batches; keys go on from their state, past midnight."""
    rows = requests()
    cuts = [0, *(next(i for i in range(c, len(rows)) if rows[i][0] != rows[i - 1][0]) for c in (130, 260)), len(rows)]
    assert feed(spark, tmp_path, [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]) == batch_load(spark, rows)


def test_late_rows_count_for_themselves_and_those_after(spark, tmp_path):
    rows = [(1_700_000_000 + 10 * i, i, "a", 1) for i in range(30)]
    late = [(1_700_000_000 + 205, 100, "a", 5)]  # within the ten minutes
    after = [(1_700_000_000 + 300, 101, "a", 1)]
    got = feed(spark, tmp_path, [rows, late, after])
    whole = batch_load(spark, [*rows, *late, *after])
    assert got[100] == whole[100] and got[101] == whole[101] and got[25] == batch_load(spark, rows)[25]


def test_state_is_bounded(monkeypatch):
    """After many requests a key has no more seconds than the window and the lateness, and a timer to clear it."""
    pd, np = pytest.importorskip("pandas"), pytest.importorskip("numpy")

    class Held:
        def __init__(self):
            self.rows, self.days, self.timers = [], {}, []

        def getListState(self, name, schema):
            return self

        def getMapState(self, name, one, two):
            held = self

            class Days:
                iterator = staticmethod(lambda: [((d,), (n,)) for d, n in held.days.items()])
                containsKey = staticmethod(lambda d: d[0] in held.days)
                removeKey = staticmethod(lambda d: held.days.pop(d[0]))
                updateValue = staticmethod(lambda d, n: held.days.__setitem__(d[0], n[0]))
                clear = staticmethod(lambda: held.days.clear())

            return Days()

        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)
        clear = lambda self: self.rows.clear()
        listTimers = lambda self: list(self.timers)
        deleteTimer = lambda self, t: self.timers.remove(t)
        registerTimer = lambda self, t: self.timers.append(t)

        def put(self, rows):
            self.rows = rows

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    held, processor = Held(), load._Load(60, 100)
    processor.init(held)
    for i in range(50):
        at = 1_700_000_000 + 5000 * i + np.arange(4000)
        list(processor.handleInputRows(("a",), iter([pd.DataFrame({"request_id": at, "second": at, "tokens": 1})]), Times()))
        assert len(held.rows) <= 160 and len(held.days) <= 2 and len(held.timers) == 1
    list(processor.handleExpiredTimer(("a",), Times(), None))
    assert not held.rows and not held.days
