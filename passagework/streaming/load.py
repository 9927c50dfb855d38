"""The exact load of the last minute at each request, as a stream with list state, map state and timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOAD_SCHEMA = "request_id long, key string, recent_requests long, recent_tokens long, day_requests long"
DAY = 86_400


class _Load(StatefulProcessor):
    """Of each key the seconds that a request may still look back on, with their requests and tokens, and the counts of days from before them."""

    def __init__(self, seconds: int, late: int):
        self.seconds, self.late = seconds, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "second long, n long, tokens long")
        self.days = handle.getMapState("days", "day long", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = new[new["second"] * 1000 >= timerValues.getCurrentWatermarkInMs() - 999]
        if new.empty:
            return
        held = list(self.recent.get()) if self.recent.exists() else []
        old = np.array(held, dtype=np.int64).reshape(-1, 3)
        second, number = np.unique(np.concatenate([old[:, 0], new["second"].to_numpy()]), return_inverse=True)
        n, tokens = np.zeros((2, len(second)), dtype=np.int64)
        np.add.at(n, number, np.concatenate([old[:, 1], np.ones(len(new), np.int64)]))
        np.add.at(tokens, number, np.concatenate([old[:, 2], new["tokens"].to_numpy()]))
        days = {day[0]: count[0] for day, count in self.days.iterator()}
        at = number[len(old) :]
        begin = np.searchsorted(second, second - self.seconds, side="right")
        sums, weights = (np.concatenate([[0], np.cumsum(x)]) for x in (n, tokens))
        day = second // DAY
        of_day = sums[1:] - sums[np.searchsorted(day, day)] + np.array([days.get(d, 0) for d in day.tolist()])
        result = {"request_id": new["request_id"].to_numpy(), "key": key[0], "recent_requests": (sums[1:] - sums[begin])[at], "recent_tokens": (weights[1:] - weights[begin])[at], "day_requests": of_day[at]}
        keep = second > second[-1] - self.seconds - self.late
        for d, count in zip(day[~keep].tolist(), n[~keep].tolist(), strict=True):
            days[d] = days.get(d, 0) + count
        self.recent.put([tuple(map(int, x)) for x in zip(second[keep], n[keep], tokens[keep], strict=True)])
        for d in [d for d in days if (d + 1) * DAY <= second[-1] - self.seconds - self.late]:  # none of its requests can come any more
            if self.days.containsKey((d,)):
                self.days.removeKey((d,))
            del days[d]
        for d, count in days.items():
            self.days.updateValue((d,), (count,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        end_of_day = (int(day[-1]) + 1) * DAY
        self.handle.registerTimer(1000 * max(int(second[-1]) + self.seconds + self.late, end_of_day + self.late))
        yield pd.DataFrame(result)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        self.days.clear()
        yield from ()

    def close(self) -> None:
        pass


def request_load(requests: DataFrame, seconds: int = 60, late: int = 600) -> DataFrame:
    """(request_id, key, recent_requests, recent_tokens, day_requests) of a stream (request_id, key, ts, tokens).

    For each request: how many its key has made in the ``seconds`` up to it, with how many tokens, and on its day so far;
    those of the same second count too. What comes in one micro-batch is put in order first; what comes up to ``late``
    seconds late counts for itself and those after it, but rows that are out aren't revised; later ones are left out. A
    key keeps a row for each of the last ``seconds`` + ``late`` seconds at most, and one for the day; when the watermark has
    passed all of it, a timer clears the key. The query needs ROCKSDB in the session.
    """
    told = requests.select(F.col("request_id").cast("long").alias("request_id"), F.col("key").cast("string").alias("key"), "ts", F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
    told = told.withWatermark("ts", f"{late} seconds").withColumn("second", F.round(F.unix_micros("ts") / 1e6).cast("long"))
    return told.groupBy("key").transformWithStateInPandas(_Load(seconds, late), LOAD_SCHEMA, "Append", "EventTime")


#: The state store that list state, map state and timers need.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
