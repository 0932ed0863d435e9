"""Timeouts as streaming state: leases that end when no sign of life comes in time, by event time.

A claim or a heartbeat gives its job a lease of a fixed length; one that comes within it extends it; `done` ends it. Signs
may come late or out of order up to the watermark, so a lease is known to have expired only when the watermark has passed
its end; until then the job's undecided signs are its state, and a timer waits for the earliest end. A job that is done and
decided leaves no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State with timers is kept in this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def decided(signs: list[tuple[int, bool]], timeout: int, watermark: int) -> tuple[list[int], list[tuple[int, bool]]]:
    """(signs whose lease has expired, signs that are still undecided) of one job's (time, done) at a watermark."""
    signs = sorted(signs)
    gone, left = [], []
    for i, (at, done) in enumerate(signs):
        if at + timeout > watermark:
            left.append((at, done))
        elif not done and (i + 1 == len(signs) or signs[i + 1][0] > at + timeout):
            gone.append(at)
    return gone, left


class Leases(StatefulProcessor):
    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.signs = handle.getListState("signs", "at long, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        new = [(int(at), bool(done)) for batch in rows for at, done in zip(batch["at"], batch["done"]) if at > watermark]
        yield from self._settle(key, [*map(tuple, self.signs.get()), *new], watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, [*map(tuple, self.signs.get())], timerValues.getCurrentWatermarkInMs())

    def _settle(self, key, signs: list[tuple[int, bool]], watermark: int) -> Iterator[pd.DataFrame]:
        gone, left = decided(signs, self.timeout, watermark)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left:
            self.signs.put(left)
            self.handle.registerTimer(left[0][0] + self.timeout)
        else:
            self.signs.clear()
        if gone:
            yield pd.DataFrame({"job": [key[0]] * len(gone), "last_sign": gone, "expired_at": [at + self.timeout for at in gone]})

    def close(self) -> None:
        pass


def expiries(signs: DataFrame, timeout_ms: int, delay: str) -> DataFrame:
    """(job, last_sign, expired_at) of leases that expired, of a stream (job, ts timestamp, done boolean). Times in milliseconds.
    Signs that come more than `delay` after later ones were seen may be left out."""
    rows = signs.withWatermark("ts", delay).select("job", "ts", F.unix_millis("ts").alias("at"), "done")
    kind = signs.schema["job"].dataType.simpleString()
    return rows.groupBy("job").transformWithStateInPandas(Leases(timeout_ms), f"job {kind}, last_sign long, expired_at long", "Append", "EventTime")


def expiries_of_table(signs: DataFrame, timeout_ms: int, delay_ms: int) -> DataFrame:
    """The same of a whole table, up to the watermark that a stream of it ends with."""
    at = signs.select("job", F.unix_millis("ts").alias("at"), "done")
    last = at.agg((F.max("at") - delay_ms).alias("watermark"))
    following = F.lead("at").over(Window.partitionBy("job").orderBy("at", "done"))
    rows = at.withColumn("next", following).crossJoin(F.broadcast(last))
    end = F.col("at") + timeout_ms
    gone = rows.filter(~F.col("done") & (end <= F.col("watermark")) & F.coalesce(F.col("next") > end, F.lit(True)))
    return gone.select("job", F.col("at").alias("last_sign"), end.alias("expired_at"))


def with_store(spark: SparkSession, work):
    """The result of work(), with the state store that timers need; the session's setting is put back."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        return work()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
