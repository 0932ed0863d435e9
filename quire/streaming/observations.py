"""Observation streams: price events and their outbox, counted views, feeds, stable inputs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "id long, watch_id long, kind string, price double, previous double"


def price_events(observations: DataFrame, threshold: float = 0.5, list_price: float = 100.0) -> DataFrame:
    """Drops and crossings of a stream of (id, watch_id, price, status), the rows of a watch in the order of ids in each
    batch. A row counts as previous when its price is known and its status ok or partial; a crossing looks at the ratio
    of ok rows. State is two numbers for each watch, so it grows with the watches only."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        price, ratio = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(batches)).sort_values("id").itertuples():
            known = r.price is not None and r.price == r.price
            now = r.price / list_price if known and r.status == "ok" else None
            if known and price is not None and r.price < price:
                out.append((r.id, key[0], "drop", r.price, price))
            if now is not None and now < threshold and (ratio is None or ratio >= threshold):
                out.append((r.id, key[0], "below_threshold", r.price, price))
            if known and r.status in ("ok", "partial"):
                price, ratio = float(r.price), now
        state.update((price, ratio))
        if out:
            yield pd.DataFrame(out, columns=["id", "watch_id", "kind", "price", "previous"])

    return observations.groupBy("watch_id").applyInPandasWithState(step, EVENTS, "price double, ratio double", "append", GroupStateTimeout.NoTimeout)


def counted_views(views: DataFrame, seconds: int = 300) -> DataFrame:
    """(user_id, views, counted) so far, for users with new views in a batch: a view counts if it comes `seconds` after the
    one before, counted or not."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, counted = state.get if state.exists else (None, 0, 0)
        for ts in pd.concat(list(batches)).sort_values("event_id")["ts"]:
            now = ts.value // 1000
            counted += last is None or now - last >= seconds * 1_000_000
            last, n = now, n + 1
        state.update((last, n, counted))
        yield pd.DataFrame([(key[0], n, counted)], columns=["user_id", "views", "counted"])

    return views.groupBy("user_id").applyInPandasWithState(step, "user_id long, views long, counted long", "last long, views long, counted long", "update", GroupStateTimeout.NoTimeout)


def new_items(feed: DataFrame) -> DataFrame:
    """Items of a stream of feed heads (artist, place, item) that come before the head seen last; all of a first head, and
    all where the old one is not there any more."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("place")
        fresh = []
        for item in rows["item"]:
            if item == top:
                break
            fresh.append(item)
        state.update((int(rows["item"].iloc[0]),))
        if fresh:
            yield pd.DataFrame({"artist": key[0], "item": fresh})

    return feed.groupBy("artist").applyInPandasWithState(step, "artist string, item long", "top long", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type in windows; what comes later than `late` is left out, and state with it."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def windowed_rest(events: DataFrame, done: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts of the windows that a stream holds back until its watermark passes them, from a table of the same events."""
    got = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    return got.join(done.select("start", "event_type"), ["start", "event_type"], "left_anti")


class Outbox:
    """At-least-once delivery: events are added once for each (id, kind), and are pending until they are marked.

    Both tables are folders to which rows are only added. A batch that is run again adds nothing that is there.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def events(self) -> DataFrame:
        return self._read("events", EVENTS)

    def add(self, batch: DataFrame, epoch: int = 0) -> None:
        """For foreachBatch."""
        fresh = batch.dropDuplicates(["id", "kind"]).join(self.events().select("id", "kind"), ["id", "kind"], "left_anti")
        fresh.write.mode("append").parquet(f"{self.path}/events")

    def pending(self) -> DataFrame:
        return self.events().join(self._read("sent", "id long, kind string").distinct(), ["id", "kind"], "left_anti")

    def mark(self, sent: DataFrame) -> None:
        """After delivery has succeeded; what is not marked is delivered again."""
        sent.select("id", "kind").write.mode("append").parquet(f"{self.path}/sent")
