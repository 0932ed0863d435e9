import datetime

import pytest
from pyspark.sql import functions as F

from quire.streaming import jobs, observations

DAY = datetime.datetime(2024, 1, 1)


def run(spark, tmp_path, batches, schema, transform, mode):
    """Feed batches one file at a time, collect what each gives."""
    source = tmp_path / "in"
    source.mkdir()
    got = []
    stream = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            q.processAllAvailable()
    finally:
        q.stop()
    return got


def test_price_events(spark, tmp_path):
    schema = "id long, watch_id long, price double, status string"
    batches = [[(1, 1, 90.0, "ok"), (2, 1, None, "ok")], [(3, 1, 80.0, "ok"), (4, 1, 45.0, "ok"), (5, 1, 40.0, "partial"), (6, 1, 30.0, "ok"), (7, 1, 20.0, "ok")]]
    got = run(spark, tmp_path, batches, schema, observations.price_events, "append")
    assert sorted(got) == sorted(
        [(3, 1, "drop", 80.0, 90.0), (4, 1, "drop", 45.0, 80.0), (4, 1, "below_threshold", 45.0, 80.0), (5, 1, "drop", 40.0, 45.0), (6, 1, "drop", 30.0, 40.0), (6, 1, "below_threshold", 30.0, 40.0), (7, 1, "drop", 20.0, 30.0)]
    )


def test_counted_views(spark, tmp_path):
    at = lambda s: DAY + datetime.timedelta(seconds=s)
    batches = [[(1, 1, at(0)), (2, 1, at(200))], [(3, 1, at(450)), (4, 1, at(800))]]
    got = run(spark, tmp_path, batches, "event_id long, user_id long, ts timestamp", observations.counted_views, "update")
    assert got == [(1, 2, 1), (1, 4, 2)]


def test_new_items(spark, tmp_path):
    batches = [[("a", 0, 7), ("a", 1, 6)], [("a", 0, 9), ("a", 1, 8), ("a", 2, 7)], [("a", 0, 20), ("a", 1, 19)]]
    got = run(spark, tmp_path, batches, "artist string, place int, item long", observations.new_items, "append")
    assert got == [("a", 7), ("a", 6), ("a", 9), ("a", 8), ("a", 20), ("a", 19)]


def test_outbox(spark, tmp_path):
    box = observations.Outbox(spark, str(tmp_path / "box"))
    rows = spark.createDataFrame([(1, 1, "drop", 1.0, 2.0), (2, 1, "drop", 1.0, 2.0)], observations.EVENTS)
    box.add(rows)
    box.add(rows)
    assert box.pending().count() == 2
    box.mark(box.pending().filter("id = 1"))
    assert [r.id for r in box.pending().collect()] == [2]


@pytest.fixture
def table(spark):
    at = lambda m: DAY + datetime.timedelta(minutes=m)
    rows = [(1, "x", "queued", at(0), None, None, None, None), (2, "x", "queued", at(1), None, None, None, None), (3, "x", "running", at(0), at(1), at(2), "c", None), (4, "y", "queued", at(0), None, None, None, None)]
    return spark.createDataFrame(rows, "id long, source string, status string, requested_at timestamp, claimed_at timestamp, heartbeat_at timestamp, agent_id string, error_code string")


def test_claim_and_expire(spark, table):
    agents = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x")], "agent string, source string")
    now = F.lit(DAY + datetime.timedelta(minutes=30)).cast("timestamp")
    got = {r.id: (r.status, r.agent_id) for r in jobs.claim(table, agents, now).collect()}
    assert got == {1: ("claimed", "a"), 2: ("claimed", "b"), 3: ("running", "c"), 4: ("queued", None)}
    got = {r.id: (r.status, r.error_code) for r in jobs.expire(table, now, "10 minutes").collect()}
    assert got[3] == ("failed", "lease_expired") and got[1] == ("queued", None)


def test_transitions(spark, table):
    wanted = spark.createDataFrame([(3, "c", "done", None), (1, "a", "done", None), (4, "a", "claimed", None)], "id long, agent string, to string, error string")
    got = {r.id: (r.status, r.accepted) for r in jobs.transition(table, wanted).collect()}
    assert got == {1: ("queued", False), 2: ("queued", None), 3: ("done", True), 4: ("claimed", True)}


def test_messages_and_inputs(spark):
    known = spark.createDataFrame([("s", "k1", "b")], "sender string, key string, body string")
    batch = spark.createDataFrame([(0, "s", "k1", "b"), (1, "s", "k2", "x"), (2, "s", "k2", "x"), (3, "s", "k2", "y")], "ordinal long, sender string, key string, body string")
    got = {r.ordinal: r.result for r in jobs.idempotent_messages(known, batch).collect()}
    assert got == {0: "same", 1: "new", 2: "same", 3: "conflict"}
    look = lambda *rows: spark.createDataFrame(list(rows), "name string, length long, modified long")
    assert [r.name for r in jobs.stable_inputs(look(("a", 1, 1), ("b", 1, 1), ("c", 1, 1)), look(("a", 1, 1), ("b", 2, 1), ("c", 1, 1)), look(("c", 1, 1))).collect()] == ["a"]


def test_a_first_step_has_nothing_to_come_after(spark):
    rows = [(1, 1, "purchase"), (2, 2, "purchase"), (2, 3, "view"), (2, 4, "purchase"), (3, 5, "view"), (3, 6, "error"), (3, 7, "purchase"), (4, 8, None), (4, 9, "purchase"), (4, 10, "click")]
    got = jobs.ordered_ledger(spark.createDataFrame(rows, "k long, n long, e string"), "k", "n", "e", {"purchase": ("click", "view")})
    assert {r.k: (r.steps, r.in_order) for r in got.collect()} == {1: (1, None), 2: (3, True), 3: (3, False), 4: (3, True)}
