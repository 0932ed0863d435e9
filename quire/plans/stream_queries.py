"""Queries of job queues, messages, feeds and streams: tables after a step, and streams run over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.session import table
from quire.streaming import jobs, leases, observations, run

NOW = "TIMESTAMP '2024-02-01 00:00:00'"
JOBS_SQL = """SELECT event_id AS id, 'lane' || user_id % 3 AS source, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'claimed' WHEN 'purchase' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'done' END AS status,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'a' || event_id % 40 END AS agent_id, ts AS requested_at FROM events"""


def _jobs(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "view", "queued").when(kind == "click", "claimed").when(kind == "purchase", "running").when(kind == "error", "failed").otherwise("done")
    active = kind.isin("click", "purchase")
    e = table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    none = F.lit(None).cast("timestamp")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("lane"), F.col("user_id") % 3).alias("source"), status.alias("status"), F.when(active, F.concat(F.lit("a"), F.col("event_id") % 40)).alias("agent_id"), ts.alias("requested_at"), F.when(active, ts).alias("claimed_at"), none.alias("heartbeat_at"), F.lit(None).cast("string").alias("error_code"))


AGENTS_SQL = "SELECT DISTINCT 'a' || user_id AS agent, 'lane' || user_id % 3 AS source FROM events"


def _agents(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("a"), "user_id").alias("agent"), F.concat(F.lit("lane"), F.col("user_id") % 3).alias("source")).distinct()


@query(
    f"""WITH j AS ({JOBS_SQL}), g AS ({AGENTS_SQL}), b AS (SELECT DISTINCT agent_id FROM j WHERE status IN ('claimed', 'running')), f AS (SELECT agent, source, row_number() OVER (PARTITION BY source ORDER BY agent) AS k FROM g WHERE agent NOT IN (SELECT agent_id FROM b)),
    q AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY requested_at, id) AS k FROM j WHERE status = 'queued'), w AS (SELECT q.id, agent FROM q JOIN f ON f.source = q.source AND f.k = q.k)
    SELECT j.id, CASE WHEN w.id IS NOT NULL THEN 'claimed' ELSE status END AS status, coalesce(w.agent, agent_id) AS agent_id, w.id IS NOT NULL OR status IN ('claimed', 'running') AS alive FROM j LEFT JOIN w ON w.id = j.id"""
)
def job_claims(spark, d):
    out = jobs.claim(_jobs(spark, d), _agents(spark, d), F.expr(NOW))
    return out.select("id", "status", "agent_id", F.col("heartbeat_at").isNotNull().alias("alive"))


@query(f"WITH j AS ({JOBS_SQL}) SELECT id, CASE WHEN status IN ('claimed', 'running') AND requested_at < TIMESTAMP '2024-01-01 12:00:00' THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('claimed', 'running') AND requested_at < TIMESTAMP '2024-01-01 12:00:00' THEN 'lease_expired' END AS error_code FROM j")
def lease_expiry(spark, d):
    return jobs.expire(_jobs(spark, d), F.expr("TIMESTAMP '2024-01-02 00:00:00'"), "12 hours").select("id", "status", "error_code")


@query(
    f"""WITH j AS ({JOBS_SQL}), w AS (SELECT *, CASE id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'done' END AS goal, CASE WHEN id % 2 = 0 THEN 'E1' END AS err, 'a' || id % 40 AS agent FROM j WHERE id % 4 > 0),
    k AS (SELECT id, goal, err, (goal IN ('running', 'failed') AND status = 'claimed' OR goal IN ('done', 'failed') AND status = 'running') AND (goal <> 'failed' OR err IS NOT NULL) AND (agent_id IS NULL OR agent_id = agent) AS ok FROM w)
    SELECT j.id, CASE WHEN ok THEN goal ELSE status END AS status, ok AS accepted FROM j LEFT JOIN k ON k.id = j.id"""
)
def job_transitions(spark, d):
    j = _jobs(spark, d)
    goal = F.when(F.col("id") % 3 == 0, "running").when(F.col("id") % 3 == 1, "failed").otherwise("done")
    wanted = j.filter("id % 4 > 0").select("id", F.concat(F.lit("a"), F.col("id") % 40).alias("agent"), goal.alias("to"), F.when(F.col("id") % 2 == 0, "E1").alias("error"))
    return jobs.transition(j, wanted).select("id", "status", "accepted")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 5 > 0")
def stable_inputs(spark, d):
    now = table(spark, d, "customer").select(F.col("c_custkey"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("length"), F.lit(1).alias("modified"))
    before = now.withColumn("modified", F.when(F.col("c_custkey") % 3 > 0, 1).otherwise(0))
    return jobs.stable_inputs(before.drop("c_custkey"), now, now.filter("c_custkey % 5 = 0").drop("c_custkey")).select("c_custkey")


MESSAGES_SQL = "SELECT event_id AS ordinal, 'u' || user_id AS sender, 'k' || event_id % 7 AS key, event_type AS body FROM events"


@query(
    f"""WITH m AS ({MESSAGES_SQL}), o AS (SELECT * FROM m WHERE ordinal < 100 QUALIFY row_number() OVER (PARTITION BY sender, key ORDER BY ordinal) = 1), b AS (SELECT * FROM m WHERE ordinal >= 100),
    u AS (SELECT sender, key, CAST(-1 AS BIGINT) AS ordinal, body FROM o UNION ALL SELECT sender, key, ordinal, body FROM b), f AS (SELECT sender, key, arg_min(body, ordinal) AS body, min(ordinal) AS first FROM u GROUP BY 1, 2)
    SELECT b.ordinal, CASE WHEN f.first = b.ordinal THEN 'new' WHEN f.body = b.body THEN 'same' ELSE 'conflict' END AS result FROM b JOIN f USING (sender, key)"""
)
def idempotent_messages(spark, d):
    m = table(spark, d, "events").select(F.col("event_id").alias("ordinal"), F.concat(F.lit("u"), "user_id").alias("sender"), F.concat(F.lit("k"), F.col("event_id") % 7).alias("key"), F.col("event_type").alias("body"))
    stored = m.filter("ordinal < 100").groupBy("sender", "key").agg(F.min_by("body", "ordinal").alias("body"))
    return jobs.idempotent_messages(stored, m.filter("ordinal >= 100")).select("ordinal", "result")


@query(
    """WITH m AS (SELECT conv_id, turn, conv_id % 3 = 0 AS closed, turn % 2 AS recipient FROM conversations) SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'repeated' WHEN closed THEN 'rejected' WHEN recipient = 1 THEN 'acknowledged' ELSE 'rejected' END AS result FROM m"""
)
def acknowledgements(spark, d):
    m = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 2).cast("string").alias("recipient"), (F.col("turn") % 4 == 3).alias("acknowledged"))
    topics = m.select("conv_id").distinct().withColumn("closed", F.col("conv_id") % 3 == 0)
    return jobs.acknowledge(m, topics, "conv_id", F.lit("1")).select("conv_id", "turn", "result")


@query("SELECT user_id, count(*) AS steps, bool_and(ok) AS in_order FROM (SELECT user_id, event_type <> 'purchase' OR lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IN ('click', 'view') AS ok FROM events) GROUP BY 1")
def ledger_order(spark, d):
    return jobs.ordered_ledger(table(spark, d, "events"), "user_id", "event_id", "event_type", {"purchase": ("click", "view")})


@query("SELECT user_id AS artist, count(*) FILTER (event_type = 'view') AS added, count(*) FILTER (event_type = 'click') AS skipped, count(*) FILTER (event_type = 'error') AS errors, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'ok' WHEN count(*) FILTER (event_type = 'view') > 0 THEN 'partial' ELSE 'failed' END AS status FROM events GROUP BY 1")
def feed_runs(spark, d):
    e = table(spark, d, "events")
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    got = e.groupBy(F.col("user_id").alias("artist")).agg(n("view").alias("added"), n("click").alias("skipped"), n("error").alias("errors"))
    return got.withColumn("status", jobs.run_status(F.col("added"), F.col("errors")))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    e = run.stream(spark, d, "events", table(spark, d, "events").schema)
    # the watermark holds the newest windows back; these are counted as a table
    counted = observations.windowed(e.withColumn("ts", F.col("ts").cast("timestamp")), "0 seconds")
    done = run.available_now(counted).select("start", "event_type", "n")
    last = observations.windowed_rest(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), done)
    return done.unionByName(last).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    """WITH o AS (SELECT event_id AS id, user_id AS w, value AS price, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial' ELSE 'ok' END AS status FROM events),
    p AS (SELECT *, last_value(CASE WHEN status <> 'failed' THEN price END IGNORE NULLS) OVER (PARTITION BY w ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM o) SELECT id, w AS watch_id, price, prev AS previous FROM p WHERE price < prev"""
)
def stream_price_drops(spark, d):
    e = run.stream(spark, d, "events", table(spark, d, "events").schema)
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "partial").otherwise("ok")
    o = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("watch_id"), F.col("value").alias("price"), status.alias("status"))
    return run.available_now(observations.price_events(o)).filter("kind = 'drop'").select("id", "watch_id", "price", "previous")


@query(
    """WITH s AS (SELECT user_id, epoch_us(ts) // 1000 AS moment, event_type = 'purchase' AS done FROM events), n AS (SELECT *, lead(moment) OVER (PARTITION BY user_id ORDER BY moment, done) AS next FROM s)
    SELECT user_id, moment AS last_sign, moment + 86400000 AS expired_at FROM n WHERE NOT done AND moment + 86400000 <= (SELECT max(moment) - 3600000 FROM s) AND (next IS NULL OR next > moment + 86400000)"""
)
def lease_expiries(spark, d):
    """Users without a sign of life for a day, as a stream with timers over all events; a purchase ends a lease."""
    e = run.stream(spark, d, "events", table(spark, d, "events").schema)
    signs = e.select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("done"))
    found = leases.with_store(spark, lambda: run.available_now(leases.expiries(signs, 86_400_000, "1 hour")))
    return found.withColumnRenamed("job", "user_id")


@query(
    """WITH s AS (SELECT user_id, epoch_us(ts) // 1000 AS moment, event_type = 'purchase' AS done FROM events), n AS (SELECT *, lead(moment) OVER (PARTITION BY user_id ORDER BY moment, done) AS next FROM s)
    SELECT user_id, count(*) AS expiries, max(moment) AS last FROM n WHERE NOT done AND moment + 43200000 <= (SELECT max(moment) FROM s) AND (next IS NULL OR next > moment + 43200000) GROUP BY 1"""
)
def lease_expiry_counts(spark, d):
    """How often each user's lease of half a day ran out, from the whole table."""
    signs = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("done"))
    return leases.expiries_of_table(signs, 43_200_000, 0).groupBy(F.col("job").alias("user_id")).agg(F.count("*").alias("expiries"), F.max("last_sign").alias("last"))
