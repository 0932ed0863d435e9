"""Queries of audits, small selections and published stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import audits, records
from quire.plans.adapters import ITEMS_SQL, PAGES_SQL, items, pages
from quire.plans.registry import query
from quire.session import table
from quire.sources.publications import Publication, orphans, repeated
from quire.sources.shared import new_folder

TERMS = """b AS (SELECT item_id, md5(text) AS digest, text, CASE WHEN item_id % 2 = 0 THEN replace(text, 'tion', 'tian') ELSE text END AS reading FROM benchmark), d AS (SELECT DISTINCT digest, text, reading FROM b WHERE item_id % 5 <> 4),
    t AS (SELECT digest, text, reading, unnest(['the', 'tion', 'zzz']) AS term FROM d), r AS (SELECT digest, term, (length(text) - length(replace(text, term, ''))) // length(term) AS expected, (length(reading) - length(replace(reading, term, ''))) // length(term) AS actual FROM t)"""


def _recall(spark, d):
    b = table(spark, d, "benchmark").withColumn("digest", F.md5("text"))
    reading = F.when(F.col("item_id") % 2 == 0, F.replace("text", F.lit("tion"), F.lit("tian"))).otherwise(F.col("text"))
    here = b.filter("item_id % 5 <> 4")
    annotations = b.select("digest", F.array(*map(F.lit, ("the", "tion", "zzz"))).alias("terms")).distinct()
    return audits.term_recall(annotations, here.select("digest", "text").distinct(), here.select("digest", reading.alias("reading")).distinct(), "digest", "terms", "text", "reading")


@query(f"WITH {TERMS} SELECT digest, term, expected, actual, least(expected, actual) AS matched, expected - least(expected, actual) AS missing FROM r WHERE expected > 0")
def annotated_recall(spark, d):
    return _recall(spark, d)[0]


@query(f"WITH {TERMS} SELECT digest, term, 'term is not in the reference' AS problem FROM r WHERE expected = 0 UNION ALL SELECT DISTINCT digest, NULL, 'no such page' FROM b WHERE digest NOT IN (SELECT digest FROM d)")
def annotation_problems(spark, d):
    return _recall(spark, d)[1]


@query(
    f"""WITH {TERMS}, x AS (SELECT count(DISTINCT term) AS terms, sum(expected) AS expected, sum(expected - least(expected, actual)) AS missing FROM r WHERE expected > 0),
    p AS (SELECT (SELECT count(*) FROM r WHERE expected = 0) + (SELECT count(DISTINCT digest) FROM b WHERE digest NOT IN (SELECT digest FROM d)) AS n)
    SELECT unnest(['resolved', 'terms', 'expected', 'recall', 'missing']) AS check, unnest([CAST(n AS DOUBLE), terms, expected, round((expected - missing) / expected, 6), missing]) AS value, unnest([n = 0, terms >= 2, expected >= 50, (expected - missing) / expected >= 0.9, missing <= 10]) AS passed FROM x, p"""
)
def annotation_gate(spark, d):
    return audits.term_gate(*_recall(spark, d), 2, 50, 0.9, 10)


@query(
    """WITH p AS (SELECT c_custkey, c_name || ' and ' || c_mktsegment AS text FROM customer WHERE c_mktsegment <> 'BUILDING'), l AS (SELECT c_name AS name FROM customer WHERE c_nationkey < 5 AND c_acctbal < 0)
    SELECT name, count(*) AS pages FROM l JOIN p ON contains(p.text, l.name) GROUP BY 1"""
)
def unexplained_deletions(spark, d):
    c = table(spark, d, "customer").withColumn("name", F.col("c_name"))
    published, prepared = c.filter("c_nationkey < 5"), c.filter("c_acctbal >= 0")
    aliases = c.select("name", F.col("name").alias("alias"), F.lit(False).alias("derived"))
    texts = c.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("page"), F.concat_ws(" and ", "c_name", "c_mktsegment").alias("text"))
    return audits.unexplained_deletions(published, prepared, aliases, texts, "name", "alias", "derived", "page", "text")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'missing' WHEN o_orderpriority = '1-URGENT' THEN 'repeated' WHEN o_orderpriority = '2-HIGH' THEN 'version' ELSE 'body' END AS problem FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"""
)
def changed_sources(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("string").alias("version"), F.md5(F.col("o_totalprice").cast("string")).alias("digest"))
    priority = F.col("o_orderpriority")
    now = o.filter("o_orderstatus <> 'P'").withColumns({"version": F.when(priority == "2-HIGH", "later").otherwise(F.col("version")), "digest": F.when(priority == "3-MEDIUM", "other").otherwise(F.col("digest"))})
    now = now.unionByName(now.filter(priority == "1-URGENT"))
    return audits.changed_sources(o, now, "o_orderkey", "version", "digest")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN -7 ELSE levenshtein(text, CASE WHEN turn % 2 = 0 THEN replace(text, 'e', '') ELSE text END) END AS distance, turn % 3 = 0 AS computed FROM conversations WHERE text IS NOT NULL")
def refreshed_rates(spark, d):
    """Rates of readings; those in the cache have a distance that no computation gives."""
    c = table(spark, d, "conversations").filter("text is not null")
    pairs = c.select(F.struct("conv_id", "turn").alias("key"), "turn", F.col("text").alias("r"), F.when(F.col("turn") % 2 == 0, F.replace("text", F.lit("e"), F.lit(""))).otherwise(F.col("text")).alias("h"))
    old = F.when(F.col("turn") % 3 > 0, F.sha2("h", 256)).otherwise(F.sha2(F.lit("an older reading"), 256))
    cache = pairs.select("key", F.sha2("r", 256).alias("reference_sha"), old.alias("hypothesis_sha"), F.lit(-7).cast("long").alias("distance"))
    return audits.refreshed_rates(cache, pairs, "key", "r", "h").select("key.*", "distance", "computed")


@query("SELECT conv_id, sha256('ctx' || chr(29) || string_agg(turn || chr(31) || coalesce(text, '') || chr(30), '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def block_digests(spark, d):
    return audits.block_digest(table(spark, d, "conversations"), "conv_id", "turn", "text", "ctx")


@query("SELECT 'customer' AS store, count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS keys, false AS damaged FROM customer UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT), false FROM orders UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT), false FROM lineitem")
def store_backup(spark, d):
    """Three stores backed up together, replaced by emptier ones, and restored from the first revision."""
    at = Publication(spark, new_folder(spark, "backup"))
    stores = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    tables = {name: table(spark, d, name) for name in stores}
    checks = {"orders without a customer": orphans("orders", "o_custkey", "customer", "c_custkey"), "lines without an order": orphans("lineitem", "l_orderkey", "orders", "o_orderkey"), "orders twice": repeated("orders", "o_orderkey")}
    first = at.publish(tables, checks, expected=0)
    at.publish({name: df.filter("false") for name, df in tables.items()}, checks, expected=first)
    at.restore(first)
    damaged = bool(at.damaged())
    found = [at.read(name).agg(F.lit(name).alias("store"), F.count("*").alias("rows"), F.sum(key).alias("keys"), F.lit(damaged).alias("damaged")) for name, key in stores.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


WITH_PAGES = f"WITH pages_ AS ({PAGES_SQL})"


@query("SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0) AND n_regionkey <> 0")
def ready_books(spark, d):
    n = table(spark, d, "nation").select("n_name", "n_nationkey", F.when(F.col("n_regionkey") != 0, F.lit("2024")).alias("indexed_at"))
    wanted = n.join(table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    return records.ready(n, "n_name", "indexed_at", wanted)


@query(f"{WITH_PAGES} SELECT book, count(*) FILTER (char_count < 300 OR page_no <= 5 OR page_no > page_count - 5) AS skipped, count(*) AS pages FROM pages_ GROUP BY 1")
def context_skips(spark, d):
    p = pages(spark, d).withColumn("skip", records.skips_context(F.col("char_count"), F.col("page_no"), F.col("page_count")))
    return p.groupBy("book").agg(F.count_if("skip").alias("skipped"), F.count("*").alias("pages"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_discount > 0.05 AND l_tax < 0.04 AND l_linenumber > 2")
def tuning_pages(spark, d):
    t = table(spark, d, "lineitem")
    kind = F.when(F.col("l_linestatus") == "O", "narrative")
    layout = F.when(F.col("l_discount") > 0.05, "normal_prose").otherwise("full_width")
    engine = F.when(F.col("l_tax") < 0.04, "reviewer").otherwise("other")
    corrected = F.when(F.col("l_linenumber") > 2, " text").when(F.col("l_linenumber") == 2, " 　")
    return t.filter(records.tuning_page(F.col("l_returnflag") == "N", kind, layout, engine, "reviewer", corrected)).select("l_orderkey", "l_linenumber")


@query(f"WITH i AS ({ITEMS_SQL}) SELECT item, authors IS NOT NULL OR volume > 25 AS meaningful FROM i")
def meaningful_entries(spark, d):
    i = items(spark, d).withColumn("late", F.when(F.col("volume") > 25, F.col("volume")))
    return i.select("item", records.meaningful(i, ["authors", "late"]).alias("meaningful"))


@query("SELECT conv_id, turn FROM conversations WHERE text <> '' AND role <> 'assistant'")
def pending_pages(spark, d):
    c = table(spark, d, "conversations").withColumn("names", F.when(F.col("role") == "assistant", F.lit("[]")))
    return records.pending(c, "text", "names").select("conv_id", "turn")


@query(
    """WITH a AS (SELECT l_orderkey, list(CAST(l_suppkey AS VARCHAR) ORDER BY l_linenumber, l_suppkey) AS l FROM lineitem GROUP BY 1)
    SELECT o_orderkey, c_name, n_name, array_to_string(coalesce(l, []), ',') AS authors FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON n_nationkey = c_nationkey LEFT JOIN a ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'"""
)
def job_identities(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    books = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("__c")).join(table(spark, d, "customer"), F.col("__c") == F.col("c_custkey")).select("o_orderkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    series = table(spark, d, "nation").filter("n_regionkey < 3").select("n_nationkey", "n_name")
    authors = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_suppkey").alias("place"), F.col("l_suppkey").cast("string").alias("author"))
    j = records.job_identity(o, books, series, authors, "o_orderkey", "n_nationkey", "author", "place")
    return j.select("o_orderkey", "c_name", "n_name", F.array_join("authors", ",").alias("authors"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 50")
def newest_history(spark, d):
    return records.history(table(spark, d, "events").filter("event_type = 'purchase'").select("event_id", "user_id"), "event_id", 50)


@query(f"WITH i AS ({ITEMS_SQL}) SELECT DISTINCT series FROM i WHERE authors = (SELECT authors FROM i WHERE item = 3)")
def series_by_authors(spark, d):
    i = items(spark, d).withColumn("authors", F.col("authors").cast("array<string>"))
    chosen = i.filter("item = 3").first()["authors"]
    return records.series_of_authors(i, "series", "authors", chosen[::-1])


@query(
    """WITH m AS (SELECT conv_id, turn FROM conversations WHERE turn < 3), b AS (SELECT conv_id, turn FROM conversations WHERE turn >= 3 AND conv_id % 3 > 0), s AS (SELECT conv_id, max(turn) AS last FROM m GROUP BY 1)
    SELECT s.conv_id, greatest(s.last, max(b.turn)) AS last_message_at, (SELECT count(*) FROM m WHERE m.conv_id = s.conv_id) + count(b.turn) AS messages FROM s LEFT JOIN b ON b.conv_id = s.conv_id GROUP BY s.conv_id, s.last"""
)
def appended_messages(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    old = c.filter("turn < 3")
    sessions = old.groupBy("conv_id").agg(F.max("turn").alias("last_message_at"))
    touched, messages = records.appended(sessions, old, c.filter("turn >= 3 and conv_id % 3 > 0"), "conv_id", "turn")
    return touched.join(messages.groupBy("conv_id").agg(F.count("*").alias("messages")), "conv_id")


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def wall_clocks(spark, d):
    return table(spark, d, "events").select("event_id", records.wall_clock(F.col("ts")).alias("shown"))


@query(
    """WITH c AS (SELECT role, turn, text, CASE WHEN turn % 2 = 0 THEN replace(text, 'tion', 'tian') ELSE text END AS h FROM conversations WHERE text <> ''), d AS (SELECT role, length(text) AS n, levenshtein(text, h) AS d FROM c)
    SELECT role, count(*) AS pages, CAST(sum(d) AS BIGINT) AS distance, CAST(sum(n) AS BIGINT) AS chars, count(*) FILTER (d = 0) AS exact, round(max(d / n), 6) AS worst, round(sum(d) / sum(n), 6) AS rate FROM d GROUP BY 1"""
)
def error_report(spark, d):
    c = table(spark, d, "conversations").filter("text <> ''").withColumn("h", F.when(F.col("turn") % 2 == 0, F.replace("text", F.lit("tion"), F.lit("tian"))).otherwise(F.col("text")))
    got = records.grouped_error_report(c, "role", "text", "h", "conv_id")
    return got.withColumns({"worst": F.round("worst", 6), "rate": F.round("rate", 6)})
