"""Queries of catalog imports and listings, over orders, lines, parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import catalog, filters
from quire.plans.adapters import ITEMS_SQL, items
from quire.plans.registry import query
from quire.session import table

WITH_ITEMS = f"WITH items AS ({ITEMS_SQL})"


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag <> 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_quantity) = 1")
def order_lookup(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", F.lit("a title").alias("title"))
    return catalog.order_lookup(lines, ["l_orderkey", "l_partkey"], ["l_linenumber", "l_quantity"], "title", "l_returnflag", ("R",)).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


FRESH = "SELECT l_partkey, l_shipdate, min(l_orderkey) AS l_orderkey FROM lineitem WHERE {w} AND NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_linenumber = 1 AND s.l_partkey = lineitem.l_partkey AND s.l_shipdate = lineitem.l_shipdate) GROUP BY 1, 2"


def _fresh(spark, d, wanted=None):
    lines = table(spark, d, "lineitem")
    stored = lines.filter("l_linenumber = 1").select("l_partkey", "l_shipdate").distinct()
    return catalog.fresh_rows(lines.select("l_partkey", "l_shipdate", "l_orderkey", "l_linestatus"), stored, ["l_partkey", "l_shipdate"], ["l_orderkey"], wanted).select("l_partkey", "l_shipdate", "l_orderkey")


@query(FRESH.format(w="true"))
def import_by_time(spark, d):
    return _fresh(spark, d)


@query(FRESH.format(w="l_linestatus = 'O'"))
def import_successes(spark, d):
    return _fresh(spark, d, F.col("l_linestatus") == "O")


@query("SELECT user_id, CAST(coalesce(sum(CASE WHEN event_id % 3 > 0 THEN CAST(floor(value * 100) AS BIGINT) END), 0) AS BIGINT) AS total, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY 1")
def reading_sums(spark, d):
    e = table(spark, d, "events")
    rows = e.select("user_id", F.when(F.col("event_id") % 3 > 0, F.floor(F.col("value") * 100).cast("string")).otherwise("n/a").alias("v"))
    bought = e.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("bought"))
    return catalog.sums(rows, "user_id", "v", "total").join(bought, "user_id")


@query("SELECT o_custkey, greatest(min(o_orderdate), max(CASE WHEN o_orderstatus = 'P' THEN o_orderdate END)) AS at FROM orders GROUP BY 1")
def newest_times(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderdate", "at")
    return catalog.newest(o.groupBy("o_custkey").agg(F.min("at").alias("at")), o.filter("o_orderstatus = 'P'"), "o_custkey", "at").select("o_custkey", "at")


GENRE = "CASE p_partkey % 6 WHEN 0 THEN 'ライトノベル' WHEN 1 THEN 'コミック' WHEN 2 THEN 'ミステリー' WHEN 3 THEN '料理' ELSE 'x' END"


@query(
    f"""WITH g AS (SELECT p_partkey, {GENRE} AS genre, p_name || CASE WHEN p_partkey % 6 = 4 THEN ' Vol. 3' ELSE '' END AS title FROM part)
    SELECT p_partkey, CASE WHEN genre = 'ライトノベル' THEN 'novel' WHEN genre = 'コミック' THEN 'comic' WHEN genre = 'ミステリー' THEN 'novel' WHEN genre = '料理' THEN 'other' WHEN regexp_matches(title, '(?i)vol\\.\\s*\\d+') THEN 'comic' END AS type FROM g"""
)
def book_types(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr(GENRE).alias("genre"), F.concat("p_name", F.when(F.col("p_partkey") % 6 == 4, " Vol. 3").otherwise("")).alias("title"))
    return p.select("p_partkey", catalog.book_type(F.array("genre"), F.col("title"), ("ミステリー", "文学"), ("料理", "旅行")).alias("type"))


@query(
    """WITH b AS (SELECT l_partkey AS k, arg_min(CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END, (l_orderkey, l_linenumber)) AS author, 'b' || min(l_orderkey) AS title FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1),
    c AS (SELECT l_partkey AS k, arg_min(l_linestatus, (l_orderkey, l_linenumber)) AS author, 'c' || min(l_orderkey) AS title FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1)
    SELECT coalesce(b.k, c.k) AS k, CASE WHEN b.k IS NOT NULL THEN coalesce(nullif(b.author, ''), c.author) ELSE c.author END AS author, coalesce(b.title, c.title) AS title FROM b FULL JOIN c ON b.k = c.k"""
)
def two_source_union(spark, d):
    lines = table(spark, d, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    side = lambda n, author, tag: lines.filter(F.col("l_suppkey") % n == 0).select(F.col("l_partkey").alias("k"), "at", author.alias("author"), F.concat(F.lit(tag), "l_orderkey").alias("title"))
    base = side(2, F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")), "b")
    return catalog.filled_union(base, side(3, F.col("l_linestatus"), "c"), "k", "at", "author").select("k", "author", "title")


def _library(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.col("c_name").alias("name"), F.array(F.lower("c_mktsegment"), F.lit("a")).alias("authors"), F.concat(F.lit("s"), F.col("c_nationkey") % 3).alias("series"), filters.read_state(F.when(F.col("c_custkey") % 5 == 0, "done"), F.when(F.col("c_acctbal") > 0, 1)).alias("state"), F.col("c_mktsegment").alias("genre"), (F.col("c_acctbal") < 500).alias("hidden"))


@query("SELECT c_custkey FROM customer WHERE NOT c_acctbal < 500 AND (contains(lower(c_name), '9') OR contains(lower(c_mktsegment), '9')) AND c_nationkey % 3 = 1 AND CASE WHEN c_custkey % 5 = 0 THEN 'done' WHEN c_acctbal > 0 THEN 'reading' ELSE 'unread' END = 'reading'")
def library_filters(spark, d):
    return catalog.library(_library(spark, d), text="9", author="a", series="s1", state="reading").select("c_custkey")


@query("SELECT c_custkey, c_mktsegment AS genre FROM customer WHERE c_acctbal < 500 AND c_mktsegment = 'HOUSEHOLD'")
def library_trash(spark, d):
    return catalog.library(_library(spark, d), trash=True, genre="HOUSEHOLD").select("c_custkey", "genre")


ORDERS = {"favourite": "c_nationkey % 2 = 0 DESC, c_custkey", "name": "c_custkey", "name_desc": "c_custkey DESC", "added": "coalesce(CASE WHEN c_nationkey > 3 THEN c_nationkey END, 0), c_custkey", "added_desc": "coalesce(CASE WHEN c_nationkey > 3 THEN c_nationkey END, 0) DESC, c_custkey", "views": "coalesce(CASE WHEN c_nationkey > 3 THEN c_nationkey END, 0) DESC, c_custkey", "viewed": "CASE WHEN c_nationkey > 3 THEN c_nationkey END DESC NULLS LAST, c_custkey"}


@query(" UNION ALL ".join(f"(SELECT '{k}' AS sort, c_custkey FROM customer ORDER BY {o} LIMIT 20)" for k, o in ORDERS.items()))
def library_orders(spark, d):
    c = table(spark, d, "customer")
    n = F.when(F.col("c_nationkey") > 3, F.col("c_nationkey"))
    out = None
    for by in ORDERS:
        top = c.orderBy(*catalog.library_order(by, F.col("c_nationkey") % 2 == 0, F.col("c_name"), n, n, n)).limit(20).select(F.lit(by).alias("sort"), "c_custkey")
        out = top if out is None else out.unionByName(top)
    return out


@query(f"{WITH_ITEMS} SELECT series, item, row_number() OVER (PARTITION BY series ORDER BY CASE WHEN item % 3 > 0 THEN volume END NULLS LAST, title, item) AS place FROM items")
def series_places(spark, d):
    i = items(spark, d).select("series", "item", "title", "volume").withColumn("name", F.struct("title", "item"))
    return catalog.grouped(i, F.col("series"), [F.when(F.col("item") % 3 > 0, F.col("volume"))], "name").select("series", "item", F.col("place").cast("long").alias("place"))


@query(f"{WITH_ITEMS}, w AS (SELECT series, item, CAST(row_number() OVER (PARTITION BY series ORDER BY -item) AS DOUBLE) AS i FROM items WHERE item % 2 = 0) SELECT items.series, items.item, coalesce(w.i, volume) AS position FROM items LEFT JOIN w ON w.item = items.item")
def series_renumbered(spark, d):
    i = items(spark, d).select("series", "item", F.col("volume").cast("double").alias("position"))
    wanted = i.filter("item % 2 = 0").select("series", "item", (-F.col("item")).alias("ordinal"))
    return catalog.renumbered(i, wanted, "series", "item", "position")


@query(
    """WITH p AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer)
    SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 7 = 0 THEN 3 - 0.5 ELSE place END, CASE WHEN c_custkey % 7 = 0 THEN place ELSE 0 END) AS place FROM p"""
)
def group_moves(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("place"))
    return catalog.moved(c, "c_nationkey", "place", F.col("c_custkey") % 7 == 0, F.lit(3)).select("c_custkey", F.col("new_place").cast("long").alias("place"))


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS unread_count, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS read_count FROM orders WHERE o_orderstatus <> 'F'")
def inbox_counters(spark, d):
    return catalog.inbox(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "F", "unread").drop("o_orderstatus")


@query(
    """WITH s AS (SELECT p_brand AS selection, p_name AS t, p_type AS k FROM part WHERE p_partkey % 20 = 0), n AS (SELECT selection, count(*) AS n FROM s GROUP BY 1), g AS (SELECT p_partkey AS series, p_name AS s, p_type AS j FROM part WHERE p_partkey % 7 = 3),
    m AS (SELECT selection, series, coalesce(list_sum([CASE WHEN left(t, i) = left(s, i) THEN 1 ELSE 0 END FOR i IN range(1, least(length(t), length(s)) + 1)]), 0) / greatest(length(t), length(s)) AS share, k = j AS same FROM s JOIN g ON left(t, 1) = left(s, 1)),
    c AS (SELECT selection, series, round(least(1.0, sum(share) / any_value(n) + CASE WHEN bool_and(same) AND count(*) = any_value(n) THEN 0.2 ELSE 0.0 END), 4) AS score FROM m JOIN n USING (selection) GROUP BY 1, 2)
    SELECT selection, series, score, row_number() OVER (PARTITION BY selection ORDER BY score DESC, series) AS rank FROM c WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY selection ORDER BY score DESC, series) <= 5"""
)
def series_suggestions(spark, d):
    p = table(spark, d, "part")
    selected = p.filter("p_partkey % 20 = 0").select(F.col("p_brand").alias("selection"), F.col("p_name").alias("title"), F.col("p_type").alias("author_key"))
    known = p.filter("p_partkey % 7 = 3").select(F.col("p_partkey").alias("series"), F.col("p_name").alias("title"), F.col("p_type").alias("author_key"))
    return catalog.series_suggestions(selected, known).withColumn("rank", F.col("rank").cast("long"))


@query(f"{WITH_ITEMS}, a AS (SELECT item, unnest(authors) AS author FROM items) SELECT author, count(*) AS books, min(item) AS first FROM a GROUP BY 1 ORDER BY books DESC, first, author LIMIT 40")
def author_stats(spark, d):
    a = items(spark, d).select("item", F.explode("authors").alias("author"))
    return a.groupBy("author").agg(F.count("*").alias("books"), F.min("item").alias("first")).orderBy(F.desc("books"), "first", "author").limit(40)


@query("SELECT lower(name) AS name FROM (SELECT DISTINCT unnest([p_brand, p_type, upper(p_brand)]) AS name FROM part) GROUP BY 1")
def distinct_names(spark, d):
    return table(spark, d, "part").select(F.explode(F.array("p_brand", "p_type", F.upper("p_brand"))).alias("name")).select(F.lower("name").alias("name")).distinct()


@query("SELECT n_name, coalesce(n, 0) AS n, n IS NULL AS needed FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) ON c_nationkey = n_nationkey")
def listing_left_join(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "nation").join(c, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("needed"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unlinked_items(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
def needed_by_a_child(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (o_orderkey, 1 + o_custkey % 4) FROM orders WHERE o_orderstatus = 'P')")
def composite_key_lookup(spark, d):
    keys = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 4 + 1).cast("int").alias("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(keys, ["l_orderkey", "l_linenumber"], "left_semi")


@query("SELECT conv_id, coalesce(max(turn), min(conv_id)) AS latest FROM conversations GROUP BY 1 ORDER BY latest DESC, conv_id DESC LIMIT 15")
def recent_sessions(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("t"))
    return c.select("conv_id", F.coalesce("t", "conv_id").alias("latest")).orderBy(F.desc("latest"), F.desc("conv_id")).limit(15)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def recent_finished(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5)


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'pending' WHEN s_nationkey = 1 THEN 'captured' WHEN s_nationkey > 1 THEN 'ambiguous' ELSE 'none' END AS state, nullif(trim(CASE WHEN s_nationkey % 2 = 0 THEN ' Not Available' ELSE s_name END), CASE WHEN s_nationkey % 2 = 0 THEN 'Not Available' ELSE '' END) AS value FROM supplier WHERE s_nationkey <> 7 OR s_nationkey IS NULL")
def capture_states(spark, d):
    s = table(spark, d, "supplier").filter(~F.col("s_nationkey").eqNullSafe(F.lit(7)))
    value = F.when(F.col("s_nationkey") % 2 == 0, " Not Available").otherwise(F.col("s_name"))
    return s.select("s_suppkey", filters.capture_state(F.col("s_nationkey"), F.col("s_acctbal") < 0).alias("state"), text.cleaned(value).alias("value"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN NULL ELSE 'set' END AS segment FROM customer")
def field_patch(spark, d):
    patch = F.when(F.col("c_custkey") % 3 == 1, "").when(F.col("c_custkey") % 3 == 2, "set")
    return table(spark, d, "customer").select("c_custkey", filters.patched(F.col("c_mktsegment"), patch, patch.isNotNull(), patch == "").alias("segment"))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10' AND event_id % 4 <> 0")
def time_range(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.when(F.col("event_id") % 4 != 0, F.col("ts")))
    lit = lambda x: F.lit(x).cast(e.schema["ts"].dataType)
    return e.filter(filters.in_time_range(F.col("ts"), lit("2024-01-03 00:00:00"), lit("2024-01-10 00:00:00"))).select("event_id", "event_type")
