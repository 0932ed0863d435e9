"""Queries of replies, made of conversations: relations, fact sheets, judgements of claims, checks of discussions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import replies
from quire.plans.registry import query
from quire.session import table
from quire.sources.shared import stored


def _replies(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book"), "l_linenumber", "l_partkey", F.struct(F.concat(F.lit(" s"), "l_suppkey").alias("char_a"), F.concat(F.lit("s"), F.col("l_partkey") % 10 + 1).alias("char_b"), F.concat(F.lit("kind "), "l_returnflag").alias("relation")).alias("x"))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "x"))), lambda r: r["x"])
    return rows.groupBy("book").agg(F.concat(F.lit("Here:\n```json\n"), F.to_json(lists), F.lit("\n```\ndone")).alias("reply"))


@query("SELECT l_orderkey AS book, 's' || l_suppkey AS a, 's' || l_partkey % 10 + 1 AS b, 'kind ' || l_returnflag AS relation FROM lineitem WHERE l_suppkey <> l_partkey % 10 + 1")
def relation_pairs(spark, d):
    return replies.relation_pairs(_replies(spark, d), "book", "reply").drop("place")


@query(
    """WITH l AS (SELECT l_orderkey AS book, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, 's' || l_suppkey, l_returnflag) AS place, 's' || l_suppkey AS x, 's' || l_partkey % 10 + 1 AS y, 'kind ' || l_returnflag AS relation FROM lineitem),
    n AS (SELECT book, least(x, y) AS a, greatest(x, y) AS b, arg_max(relation, place) AS relation FROM l WHERE x <> y GROUP BY ALL), c AS (SELECT book, a, b, count(*) AS n FROM (SELECT book, least(x, y) AS a, greatest(x, y) AS b, relation FROM l WHERE x <> y) WHERE relation <> 'kind R' GROUP BY ALL)
    SELECT book, a, b, relation, CAST(coalesce(n, 0) AS DOUBLE) AS weight FROM n LEFT JOIN c USING (book, a, b) UNION ALL SELECT -1 - o_orderkey, 'old', 'pair', NULL, 1.0 FROM orders WHERE o_orderstatus = 'P'"""
)
def rewritten_relations(spark, d):
    labels = stored(replies.relation_pairs(_replies(spark, d), "book", "reply"), "relations")  # replies are parsed once for all that reads them
    counts = labels.filter("relation <> 'kind R'").groupBy("book", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    old = table(spark, d, "orders").filter("o_orderstatus = 'P'").select((-1 - F.col("o_orderkey")).alias("book"), F.lit("old").alias("a"), F.lit("pair").alias("b"), F.lit(None).cast("string").alias("relation"), F.lit(1.0).alias("weight"))
    again = labels.select("book").distinct().select("book", F.lit("gone").alias("a"), F.lit("too").alias("b"), F.lit("x").alias("relation"), F.lit(5.0).alias("weight"))
    return replies.rewritten_relations(old.unionByName(again), counts, labels, "book")


def _sheets(spark, d):
    c = table(spark, d, "conversations").filter("length(trim(text)) > 0 and text not like '%[%'")
    nothing = F.when(F.col("turn") % 4 == 3, "該当事実なし。").otherwise(F.concat(F.lit("- "), F.trim("role"), F.lit(" acts")))
    text = F.concat(F.lit("[BOOK_FACTS]\n- turn "), "turn", F.lit("\n[CHARACTER_FACT: "), "role", F.lit(" ]\n"), nothing, F.lit("\n\n[CHARACTER_FACT:All]\n- here\n"))
    return c.select("conv_id", "turn", text.alias("sheet"))


@query(
    """WITH c AS (SELECT * FROM conversations WHERE length(trim(text)) > 0 AND text NOT LIKE '%[%')
    SELECT conv_id, role AS name, string_agg('- ' || role || ' acts', chr(10) ORDER BY turn) AS facts FROM c WHERE turn % 4 <> 3 GROUP BY 1, 2 UNION ALL SELECT conv_id, 'All', string_agg('- here', chr(10) ORDER BY turn) FROM c GROUP BY 1
    UNION ALL SELECT conv_id, NULL, string_agg('- turn ' || turn, chr(10) || chr(10) ORDER BY turn) FROM c GROUP BY 1"""
)
def merged_fact_sheets(spark, d):
    books, characters = replies.merged_sheets(*replies.fact_sheets(_sheets(spark, d), ["conv_id", "turn"], "sheet"), "conv_id", "turn")
    return characters.unionByName(books.withColumn("name", F.lit(None).cast("string")))


@query(
    """WITH c AS (SELECT conv_id, max(turn) AS last, count(*) AS n, conv_id % 7 AS kind FROM conversations GROUP BY 1)
    SELECT conv_id, CASE kind WHEN 1 THEN 'verdict' WHEN 2 THEN 'page outside' WHEN 3 THEN 'omitted' WHEN 4 THEN 'claim id' WHEN 5 THEN 'pass with missing facts' ELSE 'fine' END AS problem FROM c"""
)
def claim_judgements(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("kind", F.col("conv_id") % 7)
    is_ = lambda k: F.col("kind") == k
    ids = F.sequence(F.lit(1).cast("bigint"), F.col("n"))
    item = lambda i: F.struct(F.when(is_(4) & (i == F.col("n")), F.col("n") + 1).when(is_(3) & (i == F.col("n")), F.lit(None)).otherwise(i).alias("id"), F.when(is_(1) & (i == 1), "perhaps").otherwise("supported").alias("verdict"), F.array(F.when(is_(2) & (i == 1), 99).otherwise(1)).alias("evidence_pages"), F.lit("seen").alias("reason"))
    claims = F.filter(F.transform(ids, item), lambda x: x["id"].isNotNull())
    missing = F.when(is_(5), F.array(F.lit("one"))).otherwise(F.array().cast("array<string>"))
    reply = F.to_json(F.struct(claims.alias("claims"), F.struct(F.lit("pass").alias("verdict"), missing.alias("missing_facts")).alias("coverage")))
    rows = c.select("conv_id", "n", reply.alias("reply"), F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")).alias("pages"))
    judged, problems = replies.claim_judgements(rows, "conv_id", "reply", "n", "pages")
    worst = problems.groupBy("conv_id").agg(F.min("problem").alias("problem"))
    fine = judged.filter("passed").select("conv_id", F.lit("fine").alias("problem")).distinct()
    return worst.unionByName(fine)


@query(
    """WITH g AS (SELECT conv_id, sum(length(text)) AS chars, count(DISTINCT role) AS speakers, max(length(text)) AS longest, count(*) FILTER (regexp_matches(text, '@')) AS leaks, bool_or(turn = 2) AS third FROM conversations GROUP BY 1)
    SELECT conv_id, unnest(['length', 'segments', 'speakers', 'leaks']) AS check, unnest([coalesce(chars BETWEEN 500 AND 4500, false), third, coalesce(speakers >= 2 AND longest <= 2000, false), leaks = 0]) AS passed FROM g"""
)
def discussion_checks(spark, d):
    c = table(spark, d, "conversations").withColumn("segment", F.concat(F.lit("t"), "turn"))
    return replies.discussion_checks(c, "conv_id", "turn", "role", "text", "segment", ["t2"], 500, 4500, 2000, "@")
