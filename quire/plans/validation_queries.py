"""Queries of strict validation: answers and fact graphs made of conversations, most of them wrong in one way."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import validation
from quire.plans.registry import query
from quire.session import table

ROLES = ("user", "assistant", "system")
#: An answer to each turn, whose kind its place decides; the source's id is the conversation's and the turn's number in one.
FLAT = "regexp_replace({}, '[ \\t\\n\\r]+', '', 'g')"


@query(
    f"""WITH c AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, (conv_id + turn) % 9 AS kind, text, {FLAT.format('text')} AS t, {FLAT.format('substr(text, 1, 40)')} AS q FROM conversations),
    p AS (SELECT conv_id, turn, CASE kind WHEN 1 THEN 'no strict object' WHEN 2 THEN 'status or evidence' WHEN 3 THEN 'evidence of not_found' WHEN 4 THEN 'answer keys' WHEN 5 THEN 'source' WHEN 6 THEN 'quote is not in its source' WHEN 7 THEN 'no strict object'
        ELSE CASE WHEN q = '' THEN 'empty quote' WHEN strpos(substr(t, 2), q) > 0 THEN 'quote is there more than once' WHEN kind = 8 THEN 'duplicate quote' ELSE 'valid' END END AS problem FROM c WHERE text IS NOT NULL AND text <> '')
    SELECT conv_id, turn, problem FROM p"""
)
def quote_validation(spark, d):
    c = table(spark, d, "conversations").filter("text is not null and text <> ''").select("conv_id", "turn", F.expr("conv_id * 1000 + turn").alias("id"), F.expr("(conv_id + turn) % 9").alias("kind"), "text")
    quote = F.substring("text", 1, 40)
    item = lambda source, q: F.struct(source.alias("source_id"), q.alias("quote"))
    answer = lambda status, *items: F.to_json(F.struct(F.lit(status).alias("status"), F.array(*items).alias("evidence")))
    good = answer("found", item(F.col("id"), quote))
    raw = (
        F.when(F.col("kind") == 1, F.concat(F.lit('{"status":"found",'), F.substr(good, F.lit(2))))
        .when(F.col("kind") == 2, answer("maybe", item(F.col("id"), quote)))
        .when(F.col("kind") == 3, answer("not_found", item(F.col("id"), quote)))
        .when(F.col("kind") == 4, F.concat(F.lit('{"more":1,'), F.substr(good, F.lit(2))))
        .when(F.col("kind") == 5, answer("found", item(-F.col("id") - 1, quote)))
        .when(F.col("kind") == 6, answer("found", item(F.col("id"), F.concat(F.lit("☃"), quote))))
        .when(F.col("kind") == 7, F.lit('{"status":"found","evidence":NaN}'))
        .when(F.col("kind") == 8, answer("found", item(F.col("id"), quote), item(F.col("id"), F.concat(quote, F.lit(" ")))))
        .otherwise(F.concat(F.lit("```json\n"), good, F.lit("\n```")))
    )
    key = F.struct("conv_id", "turn").alias("key")
    problems, spans = validation.quote_answers(c.select(key, raw.alias("raw")), c, "key", "raw", "id", "text")
    found = problems.groupBy("key").agg(F.min("problem").alias("problem"))
    return c.select(key).join(found, "key", "left").select("key.*", F.coalesce("problem", F.lit("valid")).alias("problem"))


@query(
    f"""WITH c AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, text, {FLAT.format('text')} AS t, {FLAT.format('substr(text, 1, 40)')} AS q FROM conversations WHERE (conv_id + turn) % 9 = 0 AND text IS NOT NULL AND text <> '')
    SELECT id, q AS found FROM c WHERE q <> '' AND strpos(substr(t, 2), q) = 0"""
)
def quote_spans(spark, d):
    """The spans of the valid quotes, cut from their sources."""
    c = table(spark, d, "conversations").filter("(conv_id + turn) % 9 = 0 and text is not null and text <> ''").select(F.expr("conv_id * 1000 + turn").alias("id"), "text")
    raw = F.to_json(F.struct(F.lit("found").alias("status"), F.array(F.struct(F.col("id").alias("source_id"), F.substring("text", 1, 40).alias("quote"))).alias("evidence")))
    _, spans = validation.quote_answers(c.select(F.col("id").alias("answer"), raw.alias("raw")), c, "answer", "raw", "id", "text")
    j = spans.join(c, "id").select("id", F.expr("substr(text, start + 1, stop - start)").alias("found"))
    return j.select("id", F.regexp_replace("found", validation.SPACES, "").alias("found"))


@query(
    """WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS fact FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL),
    k AS (SELECT *, (conv_id + turn) % 8 AS kind FROM c),
    p AS (SELECT conv_id, fact, unnest(list_filter([CASE WHEN kind = 1 THEN 'temporality' END, CASE WHEN kind = 2 THEN 'actors' END, CASE WHEN kind = 3 THEN 'page' END, CASE WHEN kind = 4 AND length(text) >= 20 THEN 'quote is not in its page' END, CASE WHEN kind = 5 THEN 'unknown link' END,
        CASE WHEN kind = 6 THEN 'link to itself' END, CASE WHEN kind = 7 THEN 'fact id' END, CASE WHEN length(text) < 20 AND kind <> 3 THEN 'quote length' END], lambda x: x IS NOT NULL)) AS problem FROM k)
    SELECT conv_id, CAST(fact AS INTEGER) AS fact, problem FROM p"""
)
def fact_graph_validation(spark, d):
    c = table(spark, d, "conversations").filter("role is not null and text is not null")
    kind = F.expr("(conv_id + turn) % 8")
    is_ = lambda k: kind == k
    quote = F.when(F.length("text") < 20, F.col("text")).otherwise(F.when(is_(4), F.concat(F.lit("☃"), F.substring("text", 1, 19))).otherwise(F.substring("text", 1, 20)))
    id_ = F.concat(F.lit("F"), F.col("turn"))
    fact = F.struct(
        F.when(is_(7), "").otherwise(id_).alias("fact_id"),
        F.lit("someone").alias("subject"),
        F.lit("speaks").alias("action"),
        F.when(is_(1), "soon").otherwise("past").alias("temporality"),
        F.lit("fact").alias("certainty"),
        F.array(F.struct(F.when(is_(2), " ").otherwise(F.col("role")).alias("name"), F.col("role").alias("role"))).alias("actors"),
        F.array(F.struct((F.when(is_(3), -1).otherwise(F.col("turn"))).alias("page_no"), quote.alias("quote"))).alias("evidence"),
        F.when(is_(5), F.array(F.lit("F-9"))).when(is_(6), F.array(id_)).otherwise(F.array().cast("array<string>")).alias("related_fact_ids"),
    )
    facts = F.transform(F.array_sort(F.collect_list(F.struct("turn", fact.alias("fact")))), lambda x: x["fact"])
    graphs = c.groupBy("conv_id").agg(F.to_json(F.struct(F.lit(validation.FACT_SCHEMA).alias("schema_version"), facts.alias("facts"))).alias("raw"))
    return validation.fact_graphs(graphs, c, "conv_id", "raw", "turn", "text", ROLES)
