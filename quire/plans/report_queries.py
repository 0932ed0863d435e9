"""Queries of reports, guards and comparisons, over events as logs, lines as measurements and documents as pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import reports
from quire.plans.registry import query
from quire.session import table
from quire.sources import readers

LOG_SQL = """SELECT event_id, CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' INFO lexical shadow: query_hash=' || substr(md5(CAST(user_id AS VARCHAR)), 1, 12) || ' fts_count=' || user_id % 4 || ' icu_count=' || event_id % 3 || ' overlap=' || least(user_id % 4, event_id % 3) || ' fts_ms=1.5 icu_ms=2'
    WHEN 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' lexical shadow unavailable: query_hash=' || substr(md5(CAST(user_id AS VARCHAR)), 1, 12) || ' fts_count=1 fts_ms=1.5 icu_ms=2 error_type=Closed' WHEN 'error' THEN 'lexical ICU fallback: query_hash=' || substr(md5(CAST(user_id AS VARCHAR)), 1, 12) || ' error_type=Closed'
    WHEN 'signup' THEN 'lexical shadow: query_hash=' || user_id ELSE 'other' END AS line, ts, user_id, event_type FROM events"""


def _log(spark, d):
    at, h = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.substring(F.md5(F.col("user_id").cast("string")), 1, 12)
    a, b = F.col("user_id") % 4, F.col("event_id") % 3
    kinds = {
        "view": F.concat(at, F.lit(" INFO lexical shadow: query_hash="), h, F.lit(" fts_count="), a, F.lit(" icu_count="), b, F.lit(" overlap="), F.least(a, b), F.lit(" fts_ms=1.5 icu_ms=2")),
        "click": F.concat(at, F.lit(" lexical shadow unavailable: query_hash="), h, F.lit(" fts_count=1 fts_ms=1.5 icu_ms=2 error_type=Closed")),
        "error": F.concat(F.lit("lexical ICU fallback: query_hash="), h, F.lit(" error_type=Closed")),
        "signup": F.concat(F.lit("lexical shadow: query_hash="), "user_id"),
    }
    line = F.lit("other")
    for kind, x in kinds.items():
        line = F.when(F.col("event_type") == kind, x).otherwise(line)
    return readers.search_log(table(spark, d, "events").select(line.alias("value")))


@query(f"WITH l AS ({LOG_SQL}) SELECT CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'unavailable' WHEN 'error' THEN 'fallback' WHEN 'signup' THEN 'malformed' ELSE 'ignore' END AS kind, count(*) AS n, count(DISTINCT CASE WHEN event_type IN ('view', 'click') THEN date_trunc('second', ts) END) AS times FROM l GROUP BY 1")
def log_lines(spark, d):
    return _log(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("ts").alias("times"))


@query(
    """WITH l AS (SELECT *, user_id % 4 AS f, event_id % 3 AS i, least(user_id % 4, event_id % 3) AS o FROM events), j AS (SELECT *, CASE WHEN event_type = 'view' THEN CASE WHEN f + i - o = 0 THEN 1.0 ELSE o / (f + i - o) END END AS j FROM l)
    SELECT count(*) FILTER (event_type = 'view') AS successes, round(count(*) FILTER (event_type = 'view') / count(*) FILTER (event_type IN ('view', 'click', 'error')), 6) AS success_rate, round(count(*) FILTER (event_type = 'error') / count(*) FILTER (event_type IN ('view', 'click', 'error')), 6) AS fallback_rate,
        count(*) FILTER (event_type = 'signup') AS malformed, count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS queries, count(*) FILTER (event_type = 'view' AND f = 0) AS fts_zero, count(*) FILTER (event_type = 'view' AND i = 0) AS icu_zero, round(avg(j), 6) AS mean_jaccard, round(min(j), 6) AS min_jaccard,
        count(DISTINCT CASE WHEN event_type = 'view' THEN CAST(ts AS DATE) END) AS days FROM j"""
)
def log_summary(spark, d):
    return reports.log_summary(_log(spark, d))


@query("SELECT n_name, count(c_custkey) AS rows, coalesce(CAST(sum(levenshtein(c_mktsegment, n_name)) AS BIGINT), 0) AS distance FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < 0 GROUP BY 1")
def corpus_metrics(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal < 0").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return reports.by_all_groups(c, table(spark, d, "nation"), "n_name", {"rows": F.count("*"), "distance": F.sum(F.levenshtein("c_mktsegment", "n_name"))})


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity > l_extendedprice * 0.002 AND l_returnflag <> 'R'")
def omission_suspects(spark, d):
    return reports.omission_suspects(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", F.col("l_returnflag") == "R", 10, 0.002).select("l_orderkey", "l_linenumber")


@query(
    """WITH x AS (SELECT l_orderkey, l_quantity AS x FROM lineitem), g AS (SELECT l_orderkey, lag(x) OVER w - x AS gap, row_number() OVER w - 1 AS k FROM x WINDOW w AS (PARTITION BY l_orderkey ORDER BY x DESC))
    SELECT l_orderkey, count(*) AS gaps, median(gap) AS median_gap, round(max(gap) FILTER (k > 1) / median(gap), 6) AS worst_ratio FROM g WHERE gap > 0 GROUP BY 1"""
)
def column_gaps(spark, d):
    lines = table(spark, d, "lineitem")
    return reports.column_gaps(lines, "l_orderkey", "l_quantity").select("l_orderkey", "gaps", "median_gap", "worst_ratio")


@query("SELECT l_returnflag, round(median(l_discount * 10), 6) AS median, round(sum(l_discount * 10 * l_linenumber) / sum(l_linenumber), 6) AS mean, round(sum(CASE WHEN l_discount * 10 < 0.5 THEN l_linenumber ELSE 0 END) / sum(l_linenumber), 6) AS low_share FROM lineitem GROUP BY 1")
def confidence_summary(spark, d):
    return reports.confidence(table(spark, d, "lineitem").withColumn("c", F.col("l_discount") * 10), "l_returnflag", "c", "l_linenumber")


@query(
    """WITH c AS (SELECT l_orderkey % 50 AS item, l_partkey % 20 AS place, repeat(l_returnflag, CAST(1 + l_linenumber % 2 AS BIGINT)) AS text, count(DISTINCT l_suppkey % 5) AS support FROM lineitem GROUP BY 1, 2, 3)
    SELECT item, place, text, support FROM c WHERE support >= 2 QUALIFY row_number() OVER (PARTITION BY item, place ORDER BY support DESC, length(text) DESC, text DESC) = 1"""
)
def supported_gaps(spark, d):
    p = table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("item"), (F.col("l_partkey") % 20).alias("place"), F.repeat("l_returnflag", (F.col("l_linenumber") % 2 + 1).cast("int")).alias("text"), (F.col("l_suppkey") % 5).alias("engine"))
    return reports.supported_gaps(p, "item", "place", "text", "engine")


@query("SELECT CAST(min(len(embedding)) AS INTEGER) AS dimension, 'f32' AS mode FROM embeddings HAVING min(len(embedding)) = max(len(embedding))")
def uniform_vectors(spark, d):
    return reports.uniform(table(spark, d, "embeddings").select(F.size("embedding").alias("dimension"), F.lit("f32").alias("mode")), ["dimension", "mode"])


@query("SELECT CASE WHEN source IN ('src1', 'src2') THEN 'hold_out' ELSE 'train' END AS split, count(DISTINCT source) AS runs, count(*) AS pages, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL GROUP BY 1")
def split_inventory(spark, d):
    docs = table(spark, d, "documents").filter("source is not null and n_chars is not null")
    return reports.split_inventory(docs, spark.createDataFrame([("src1",), ("src2",)], "source string"), "source", "n_chars")


DIGESTS = "SELECT sha256(coalesce(text, '')) AS digest, {label} AS label, doc_id FROM documents"


@query(
    f"""WITH r AS ({DIGESTS.format(label="CASE WHEN doc_id % 9 = 0 THEN 'b' ELSE 'a' END")}) SELECT digest, min(doc_id) AS doc_id, any_value(label) AS label FROM r GROUP BY 1 HAVING count(DISTINCT label) = 1"""
)
def record_dedup(spark, d):
    r = table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.when(F.col("doc_id") % 9 == 0, "b").otherwise("a").alias("label"), "doc_id")
    disputed = r.groupBy("digest").agg(F.count_distinct("label").alias("n")).filter("n > 1")
    return reports.deduplicated(r, "digest", "label", ["doc_id"], disputed).select("digest", "doc_id", "label")


@query(
    """WITH r AS (SELECT conv_id, turn, sha256(octet_length(encode(role)) || ':' || role || octet_length(encode(text)) || ':' || text) AS r FROM conversations)
    SELECT conv_id, sha256(string_agg(r, '' ORDER BY turn, r)) AS digest FROM r GROUP BY 1"""
)
def ordered_digests(spark, d):
    return reports.ordered_digest(table(spark, d, "conversations"), "conv_id", "turn", ["role", "text"])


@query("SELECT sha256('{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}') AS digest, count(*) AS n FROM part GROUP BY p_brand, p_size")
def canonical_digests(spark, d):
    p = table(spark, d, "part").select(F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("j"))
    return p.groupBy(F.sha2("j", 256).alias("digest")).agg(F.count("*").alias("n"))


RUNS = "SELECT user_id AS case_id, CAST(CASE WHEN count(*) FILTER (event_type = '{t}') % 3 = 0 THEN 0.0 ELSE 0.5 + (count(*) FILTER (event_type = '{t}') % 2) * 0.25 END AS DOUBLE) AS recall, avg(event_id % 7) FILTER (event_type = '{t}') AS mrr, avg(event_id % 5) FILTER (event_type = '{t}') AS ndcg FROM events GROUP BY 1"


def _run(spark, d, kind):
    mine = F.col("event_type") == kind
    n = F.count_if(mine)
    return table(spark, d, "events").groupBy(F.col("user_id").alias("case_id")).agg(F.when(n % 3 == 0, 0.0).otherwise(0.5 + (n % 2) * 0.25).alias("recall"), F.avg(F.when(mine, F.col("event_id") % 7)).alias("mrr"), F.avg(F.when(mine, F.col("event_id") % 5)).alias("ndcg"))


@query(f"WITH a AS ({RUNS.format(t='view')}), b AS ({RUNS.format(t='click')}) SELECT case_id, round(b.recall - a.recall, 6) AS d_recall, round(b.mrr - a.mrr, 6) AS d_mrr, round(b.ndcg - a.ndcg, 6) AS d_ndcg, b.recall < a.recall AS regressed, a.recall = 0 AND b.recall > 0 AS rescued FROM a JOIN b USING (case_id)")
def report_comparison(spark, d):
    return reports.compared(_run(spark, d, "view"), _run(spark, d, "click"), "case_id", ["recall", "mrr", "ndcg"])


@query(
    f"""WITH a AS ({RUNS.format(t='view')}), b AS ({RUNS.format(t='click')}), j AS (SELECT count(*) FILTER (b.recall < a.recall) AS regressions, round((avg(b.mrr) - avg(a.mrr)) / avg(a.mrr), 6) AS mrr_gain, round((avg(b.ndcg) - avg(a.ndcg)) / avg(a.ndcg), 6) AS ndcg_gain FROM a JOIN b USING (case_id))
    SELECT *, regressions = 0 AND greatest(mrr_gain, ndcg_gain) >= 0.05 AS passed FROM j"""
)
def challenger_gate(spark, d):
    return reports.challenger_gate(_run(spark, d, "view"), _run(spark, d, "click"), "case_id")


@query("SELECT doc_id, lang AS engine_x, source AS engine_y FROM documents")
def paired_predictions(spark, d):
    docs = table(spark, d, "documents").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    return reports.paired(docs, docs, "doc_id", "digest", {"engine": ("lang", "source")})


@query("SELECT item_id, md5(text) AS digest, length(text) AS chars FROM benchmark")
def digest_guard(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.md5("text").alias("digest"))
    report = table(spark, d, "benchmark").select("item_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))
    return reports.guarded(report, b, "item_id", "digest").select("item_id", "digest", "chars")


@query(
    """WITH a AS (SELECT c_custkey AS name, c_name AS alias, false AS derived FROM customer UNION ALL SELECT DISTINCT c_custkey, 'omer#0000000' || (c_custkey % 10), true FROM customer WHERE c_acctbal < 0),
    p AS (SELECT c_custkey AS page, c_name || ' and ' || c_mktsegment AS text FROM customer WHERE c_mktsegment <> 'BUILDING'), h AS (SELECT DISTINCT name, alias, derived, page FROM a JOIN p ON contains(text, alias)),
    e AS (SELECT name, alias, derived FROM h GROUP BY ALL HAVING NOT derived OR count(*) >= 2) SELECT name, min(page) AS first_page, count(DISTINCT page) AS pages FROM h JOIN e USING (name, alias, derived) GROUP BY 1"""
)
def evidence_pages(spark, d):
    c = table(spark, d, "customer")
    a = c.select(F.col("c_custkey").alias("name"), F.col("c_name").alias("alias"), F.lit(False).alias("derived"))
    short = c.filter("c_acctbal < 0").select("c_custkey", F.concat(F.lit("omer#0000000"), F.col("c_custkey") % 10), F.lit(True)).distinct()
    p = c.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("page"), F.concat_ws(" and ", "c_name", "c_mktsegment").alias("text"))
    return reports.evidence(a.union(short), p, "name", "alias", "derived", "page", "text")


@query(
    """WITH f AS (SELECT conv_id, 'F' || lpad(CAST(turn AS VARCHAR), 3, '0') AS fact FROM conversations UNION ALL SELECT conv_id, 'F1' FROM conversations WHERE conv_id % 5 = 0), r AS (SELECT DISTINCT conv_id, 'F' || turn AS ref FROM conversations),
    u AS (SELECT conv_id, CAST(regexp_extract(fact, '(\\d+)$', 1) AS INTEGER) AS n, min(fact) AS fact FROM f GROUP BY 1, 2 HAVING count(DISTINCT fact) = 1)
    SELECT r.conv_id, ref, coalesce((SELECT max(fact) FROM f WHERE f.conv_id = r.conv_id AND fact = ref), u.fact) AS resolved FROM r LEFT JOIN u ON u.conv_id = r.conv_id AND u.n = CAST(regexp_extract(ref, '(\\d+)$', 1) AS INTEGER)"""
)
def fact_references(spark, d):
    c = table(spark, d, "conversations")
    facts = c.select("conv_id", F.concat(F.lit("F"), F.lpad(F.col("turn").cast("string"), 3, "0")).alias("fact")).unionByName(c.filter("conv_id % 5 = 0").select("conv_id", F.lit("F1").alias("fact")))
    references = c.select("conv_id", F.concat(F.lit("F"), "turn").alias("ref")).distinct()
    return reports.resolved_references(facts, references, "conv_id", "fact", "ref").select("conv_id", "ref", "resolved")


@query(
    """WITH a AS (SELECT conv_id, turn, role FROM conversations WHERE turn < 5), b AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'x' ELSE role END AS role FROM conversations WHERE turn > 0)
    SELECT conv_id, turn, CASE WHEN b.conv_id IS NULL THEN 'missing' WHEN a.conv_id IS NULL THEN 'stale' ELSE 'different' END AS problem FROM a FULL JOIN b USING (conv_id, turn) WHERE a.role IS DISTINCT FROM b.role"""
)
def build_verification(spark, d):
    c = table(spark, d, "conversations")
    b = c.filter("turn > 0").withColumn("role", F.when(F.col("conv_id") % 4 == 0, "x").otherwise(F.col("role")))
    return reports.verified(c.filter("turn < 5"), b, ["conv_id", "turn"], ["role"])


@query("WITH p AS (SELECT *, bit_count(xor(l_partkey, lag(l_partkey) OVER w)) AS distance, lag(l_suppkey) OVER w AS other FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) SELECT l_orderkey, l_linenumber, l_partkey, CAST(distance AS INTEGER) AS distance FROM p WHERE distance <= 3 AND l_suppkey <> other")
def adjacent_near_copies(spark, d):
    lines = table(spark, d, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return reports.near_neighbours_in_order(lines, "l_orderkey", "at", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "distance")


@query(
    """WITH b AS (SELECT conv_id, count(*) AS pages FROM conversations GROUP BY 1), p AS (SELECT DISTINCT conv_id, unnest([1, (pages + 1) // 2, pages]) AS page FROM b)
    SELECT conv_id, page, CAST((row_number() OVER (ORDER BY conv_id, page) - 1) % 3 AS INTEGER) AS worker FROM p"""
)
def first_middle_last(spark, d):
    b = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("pages"))
    return reports.first_middle_last(b, "conv_id", "page", "pages", 3)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.03 AND l_linenumber > 3 THEN 'low_similarity,proposals' WHEN l_discount < 0.03 THEN 'low_similarity' ELSE 'proposals' END AS reasons FROM lineitem WHERE l_discount < 0.03 OR l_linenumber > 3")
def review_queue(spark, d):
    lines = table(spark, d, "lineitem").withColumn("proposals", F.greatest(F.col("l_linenumber") - 3, F.lit(0)))
    return reports.review_queue(lines, "l_discount", "proposals", 0.03).select("l_orderkey", "l_linenumber", "reasons")


@query(
    """SELECT least(a.l_suppkey, b.l_suppkey) AS a, greatest(a.l_suppkey, b.l_suppkey) AS b, count(DISTINCT a.l_orderkey) AS weight, any_value('x' || least(a.l_suppkey, b.l_suppkey)) AS label FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2
    UNION ALL SELECT -2, -1, 0, 'only a label'"""
)
def labelled_edges(spark, d):
    from quire.operators.aggregates import pairs

    edges = pairs(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct(), "l_orderkey", "l_suppkey").withColumnRenamed("n", "weight")
    labels = edges.select(F.col("b").alias("x"), F.col("a").alias("y"), F.concat(F.lit("x"), "a").alias("label")).unionByName(spark.createDataFrame([(-1, -2, "only a label")], "x long, y long, label string"))
    canonical = labels.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "label")
    return edges.join(canonical, ["a", "b"], "full").select("a", "b", F.coalesce("weight", F.lit(0)).alias("weight"), "label")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents u WHERE u.doc_id % 10 = 0 AND (u.doc_id = d.doc_id OR md5(u.text) = md5(d.text)))")
def hold_out_exclusion(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))
    used = docs.filter("doc_id % 10 = 0")
    return docs.join(used.select("doc_id"), "doc_id", "left_anti").join(used.select("digest"), "digest", "left_anti").select("doc_id")
