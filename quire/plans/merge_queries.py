"""Queries of write semantics: what a table is after an upsert, a rebuild, a publication, an import."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import merges, sets
from quire.plans.registry import query
from quire.session import table
from quire.sources import writers


def _table(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("book"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))


@query("SELECT CAST(c_custkey AS BIGINT) AS k, c_nationkey AS book, 'new' AS name, CAST(NULL AS VARCHAR) AS seg FROM customer WHERE c_acctbal > 5000")
def full_replace(spark, d):
    new = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").cast("int").alias("k"), F.col("c_nationkey").alias("book"), F.lit("new").alias("name"), F.lit(None).alias("seg"))
    return merges.replaced(_table(spark, d), new)


@query("SELECT c_custkey AS k, ('{\"name\":\"' || c_name || '\"' || CASE WHEN c_custkey % 2 = 0 THEN ',\"seg\":\"' || c_mktsegment || '\"' ELSE '' END || CASE WHEN c_acctbal < 0 THEN ',\"hidden\":true' ELSE '' END || '}') AS entry FROM customer")
def row_documents(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("seg"), (F.col("c_acctbal") < 0).alias("hidden"))
    return writers.entries(c, ["k"], ["hidden"])


@query("SELECT c_custkey AS k, c_name AS name, '[\"' || c_mktsegment || '\",\"x\"]' AS authors FROM customer")
def document_rows(spark, d):
    doc = F.to_json(F.struct(F.col("c_name").alias("name"), F.array("c_mktsegment", F.lit("x")).alias("authors")))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), doc.alias("entry"))
    return writers.rows(c, "k", "entry", "name string, authors array<string>")


CHUNKS = "SELECT conv_id AS book, turn AS page, text FROM conversations"


@query(f"WITH c AS ({CHUNKS}) SELECT book, page, text FROM c WHERE book % 3 <> 0 UNION ALL SELECT book, page, 'new: ' || text FROM c WHERE book % 3 = 0 AND length(text) >= 30")
def book_rebuild(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("page"), "text")
    new = c.filter("book % 3 = 0 and length(text) >= 30").withColumn("text", F.concat(F.lit("new: "), "text"))
    # a book whose pages are all too short must lose its chunks as well
    return merges.replaced_rows(c.filter("book % 3 <> 0 or length(text) >= 30"), new, ["book"])


@query(f"WITH c AS ({CHUNKS}) SELECT book, page, CASE WHEN page % 4 = 0 THEN text ELSE 'new' END AS text FROM c")
def rebuild_compensation(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("page"), "text")
    return merges.compensated(c, c.withColumn("text", F.lit("new")), c.filter("page % 4 = 0"), ["book", "page"])


@query("SELECT c_custkey AS k, c_name AS name, 'r' || c_nationkey AS run FROM customer WHERE c_nationkey < 5 UNION ALL SELECT c_custkey, c_name, 'legacy' FROM customer WHERE c_nationkey >= 5")
def snapshot_once(spark, d):
    t = _table(spark, d).select("k", "name", "book")
    history = t.filter("book < 5").select("k", "name", F.concat(F.lit("r"), "book").alias("run"))
    return merges.snapshot_once(history, t.select("k", "name"), "k", "legacy")


@query(
    """WITH e AS (SELECT user_id AS run, event_id, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'progress' END AS event, event_id % 5 AS added FROM events WHERE event_type <> 'error' OR event_id % 3 = 0)
    SELECT run, coalesce(arg_min(event, event_id) FILTER (event <> 'progress'), 'running') AS status, CAST(sum(added) AS BIGINT) AS added FROM e GROUP BY 1"""
)
def run_lifecycle(spark, d):
    e = table(spark, d, "events").filter("event_type <> 'error' or event_id % 3 = 0")
    kind = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("progress")
    return merges.lifecycle(e.select(F.col("user_id").alias("run"), "event_id", kind.alias("event"), (F.col("event_id") % 5).alias("added")), "run", "event_id", "event", ["added"])


@query(
    """WITH o AS (SELECT c_custkey AS k, c_name AS summary, c_nationkey AS pages FROM customer WHERE c_custkey % 3 > 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_mktsegment END AS summary, 7 AS pages FROM customer WHERE c_custkey % 5 > 0)
    SELECT coalesce(o.k, n.k) AS k, coalesce(nullif(trim(n.summary), ''), o.summary) AS summary, coalesce(n.pages, o.pages) AS pages FROM o FULL JOIN n ON o.k = n.k"""
)
def character_upsert(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    old = c.filter("k % 3 > 0").select("k", F.col("c_name").alias("summary"), F.col("c_nationkey").alias("pages"))
    new = c.filter("k % 5 > 0").select("k", F.nullif(F.trim(F.when(F.col("k") % 2 == 0, " ").otherwise(F.col("c_mktsegment"))), F.lit("")).alias("summary"), F.lit(7).alias("pages"))
    return merges.upsert(old, new, ["k"], keep_old_when_null=["summary"], overwrite=["pages"])


@query("SELECT conv_id, turn, md5(text) AS hash, conv_id % 2 = 0 AND turn % 3 > 0 AND role <> 'system' AS reused FROM conversations")
def checkpoint_reuse(spark, d):
    c = table(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", "role", F.md5("text").alias("hash"))
    blocks = c.withColumn("model", F.lit("m"))
    known = c.filter("role <> 'system'").withColumns({"hash": F.when(F.col("turn") % 3 > 0, F.col("hash")).otherwise("old"), "model": F.when(F.col("conv_id") % 2 == 0, "m").otherwise("other")})
    return merges.reusable(known, blocks, ["conv_id", "turn"], ["hash", "model"]).select("conv_id", "turn", "hash", "reused")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS block, count(*) OVER (PARTITION BY conv_id) // 2 AS kept FROM conversations) WHERE block < kept")
def tail_prune(spark, d):
    """Blocks of conversations that were built anew with half as many: the tail of each goes."""
    c = table(spark, d, "conversations")
    blocks = c.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("block"))
    return merges.prune_tail(blocks, c.groupBy("conv_id").agg(F.floor(F.count("*") / 2).alias("n")), ["conv_id"], "block", "n").select("conv_id", "turn")


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE label END AS label FROM embeddings UNION ALL SELECT -vec_id, -2 FROM embeddings WHERE vec_id % 100 = 1")
def vector_upsert(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    batch = e.filter("vec_id % 4 = 0").withColumn("label", F.lit(-1)).unionByName(e.filter("vec_id % 100 = 1").select((-F.col("vec_id")).alias("vec_id"), F.lit(-2).alias("label")))
    return merges.replaced_rows(e, batch, ["vec_id"])


@query("SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN 'about ' || conv_id ELSE CASE WHEN turn > 2 THEN 'old' END END AS context FROM conversations")
def context_store(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") > 2, "old").alias("context"))
    batch = c.filter("turn % 2 = 0").withColumn("context", F.concat(F.lit("about "), "conv_id"))
    return merges.upsert(c, batch, ["conv_id", "turn"], overwrite=["context"])


@query("SELECT n_nationkey AS k, 'NATION_' || n_nationkey AS name, DATE '2024-01-31' - n_nationkey < DATE '2024-01-20' AND n_nationkey % 3 > 0 AS purged FROM nation")
def backup_retention(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.date_sub(F.lit("2024-01-31").cast("date"), F.col("n_nationkey")).cast("timestamp").alias("at"), (F.col("n_nationkey") % 3 > 0).alias("valid"))
    return merges.retained(n, F.lit("2024-01-31 00:00:00").cast("timestamp"), 11, "at", "valid").select("k", "name", "purged")


@query("SELECT doc_id, source, CASE WHEN source = 'src3' THEN 'validation' ELSE 'train' END AS side FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def training_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return merges.split_for_training(docs, "source", ["src1", "src2"], ["src3"], ["src4"]).select("doc_id", "source", "side")


@query(
    """WITH b AS (SELECT o_custkey AS k, o_orderkey AS id FROM orders), n AS (SELECT k, id FROM b WHERE id % 4 = 0) SELECT k, id, CASE WHEN k IN (SELECT k FROM n) AND id % 4 > 0 THEN 1 END AS retired FROM b WHERE id % 4 > 0 UNION ALL SELECT k, id, NULL FROM n"""
)
def versioned_publication(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"))
    none = F.lit(None).cast("timestamp")
    history = o.filter("id % 4 > 0").withColumns({"published_at": F.lit("2024-01-01").cast("timestamp"), "retired_at": none})
    out = merges.publish(history, o.filter("id % 4 = 0"), "k", F.lit("2024-02-01").cast("timestamp"))
    return out.select("k", "id", F.when(F.col("retired_at").isNotNull(), 1).alias("retired"))


@query("SELECT 'f' || c_custkey AS name, md5(c_name) AS sha256 FROM customer WHERE c_custkey % 3 > 0")
def import_ledger(spark, d):
    f = table(spark, d, "customer").select(F.lit("csv").alias("kind"), F.concat(F.lit("f"), "c_custkey").alias("name"), F.md5("c_name").alias("sha256"), "c_custkey")
    return merges.not_imported(f, f.filter("c_custkey % 3 = 0")).select("name", "sha256")


@query("SELECT user_id AS id, min(event_id) AS at, bool_and(event_type <> 'view') AS late FROM events GROUP BY 1")
def ordered_union(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", "event_type")
    u = sets.ordered_union(e.filter("event_type = 'view'"), e, "id", "event_id")
    first = e.groupBy("id").agg(F.min("event_id").alias("at"))
    return u.join(first, "id").select("id", "at", (F.col("place.t") == 1).alias("late"))


@query("WITH d AS (SELECT doc_id AS k FROM documents), l AS (SELECT doc_id AS k FROM labels), x AS (SELECT (SELECT count(*) FROM (FROM d EXCEPT FROM l)) AS only_left, (SELECT count(*) FROM (FROM l EXCEPT FROM d)) AS only_right) SELECT *, only_left = 0 AND only_right = 0 AS equal FROM x")
def coverage_equality(spark, d):
    return sets.same_keys(table(spark, d, "documents").select(F.col("doc_id").alias("k")), table(spark, d, "labels").select(F.col("doc_id").alias("k")), "k")


@query("SELECT name, bool_or(hit) AS hit FROM (SELECT c_name AS name, true AS hit FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT c_name, false FROM customer WHERE c_nationkey = 3) GROUP BY 1")
def name_union(spark, d):
    c = table(spark, d, "customer")
    both = c.filter("c_acctbal > 9000").select(F.col("c_name").alias("name"), F.lit(True).alias("hit")).unionByName(c.filter("c_nationkey = 3").select(F.col("c_name").alias("name"), F.lit(False).alias("hit")))
    return both.groupBy("name").agg(F.bool_or("hit").alias("hit"))


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'queued' ELSE 'finished' END AS state, 'orders' AS store FROM orders UNION ALL SELECT conv_id, 'ocr', 'conversations' FROM conversations GROUP BY 1")
def job_rows(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "queued").otherwise("finished").alias("state"), F.lit("orders").alias("store"))
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.lit("ocr").alias("state"), F.lit("conversations").alias("store")).distinct()
    return o.unionByName(c)


@query("SELECT p_partkey FROM part p WHERE p_brand IN ('Brand#3', 'Brand#7') OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey IN (1, 2))")
def pinned_names(spark, d):
    p = table(spark, d, "part")
    by_author = table(spark, d, "lineitem").filter("l_suppkey in (1, 2)").select(F.col("l_partkey").alias("p_partkey"))
    return p.filter(F.col("p_brand").isin("Brand#3", "Brand#7")).select("p_partkey").unionByName(by_author).distinct()
