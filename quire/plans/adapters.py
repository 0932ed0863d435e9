"""The library's entities over the shared tables, as DataFrames and as the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import table

#: Pages: a book is a language and a source, a page's number its place among the book's documents.
PAGES_SQL = """
    SELECT d.doc_id AS page_id, d.lang || '_' || d.source AS book, row_number() OVER (PARTITION BY d.lang, d.source ORDER BY d.doc_id) AS page_no,
           count(*) OVER (PARTITION BY d.lang, d.source) AS page_count, d.text AS full_text, d.n_chars AS char_count, coalesce(l.toxic, 0) = 0 AS eligible
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
#: Observations: a watch is a user, the price a value, the status told by the kind of event.
OBSERVATIONS_SQL = """
    SELECT event_id AS id, user_id AS watch_id, ts, value AS price, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial' ELSE 'ok' END AS status FROM events
"""
#: Items: parts as books of a series, their suppliers as authors.
ITEMS_SQL = """
    SELECT p.p_partkey AS item, p.p_name AS title, p.p_brand AS series, p.p_size AS volume, a.authors
    FROM part p LEFT JOIN (SELECT l_partkey, list_sort(list(DISTINCT l_suppkey)) AS authors FROM lineitem GROUP BY 1) a ON a.l_partkey = p.p_partkey
"""


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages are numbered as ids alone; texts, which make up nearly all of the table, are joined by id afterwards."""
    by = Window.partitionBy("lang", "source")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    documents = table(spark, folder, "documents")
    numbered = (
        documents.select("doc_id", "lang", "source")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("page_id"),
            F.concat_ws("_", "lang", "source").alias("book"),
            F.row_number().over(by.orderBy("doc_id")).alias("page_no"),
            F.count("*").over(by).alias("page_count"),
            (F.coalesce("toxic", F.lit(0)) == 0).alias("eligible"),
        )
    )
    texts = documents.select(F.col("doc_id").alias("page_id"), F.col("text").alias("full_text"), F.col("n_chars").alias("char_count"))
    return numbered.join(texts, "page_id").select("page_id", "book", "page_no", "page_count", "full_text", "char_count", "eligible")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "partial").otherwise("ok")
    return table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("watch_id"), "ts", F.col("value").alias("price"), kind.alias("status"))


def items(spark: SparkSession, folder: str) -> DataFrame:
    authors = table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("authors"))
    part = table(spark, folder, "part")
    return part.join(authors, part.p_partkey == authors.l_partkey, "left").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.col("p_brand").alias("series"), F.col("p_size").alias("volume"), "authors")
