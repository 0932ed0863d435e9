"""Queries of several readings of a page, over benchmark items, conversations and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import sequential, text
from quire.operators import readings
from quire.plans.registry import query
from quire.session import table


@query()
def segment_labels(spark, d):
    """Labels of every item for the segments of a reading that lacks letters; held against all alignments in tests."""
    b = table(spark, d, "benchmark").select("item_id", text.metric_text(F.col("text")).alias("reference"))
    noisy = F.regexp_replace("reference", "(?<=e)th", "t")
    parts = F.regexp_extract_all(noisy, F.lit(".{1,37}"), F.lit(0))
    return readings.segment_labels(b.withColumn("parts", parts), "item_id", "reference", "parts")


COLUMNS = "SELECT l_orderkey, l_quantity * 10 AS x0, l_quantity * 10 + l_linenumber AS x1, l_partkey % 20 AS chars FROM lineitem"


@query(
    f"""WITH c AS (SELECT l_orderkey, (x0 + x1) / 2 AS center, x1 - x0 AS w, chars, x0 FROM ({COLUMNS})), g AS (SELECT *, row_number() OVER o - 1 AS gap_index, center - lead(center) OVER o AS gap FROM c WINDOW o AS (PARTITION BY l_orderkey ORDER BY center DESC, x0)),
    m AS (SELECT l_orderkey, median(gap) FILTER (gap > 0) AS med, median(w) AS width FROM g GROUP BY 1 HAVING count(*) >= 4 AND count(*) FILTER (gap > 0) >= 3),
    r AS (SELECT *, gap / med AS gap_ratio, CAST(least(3, greatest(1, round_even(gap / med, 0) - 1)) AS INTEGER) AS missing_count FROM g JOIN m USING (l_orderkey) WHERE gap > 0 AND gap / med >= 1.6 AND NOT (gap_index = 0 AND chars <= 4))
    SELECT l_orderkey, gap_index, k AS missing_index, missing_count, round(center - gap / (missing_count + 1) * (k + 1), 6) AS center, width, round(gap_ratio, 6) AS gap_ratio FROM (SELECT *, unnest(range(missing_count)) AS k FROM r)"""
)
def missing_columns(spark, d):
    c = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_quantity * 10 as x0", "l_quantity * 10 + l_linenumber as x1", "l_partkey % 20 as chars")
    found = readings.missing_columns(c, "l_orderkey", "x0", "x1", "chars", 1.6, 4)
    return found.withColumns({"center": F.round("center", 6), "gap_ratio": F.round("gap_ratio", 6)})


def tiles(spark, d):
    lines = table(spark, d, "lineitem").selectExpr("l_suppkey % 50 as book", "int(l_linenumber * 32) as x", "int(l_quantity % 8 * 32) as y", "int(l_orderkey % 40) as page")
    return lines.groupBy("book", "x", "y").agg(F.collect_set("page").alias("pages")).withColumn("sampled", F.lit(40))


@query()
def tile_clusters(spark, d):
    """Places of a page that repeat together in a book; held against a plain walk in tests."""
    return readings.tile_clusters(tiles(spark, d), "book", "x", "y", "pages", "sampled")


def corrected_pages(spark, d):
    turns = table(spark, d, "conversations").filter("text is not null")
    wrong = F.regexp_replace("text", "tion", "tian")
    pages = turns.select(F.expr("conv_id * 1000 + turn").alias("page"), F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(wrong).alias("consensus"), F.array("text", wrong).alias("readings"))
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+tion"), F.lit(0))
    terms = table(spark, d, "benchmark").select(F.explode(words).alias("term")).filter("length(term) between 8 and 12").distinct()
    return pages, terms


@query()
def supported_corrections(spark, d):
    """What becomes of variants of terms; held against a plain walk over all terms in tests."""
    pages, terms = corrected_pages(spark, d)
    proposals, texts = readings.supported_corrections(pages, "page", "consensus", "readings", terms, "term")
    return proposals


@query(
    """WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS kind, length(text) AS n FROM conversations WHERE length(text) >= 40)
    SELECT conv_id, turn, CASE kind WHEN 3 THEN 'external_crosscheck_unavailable' WHEN 4 THEN 'external_ocr_recovered_primary' WHEN 1 THEN 'cross_engine_disagreement' WHEN 5 THEN 'cross_engine_disagreement' WHEN 2 THEN 'external_ocr_more_complete' ELSE 'cross_engine_consensus' END AS flag,
        CASE WHEN kind IN (2, 4) THEN 'external' ELSE 'primary' END AS chosen, kind NOT IN (1, 5) AS passed FROM c"""
)
def adjudicated_readings(spark, d):
    c = table(spark, d, "conversations").filter("length(text) >= 40").select("conv_id", "turn", F.expr("(conv_id + turn) % 6").alias("kind"), "text")
    other = F.when(F.col("kind") == 1, F.concat("text", "text")).when(F.col("kind") == 2, F.concat("text", F.repeat(F.lit("☃"), F.ceil(F.length("text") / 20).cast("int")))).when(F.col("kind") == 5, "").otherwise(F.col("text"))
    return readings.adjudicated(c.withColumn("other", other), "text", "other", F.col("kind") != 4, F.col("kind") != 3).select("conv_id", "turn", "flag", "chosen", "passed")


@query("SELECT item_id, 40 AS place, '《追加》' AS added FROM benchmark WHERE length(text) >= 60")
def insertion_proposals(spark, d):
    """The registered table function, lateral in SQL."""
    spark.udtf.register("insertion_proposals", readings.InsertionProposals)
    b = table(spark, d, "benchmark").filter("length(text) >= 60").select("item_id", "text", F.expr("substr(text, 1, 40) || '《追加》' || substr(text, 41)").alias("other"))
    return spark.sql("SELECT item_id, p.place, p.added FROM {b}, LATERAL insertion_proposals(text, other, 2, 20, 15) p", b=b)


@query(
    """WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations)
    SELECT conv_id, CAST(place AS INTEGER) AS place, role || ' speaks here' AS text, CASE turn % 4 WHEN 3 THEN '' WHEN 2 THEN turn || ',' || turn + 1 ELSE CAST(turn AS VARCHAR) END AS pages, CASE WHEN turn % 4 = 3 THEN 'no page' WHEN turn > 5 THEN 'invented page' END AS problem FROM c"""
)
def fact_records(spark, d):
    c = table(spark, d, "conversations")
    pages = F.when(F.col("turn") % 4 == 3, "").when(F.col("turn") % 4 == 2, F.concat(F.lit(" [page "), "turn", F.lit(", "), F.col("turn") + 1, F.lit("][PAGE "), "turn", F.lit("]"))).otherwise(F.concat(F.lit(" [page "), "turn", F.lit("]")))
    line = F.concat(F.lit("- "), "role", F.lit(" speaks\n   here"), pages)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    sheets = c.groupBy("conv_id").agg(F.array_join(lines, "\n\n").alias("sheet")).withColumn("allowed", F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))
    return readings.fact_records(sheets, "conv_id", "sheet", "allowed").select("conv_id", "place", "text", F.array_join("pages", ",").alias("pages"), "problem")


@query("SELECT conv_id * 1000 + turn AS page, text FROM conversations WHERE length(text) > 0")
def reading_consensus(spark, d):
    """Three readings of each page, of which one has letters changed: the vote gives the page back."""
    c = table(spark, d, "conversations").filter("length(text) > 0").select(F.expr("conv_id * 1000 + turn").alias("page"), "text")
    wrong = F.regexp_replace("text", "[aeiou]n", "xn")
    three = c.select("page", F.posexplode(F.array("text", wrong, "text")).alias("engine", "text"))
    return sequential.consensus(three, "page", "engine", "text")
