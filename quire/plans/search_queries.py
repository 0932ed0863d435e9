"""Queries of the lexical index, of vector cells, and of what is done with hits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import ann, filters, postings, reports, search, text_index, vector_index, windows
from quire.plans.adapters import PAGES_SQL, pages
from quire.plans.queries import QUERY_VECTOR
from quire.plans.registry import query
from quire.session import table
from quire.sources.publications import Publication
from quire.sources.shared import new_folder, stored

WITH_PAGES = f"WITH pages_ AS ({PAGES_SQL})"
WITH_WORDS = r"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\pL\pN]+'), lambda w: length(w) <= 40) AS ws FROM documents), e AS (SELECT doc_id, len(ws) AS length, unnest(ws) AS token FROM w),
    p AS (SELECT token, doc_id, length, count(*) AS tf FROM e GROUP BY ALL), s AS (SELECT count(*) AS n, avg(length) AS mean FROM (SELECT DISTINCT doc_id, length FROM p))"""
BM25 = "sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)))"


def _index(spark, d):
    """Postings of all texts, stored: searches read them for hits, frequencies and lengths."""
    return stored(postings.index(table(spark, d, "documents").select("doc_id", "text"), "doc_id", postings.words(F.col("text"))), "postings")


@query(f"{WITH_WORDS} SELECT token, count(*) AS pages, CAST(sum(tf) AS BIGINT) AS total FROM p GROUP BY 1")
def postings_index(spark, d):
    return _index(spark, d).groupBy("token").agg(F.count("*").alias("pages"), F.sum("tf").alias("total"))


@query(f"{WITH_WORDS}, h AS (SELECT * FROM p WHERE token IN ('license', 'the', 'version')), f AS (SELECT token, count(*) AS df FROM h GROUP BY 1) SELECT doc_id, round({BM25}, 6) AS score FROM h JOIN f USING (token), s GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 25")
def word_search(spark, d):
    return postings.search(_index(spark, d), "doc_id", ["license", "the", "version"], 25).select("doc_id", "score")


@query(
    r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\pL\pN]+'), lambda w: length(w) <= 40)) AS w FROM documents), g AS (SELECT doc_id, unnest([substr(w, i, 2) FOR i IN range(1, length(w))]) AS token FROM w UNION ALL SELECT doc_id, unnest([substr(w, i, 3) FOR i IN range(1, length(w) - 1)]) FROM w)
    SELECT token, count(DISTINCT doc_id) AS pages, count(*) AS total FROM g GROUP BY 1"""
)
def gram_index(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return postings.index(docs, "doc_id", postings.words(F.col("text")), (2, 3)).groupBy("token").agg(F.count("*").alias("pages"), F.sum("tf").alias("total"))


@query(
    r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'one fresh page' WHEN doc_id % 10 = 1 THEN NULL ELSE text END AS text FROM documents), e AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\pL\pN]+'), lambda w: length(w) <= 40)) AS token FROM t)
    SELECT token, count(DISTINCT doc_id) AS pages FROM e GROUP BY 1"""
)
def index_refresh(spark, d):
    changed = table(spark, d, "documents").filter("doc_id % 10 in (0, 1)").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "one fresh page").alias("text"))
    return postings.refreshed(_index(spark, d), changed, "doc_id", postings.words(F.col("text"))).groupBy("token").agg(F.count("*").alias("pages"))


PLACED = r"""WITH w AS (SELECT doc_id, coalesce(list_filter(regexp_extract_all(lower(text), '[\pL\pN]+'), lambda w: length(w) <= 40), []) AS ws FROM documents), s AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM w)"""


def _text_index(spark, d):
    at = Publication(spark, new_folder(spark, "texts"))
    text_index.build(at, table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return text_index.Reader(at)


@query(
    f"""{PLACED}, e AS (SELECT doc_id, unnest(ws) AS token, unnest(range(len(ws))) AS place FROM w)
    SELECT token, count(DISTINCT doc_id) AS pages, count(*) AS total, CAST(sum(place) AS BIGINT) AS places FROM e GROUP BY 1"""
)
def text_index_inventory(spark, d):
    """Every word of the stored index, with its places."""
    places = F.aggregate(F.flatten("positions"), F.lit(0).cast("long"), lambda s, x: s + x)
    tf = F.aggregate("tf", F.lit(0).cast("long"), lambda s, x: s + x)
    return _text_index(spark, d).postings.groupBy("token").agg(F.sum("docs").alias("pages"), F.sum(tf).alias("total"), F.sum(places).alias("places"))


@query(
    f"""{PLACED}, e AS (SELECT doc_id, len(ws) AS length, unnest(ws) AS token FROM w), h AS (SELECT token, doc_id, length, count(*) AS tf FROM e WHERE token IN ('license', 'the', 'version') GROUP BY ALL),
    f AS (SELECT token, count(*) AS df FROM h GROUP BY 1) SELECT doc_id, round({BM25}, 6) AS score FROM h JOIN f USING (token), s GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 25"""
)
def text_index_search(spark, d):
    return _text_index(spark, d).search(["license", "the", "version"], 25).select(F.col("key").alias("doc_id"), "score")


@query(
    f"""{PLACED}, h AS (SELECT doc_id, len(ws) AS length, len(list_filter(range(1, len(ws)), lambda i: ws[i] = 'rights' AND ws[i + 1] = 'reserved')) AS tf FROM w), p AS (SELECT *, count(*) OVER () AS df FROM h WHERE tf > 0)
    SELECT doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score FROM p, s ORDER BY score DESC, doc_id LIMIT 25"""
)
def text_index_phrase(spark, d):
    return _text_index(spark, d).phrase_search(["rights", "reserved"], 25).select(F.col("key").alias("doc_id"), "score")


RANKED = "SELECT doc_id FROM (SELECT doc_id, {bm25} AS score FROM h JOIN f USING (token), s GROUP BY doc_id) ORDER BY round(score, 6) DESC, doc_id LIMIT 40"


@query(
    f"""{WITH_WORDS}, h AS (SELECT * FROM p WHERE token IN ('license', 'version')), f AS (SELECT token, count(*) AS df FROM h GROUP BY 1), a AS ({RANKED.format(bm25=BM25)}), b AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'reserved') ORDER BY doc_id LIMIT 40)
    SELECT (SELECT count(*) FROM a) AS served, (SELECT count(*) FROM b) AS other, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS overlap, round(count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) / count(*), 6) AS jaccard FROM a FULL JOIN b ON a.doc_id = b.doc_id"""
)
def shadow_search(spark, d):
    first = postings.search(_index(spark, d), "doc_id", ["license", "version"], 40)
    other = table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("reserved"))).select("doc_id").orderBy("doc_id").limit(40)
    return postings.shadow(first, other, "doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'version') ORDER BY doc_id LIMIT 10")
def search_fallback(spark, d):
    none = postings.search(_index(spark, d), "doc_id", ["nosuchtokenhere"], 10).select("doc_id")
    second = table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("version"))).select("doc_id").orderBy("doc_id").limit(10)
    return postings.with_fallback(none, second)


def _vector(spark, d, key=QUERY_VECTOR):
    return table(spark, d, "embeddings").filter(F.col("vec_id") == key).first()["embedding"]


@query()
def cell_search(spark, d):
    """Nearest vectors by cells; its recall against all vectors is held in tests."""
    e = table(spark, d, "embeddings")
    found = ann.centroids(e, "vec_id", "embedding", 16)
    return ann.search(ann.assigned(e, "embedding", found), found, _vector(spark, d), 10, "vec_id", probes=12).select("vec_id", "distance")


@query()
def vector_index_search(spark, d):
    """An index of all vectors, built, published and read back; every id divisible by 50 asks for its ten nearest, in a
    quarter of the cells. Its recall is held against `vector_exact_search` in tests."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    at = Publication(spark, new_folder(spark, "vectors"))
    vector_index.build(at, e, "vec_id", "embedding")
    found = vector_index.search(at, e.filter("vec_id % 50 = 0"), "vec_id", "embedding")
    return found.select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), "distance", F.col("rank").cast("long").alias("rank"))


DISTANCE = "list_sum(list_transform(list_zip(embedding, q), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2])))"


@query(
    f"""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0 AND embedding IS NOT NULL), n AS (SELECT query_id, vec_id, round({DISTANCE}, 6) AS distance FROM q, embeddings WHERE embedding IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM n) SELECT * FROM r WHERE rank <= 10"""
)
def vector_exact_search(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = vector_index.exact_search(e, "vec_id", e.filter("vec_id % 50 = 0"), "vec_id", "embedding")
    return found.select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), "distance", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {QUERY_VECTOR}), n AS (SELECT vec_id, round({DISTANCE}, 6) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 6)
    SELECT vec_id, round(greatest(0.0, 1 - distance / 2), 4) AS similarity FROM n WHERE vec_id <> {QUERY_VECTOR} ORDER BY distance, vec_id LIMIT 5"""
)
def similar_items(spark, d):
    near = search.knn(table(spark, d, "embeddings"), _vector(spark, d), 6, "vec_id").filter(F.col("vec_id") != QUERY_VECTOR).orderBy("rank").limit(5)
    return near.select("vec_id", search.similarity_of(F.col("distance")).alias("similarity"))


@query(
    f"""{WITH_PAGES}, q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {QUERY_VECTOR}), v AS (SELECT page_id, page_no, page_count, round({DISTANCE}, 6) AS distance FROM pages_ JOIN embeddings ON vec_id = page_id, q WHERE eligible AND char_count >= 200 ORDER BY distance, page_id LIMIT 50)
    SELECT page_id, distance FROM v WHERE page_no > 1 AND page_no <= page_count - 1 ORDER BY distance, page_id LIMIT 10"""
)
def vector_margins(spark, d):
    """The margin is looked at after 50 rows were fetched, so fewer than ten may come."""
    p = pages(spark, d).filter(filters.eligible(200)).select("page_id", "page_no", "page_count")
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "page_id").join(p, "page_id")
    near = search.knn(e, _vector(spark, d), 50, "page_id").join(p, "page_id")
    return near.filter("page_no > 1 and page_no <= page_count - 1").orderBy("distance", "page_id").limit(10).select("page_id", "distance")


MULTI = " UNION ALL ".join(f"(SELECT {i} AS ordinal, vec_id, round({DISTANCE}, 6) AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = {k}) ORDER BY distance, vec_id LIMIT 20)" for i, k in enumerate((3, 7, 11)))


@query(f"WITH m AS ({MULTI}) SELECT vec_id, min(distance) AS distance FROM m GROUP BY 1 ORDER BY distance, vec_id LIMIT 15")
def multi_query_retrieval(spark, d):
    e = table(spark, d, "embeddings")
    found = [search.knn(e, _vector(spark, d, k), 20, "vec_id").select("vec_id", "distance") for k in (3, 7, 11)]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("vec_id").agg(F.min("distance").alias("distance")).orderBy("distance", "vec_id").limit(15)


@query(
    """WITH h AS (SELECT doc_id, text, strpos(lower(text), 'version') AS place FROM documents WHERE contains(lower(text), 'version')), s AS (SELECT *, greatest(1, place - 100) AS start FROM h)
    SELECT doc_id, CASE WHEN start > 1 THEN '…' ELSE '' END || substr(text, start, 200) || CASE WHEN start + 200 <= length(text) THEN '…' ELSE '' END AS snippet, '/pages/' || doc_id AS url, true AS highlighted FROM s"""
)
def hit_presentation(spark, d):
    hits = table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("version")))
    return hits.select("doc_id", search.snippet(F.col("text"), ["version"]).alias("snippet"), F.concat(F.lit("/pages/"), "doc_id").alias("url"), F.lit(True).alias("highlighted"))


@query("SELECT doc_id, text FROM documents d WHERE doc_id % 5 = 0 AND (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 0) = 1 AND trim(text) <> ''")
def verified_hits(spark, d):
    hits = table(spark, d, "documents").filter("doc_id % 5 = 0").join(table(spark, d, "labels").filter("toxic = 0"), "doc_id", "left_semi").select("doc_id")
    return search.verified(hits, table(spark, d, "documents").filter("trim(text) <> ''"), "doc_id", "text")


def _grams_sql(x: str) -> str:
    t = f"regexp_replace({x}, '[\\pP\\s]+', '', 'g')"
    return f"list_distinct([substr({t}, i, 2) FOR i IN range(1, length({t}))])"


@query(
    f"""WITH c AS (SELECT conv_id, turn, {_grams_sql("text")} AS g FROM conversations WHERE turn = 0), f AS (SELECT conv_id, turn AS fact, {_grams_sql("text")} AS g FROM conversations WHERE turn > 0), s AS (SELECT c.conv_id, fact, len(list_intersect(c.g, f.g)) AS score FROM c JOIN f ON c.conv_id = f.conv_id)
    SELECT conv_id, fact, CAST(score AS INTEGER) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, fact) <= 2"""
)
def claim_evidence(spark, d):
    c = table(spark, d, "conversations")
    claims = c.filter("turn = 0").select("conv_id", F.col("text").alias("claim"))
    s = c.filter("turn > 0").join(claims, "conv_id").select("conv_id", F.col("turn").alias("fact"), text.bigram_overlap(F.col("claim"), F.col("text")).alias("score")).filter("score > 0")
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "fact"))
    return s.withColumn("k", k).filter("k <= 2").drop("k")


@query("SELECT conv_id, string_agg('[' || turn || '] ' || substr(text, 1, 80), chr(10) ORDER BY turn) AS context FROM conversations WHERE turn < 4 GROUP BY 1")
def context_assembly(spark, d):
    c = table(spark, d, "conversations").filter("turn < 4").select("conv_id", "turn", F.concat(F.lit("["), "turn", F.lit("] "), F.substring("text", 1, 80)).alias("block"))
    lists = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "block"))).alias("l"))
    return lists.select("conv_id", F.array_join(F.transform("l", lambda x: x["block"]), "\n").alias("context"))


@query(
    """WITH f AS (SELECT user_id % 4 AS claim, event_id % 60 AS page, count(*) AS n FROM events GROUP BY 1, 2) SELECT page, count(DISTINCT claim) AS claims, CAST(sum(n) AS BIGINT) AS hits FROM f GROUP BY 1"""
)
def evidence_frequency(spark, d):
    f = table(spark, d, "events").select((F.col("user_id") % 4).alias("claim"), (F.col("event_id") % 60).alias("page"))
    return f.groupBy("page").agg(F.count_distinct("claim").alias("claims"), F.count("*").alias("hits"))


@query()
def budgeted_evidence(spark, d):
    """Pages of each claim within a budget; held against a plain selection in tests."""
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("book"), (F.col("event_id") % 20).alias("claim"), (F.col("event_id") % 97).alias("page"), (F.col("event_id") % 97 * 13 % 400 + 100).alias("chars")).distinct()
    return reports.budgeted(e, "book", "claim", "page", "chars", 12, 3000)


@query("SELECT vec_id, len(embedding) AS dim, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND list_dot_product(embedding, embedding) > 0 AS valid FROM embeddings")
def vector_validity(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dim"), search.valid_vector(F.col("embedding"), 64).alias("valid"))


@query(
    f"""{WITH_PAGES}, m AS (SELECT book, page_no, regexp_replace(full_text, '\\s', '', 'g') AS t FROM pages_ WHERE contains(full_text, 'the')) SELECT book, page_no FROM m QUALIFY row_number() OVER (PARTITION BY book ORDER BY length(t) DESC, page_no) <= 3"""
)
def top_scenes(spark, d):
    p = pages(spark, d).filter(F.contains("full_text", F.lit("the"))).select("book", "page_no", F.length(F.regexp_replace("full_text", r"\s", "")).alias("n"))
    k = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("n"), "page_no"))
    return p.withColumn("k", k).filter("k <= 3").select("book", "page_no")


@query(
    f"""{WITH_PAGES}, v AS (SELECT e.vec_id, p.book, p.page_no FROM embeddings e JOIN pages_ p ON p.page_id = e.vec_id WHERE p.eligible) SELECT book, page_no, vec_id FROM v"""
)
def chunk_page_join(spark, d):
    p = pages(spark, d).filter("eligible").select(F.col("page_id").alias("vec_id"), "book", "page_no")
    return table(spark, d, "embeddings").select("vec_id").join(p, "vec_id").select("book", "page_no", "vec_id")
