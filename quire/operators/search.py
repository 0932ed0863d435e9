"""Lexical, vector and hybrid search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import windows

K1, B = 1.2, 0.75


def query_terms(text: str, least: int = 3) -> list[str]:
    """The runs of letters and digits of a query that are long enough for a trigram index, lower-cased, each once."""
    return list(dict.fromkeys(t.lower() for t in re.findall(r"\w+", text) if len(t) >= least))


def phrase_counts(text: Column, terms: list[str]) -> list[Column]:
    """How often each phrase occurs in the text, whatever the case; a phrase may begin inside a word."""
    low = F.lower(text)
    return [((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("long") for t in terms]


def bm25(pages: DataFrame, text: str, terms: list[str], top: int, key: str) -> DataFrame:
    """The pages with the best BM25 of any of the phrases: key, score (higher is better), rank.

    A page's length is its number of trigrams. One pass finds how many pages have each phrase and the mean length; its
    result is one row. A second ranks; only `top` rows of each task go further.
    """
    if not terms:
        return pages.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    names = [f"__t{i}" for i in range(len(terms))]
    rows = pages.select(key, F.greatest(F.length(text) - 2, F.lit(1)).alias("__len"), *[c.alias(n) for c, n in zip(phrase_counts(F.col(text), terms), names)])
    stats = rows.agg(F.count("*").alias("__n"), F.avg("__len").alias("__avg"), *[F.count(F.when(F.col(n) > 0, 1)).alias(f"{n}_df") for n in names])
    idf = lambda n: F.log(1 + (F.col("__n") - F.col(f"{n}_df") + 0.5) / (F.col(f"{n}_df") + 0.5))
    part = lambda n: idf(n) * F.col(n) * (K1 + 1) / (F.col(n) + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
    some = rows.filter(" or ".join(f"{n} > 0" for n in names))
    scored = some.join(F.broadcast(stats)).select(key, F.round(sum((part(n) for n in names), F.lit(0.0)), 6).alias("score"))
    best = scored.orderBy(F.desc("score"), key).limit(top)
    return _ranked(best, F.desc("score"), F.col(key))


def _ranked(best: DataFrame, *order: Column) -> DataFrame:
    """Number the rows of a result that is already limited."""
    from pyspark.sql import Window

    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def similarity_of(distance: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), 1 - distance / 2), 4)


def valid_vector(v: Column, dim: int) -> Column:
    """Of the right dimension, finite, and not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & fine & (dot(v, v) > 0), F.lit(False))


def knn(vectors: DataFrame, query: list[float], top: int, key: str, vector: str = "embedding", metric: str = "l2") -> DataFrame:
    """The nearest rows by exact distance: key, distance, rank. The query is a literal; each task keeps its top."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = squared_l2(F.col(vector), q) if metric == "l2" else 1 - cosine(F.col(vector), q)
    best = vectors.select(key, F.round(d, 6).alias("distance")).orderBy("distance", key).limit(top)
    return _ranked(best, F.col("distance"), F.col(key))


def knn_group_dedup(vectors: DataFrame, query: list[float], top: int, group: str, key: str, per_group: int, vector: str = "embedding") -> DataFrame:
    """The nearest groups by their nearest row, among top * per_group rows that are fetched."""
    near = knn(vectors, query, top * per_group, key, vector, "cosine").join(vectors.select(key, group), key)
    return windows.best_by(near.withColumn("__s", -F.col("distance")), [group], "__s", key).select(group, key, "distance").orderBy("distance", key).limit(top)


def snippet(text: Column, fragments: list[str], width: int = 200) -> Column:
    """About `width` characters around the longest fragment that occurs, in any case, with ellipses where text is cut."""
    low, at = F.lower(text), F.lit(0)
    for f in sorted(dict.fromkeys(x.lower() for x in fragments), key=len):
        found = F.instr(low, f)
        at = F.when(found > 0, found).otherwise(at)
    start = F.greatest(F.lit(1), at - width // 2)
    body = F.substr(text, start, F.lit(width))
    return F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + width <= F.length(text), "…").otherwise(""))


def hybrid(pages: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], key: str, group: str, top: int = 10, per_group: int = 3, k: int = 60) -> DataFrame:
    """Lexical and vector search fused by reciprocal rank, at most `per_group` pages of a group, with snippets."""
    lexical = bm25(pages, "full_text", query_terms(query), max(5 * top, 50), key)
    dense = knn(vectors, query_vector, max(5 * top, 50), key)
    merged = windows.fused([lexical, dense], [key], k=k).withColumn("score", F.round("score", 9))
    # at most two lists of max(5 * top, 50) rows; texts are fetched for the hits that are left
    hits = pages.select(key, group, "page_no").join(F.broadcast(merged), key)
    best = windows.capped(hits, group, per_group, top, F.desc("score"), F.col("first"))
    whole = pages.select(F.col(key).alias("__key"), "full_text").join(F.broadcast(best), F.col("__key") == F.col(key))
    return whole.orderBy(F.desc("score"), "first").select(key, group, "page_no", "score", snippet(F.col("full_text"), query_terms(query)).alias("snippet"))


def verified(hits: DataFrame, canonical: DataFrame, key: str, text: str) -> DataFrame:
    """Hits with the whole text of their canonical row, which must be there exactly once."""
    rows = canonical.groupBy(key).agg(F.count("*").alias("__n"), F.first(text).alias(text))
    j = hits.join(rows, key, "left")
    return j.filter(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a hit has no single canonical row: "), F.col(key).cast("string"))).cast("boolean"))).drop("__n")
