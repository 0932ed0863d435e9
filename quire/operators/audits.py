"""Checks before something is replaced: recall of terms, names that would be lost, sources that have moved, rates that are stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.reports import evidence


def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text, without overlaps; 0 for an empty term or a null."""
    n = (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)
    return F.when(F.length(term) > 0, F.coalesce(n.cast("long"), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))


def term_recall(annotations: DataFrame, truths: DataFrame, readings: DataFrame, digest: str, terms: str, reference: str, hypothesis: str) -> tuple[DataFrame, DataFrame]:
    """Terms that pages should have, by the digest of the page: (results, problems).

    results: (digest, term, expected, actual, matched, missing) of each term that the true text has; problems: (digest, term,
    problem) of pages without a truth or a reading (term null), and of terms that the truth lacks."""
    j = annotations.join(truths.select(digest, F.col(reference).alias("__r")), digest, "left").join(readings.select(digest, F.col(hypothesis).alias("__h")), digest, "left")
    there = F.col("__r").isNotNull() & F.col("__h").isNotNull()
    each = j.filter(there).select(digest, F.explode(F.array_distinct(terms)).alias("term"), "__r", "__h")
    each = each.select(digest, "term", occurrences(F.col("__r"), F.col("term")).alias("expected"), occurrences(F.col("__h"), F.col("term")).alias("actual"))
    absent = j.filter(~there).select(digest, F.lit(None).cast("string").alias("term"), F.lit("no such page").alias("problem"))
    problems = absent.unionByName(each.filter("expected = 0").select(digest, "term", F.lit("term is not in the reference").alias("problem")))
    matched = F.least("expected", "actual")
    return each.filter("expected > 0").select(digest, "term", "expected", "actual", matched.alias("matched"), (F.col("expected") - matched).alias("missing")), problems


def term_gate(results: DataFrame, problems: DataFrame, least_terms: int, least_expected: int, least_recall: float, most_missing: int) -> DataFrame:
    """(check, value, passed): all annotations resolved, enough distinct terms and occurrences, recall, missing occurrences."""
    one = results.agg(F.count_distinct("term").alias("terms"), F.coalesce(F.sum("expected"), F.lit(0)).alias("expected"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"))
    both = one.crossJoin(F.broadcast(problems.agg(F.count("*").alias("problems"))))
    recall = F.try_divide(F.col("expected") - F.col("missing"), F.col("expected"))
    checks = {
        "resolved": (F.col("problems"), F.col("problems") == 0),
        "terms": (F.col("terms"), F.col("terms") >= least_terms),
        "expected": (F.col("expected"), F.col("expected") >= least_expected),
        "recall": (F.round(recall, 6), F.coalesce(recall >= least_recall, F.lit(False))),
        "missing": (F.col("missing"), F.col("missing") <= most_missing),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check"), v.cast("double").alias("value"), ok.alias("passed")) for k, (v, ok) in checks.items()])
    return both.select(F.inline(rows))


def unexplained_deletions(published: DataFrame, prepared: DataFrame, aliases: DataFrame, pages: DataFrame, name: str, alias: str, derived: str, page: str, text: str) -> DataFrame:
    """(name, pages): published names that are not prepared again though pages have them, or two pages an alias of theirs. If there
    is a row the old content must stay."""
    lost = published.select(name).distinct().join(prepared.select(name).hint("merge"), name, "left_anti")
    theirs = aliases.join(lost.hint("merge"), name, "left_semi")
    return evidence(theirs, pages, name, alias, derived, page, text).select(name, "pages")


def changed_sources(snapshot: DataFrame, current: DataFrame, key: str, version: str, digest: str) -> DataFrame:
    """(key, problem) of sources that are not as they were in the snapshot: missing, repeated, of another version or body."""
    now = current.groupBy(key).agg(F.count("*").alias("__n"), F.first(version).alias("__v"), F.first(digest).alias("__d"))
    j = snapshot.join(now, key, "left")
    what = (
        F.when(F.col("__n").isNull(), "missing")
        .when(F.col("__n") > 1, "repeated")
        .when(F.col("__v").isNull() | (F.col("__v") != F.col(version)), "version")
        .when(~F.col("__d").eqNullSafe(F.col(digest)), "body")
    )
    return j.withColumn("problem", what).filter("problem is not null").select(key, "problem")


def refreshed_rates(cache: DataFrame, pairs: DataFrame, key: str, reference: str, hypothesis: str) -> DataFrame:
    """(key, reference_sha, hypothesis_sha, distance, chars, rate, computed): error rates of which those whose two
    fingerprints are in the cache (key, reference_sha, hypothesis_sha, distance) are taken from there; only the others are computed."""
    now = pairs.select(key, F.col(reference).alias("__r"), F.col(hypothesis).alias("__h"), F.sha2(reference, 256).alias("reference_sha"), F.sha2(hypothesis, 256).alias("hypothesis_sha"))
    known = cache.select(key, "reference_sha", "hypothesis_sha", F.col("distance").alias("__d"))
    j = now.join(known, [key, "reference_sha", "hypothesis_sha"], "left")
    distance = F.when(F.col("__d").isNotNull(), F.col("__d")).otherwise(F.levenshtein("__r", "__h")).cast("long")
    j = j.select(key, "reference_sha", "hypothesis_sha", distance.alias("distance"), F.length("__r").cast("long").alias("chars"), F.col("__d").isNull().alias("computed"))
    return j.withColumn("rate", F.try_divide(F.col("distance").cast("double"), F.col("chars").cast("double")))


def block_digest(pages: DataFrame, group: str, page: str, text: str, context: str = "") -> DataFrame:
    """(group, digest): of a block's pages in order, with control characters between numbers and texts."""
    one = F.concat(F.col(page).cast("string"), F.lit("\x1f"), F.coalesce(text, F.lit("")), F.lit("\x1e"))
    blocks = pages.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), one.alias("t")))).alias("l"))
    return blocks.select(group, F.sha2(F.concat(F.lit(context + "\x1d"), F.array_join(F.transform("l", lambda x: x["t"]), "")), 256).alias("digest"))
