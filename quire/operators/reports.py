"""Reports over pages, readings and retrieval runs: counts, coverage, gates, comparisons, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import pages as rules
from quire.functions.text import character_category, stripped
from quire.operators.joins import containing


def approval(df: DataFrame, group: str, rejected: Column, unclassified: Column) -> DataFrame:
    """Per group: pages required, rejected and unclassified, and whether it is ready, which the last two forbid."""
    counted = df.groupBy(group).agg(F.count("*").alias("required"), F.count_if(rejected).alias("rejected"), F.count_if(unclassified).alias("unclassified"))
    return counted.withColumn("ready", (F.col("rejected") == 0) & (F.col("unclassified") == 0))


def operation_counts(operations: DataFrame) -> DataFrame:
    """Counts of differences by operation, categories of the characters, and the characters."""
    kind = lambda c: character_category(F.coalesce(F.col(c), F.lit("")))
    return operations.groupBy("operation", kind("expected").alias("expected_kind"), kind("found").alias("found_kind"), "expected", "found").agg(F.count("*").alias("n"))


def union_coverage(matched: DataFrame, item: list[str], place: str, chars: str) -> DataFrame:
    """Per item the places that some engine has matched, and how many of its characters none has."""
    return matched.groupBy(*item).agg(F.count_distinct(place).alias("covered")).withColumn("misses", F.col(chars) - F.col("covered"))


def sample_boundary(df: DataFrame, book: str, page: str, pages: str, text: str) -> DataFrame:
    """(book, boundary): the first page of the second half with a sample's mark, else the first with contents or three
    section heads after an afterword; null if there is none. A window is never needed: both are minima."""
    t = rules.compact(F.col(text))
    late = df.filter(F.col(page) >= F.greatest(F.lit(8), F.floor((F.col(pages) + 1) / 2))).select(book, page, t.alias("__t"))
    has = lambda p: F.col("__t").rlike(p)
    marks = late.groupBy(book).agg(F.min(F.when(has(rules.SAMPLE), F.col(page))).alias("__e"), F.min(F.when(has(rules.AFTERWORD), F.col(page))).alias("__a"))
    contents = has(rules.TOC) | (F.regexp_count("__t", F.lit(rules.LATER_SECTION)) >= 3)
    after = late.join(marks, book).filter((F.col(page) > F.col("__a")) & contents).groupBy(book).agg(F.min(page).alias("__c"))
    return df.select(book).distinct().join(marks, book, "left").join(after, book, "left").select(book, F.coalesce("__e", "__c").cast("long").alias("boundary"))


def prose_defects(t: Column) -> dict[str, Column]:
    """Conditions of a generated text: nothing, a code fence, a paragraph or a sentence of twelve characters twice."""
    parts = lambda x, least: F.filter(F.transform(x, stripped), lambda p: F.length(p) >= least)
    twice = lambda a: F.size(a) > F.size(F.array_distinct(a))
    return {
        "empty": stripped(t) == "",
        "fence": F.contains(t, F.lit("```")),
        "same_paragraph": twice(parts(F.split(t, "\n\n"), 1)),
        "same_sentence": twice(parts(F.split(t, "(?<=[.。！？!?])"), 12)),
    }


def log_summary(lines: DataFrame) -> DataFrame:
    """One row about the lines of `readers.search_log`: rates, distinct queries, zero hits, overlap of both result sets (1 for two
    empty ones) and days."""
    ok, n = F.col("kind") == "success", F.count_if(F.col("kind").isin("success", "unavailable", "fallback"))
    union = F.col("fts") + F.col("icu") - F.col("overlap")
    jaccard = F.when(ok, F.when(union == 0, 1.0).otherwise(F.col("overlap") / union))
    rate = lambda kind: F.round(F.try_divide(F.count_if(F.col("kind") == kind).cast("double"), n.cast("double")), 6)
    return lines.agg(
        F.count_if(ok).alias("successes"),
        rate("success").alias("success_rate"),
        rate("fallback").alias("fallback_rate"),
        F.count_if(F.col("kind") == "malformed").alias("malformed"),
        F.count_distinct(F.when(ok, F.col("hash"))).alias("queries"),
        F.count_if(ok & (F.col("fts") == 0)).alias("fts_zero"),
        F.count_if(ok & (F.col("icu") == 0)).alias("icu_zero"),
        F.round(F.avg(jaccard), 6).alias("mean_jaccard"),
        F.round(F.min(jaccard), 6).alias("min_jaccard"),
        F.count_distinct(F.when(ok, F.to_date("ts"))).alias("days"),
    )


def by_all_groups(df: DataFrame, groups: DataFrame, key: str, measures: dict[str, Column]) -> DataFrame:
    """Measures by group for a list of groups, also those without rows, whose counts are 0."""
    got = groups.select(key).distinct().join(df.groupBy(key).agg(*[m.alias(n) for n, m in measures.items()]), key, "left")
    return got.fillna(0, [n for n, t in got.dtypes if n in measures and t in ("bigint", "int")])


def omission_suspects(df: DataFrame, deletions: str, chars: str, geometry: Column, most: int = 10, rate: float = 0.02) -> DataFrame:
    """Rows with more deletions than a number and a rate allow, unless the geometry explains them."""
    return df.filter((F.col(deletions) > most) & (F.col(deletions) > F.col(chars) * rate) & ~F.coalesce(geometry, F.lit(False)))


def column_gaps(df: DataFrame, page: str, x: str, header: int = 1) -> DataFrame:
    """(page, columns, median_gap, worst_ratio): positive gaps between neighbouring columns from the right, the largest but
    the first `header` ones by the median."""
    by = Window.partitionBy(page).orderBy(F.desc(x))
    gaps = df.withColumns({"gap": F.lag(x).over(by) - F.col(x), "k": F.row_number().over(by) - 1}).filter("gap > 0")
    got = gaps.groupBy(page).agg(F.count("*").alias("gaps"), F.median("gap").alias("median_gap"), F.max(F.when(F.col("k") > header, F.col("gap"))).alias("__w"))
    return got.withColumn("worst_ratio", F.round(F.try_divide(F.col("__w"), F.col("median_gap")), 6)).drop("__w")


def confidence(df: DataFrame, group: str, value: str, chars: str, low: float = 0.5) -> DataFrame:
    """Per group the median, the mean weighted by characters, and the share of characters under a limit."""
    n = F.sum(chars).cast("double")
    return df.groupBy(group).agg(F.round(F.median(value), 6).alias("median"), F.round(F.try_divide(F.sum(F.col(value) * F.col(chars)), n), 6).alias("mean"), F.round(F.try_divide(F.sum(F.when(F.col(value) < low, F.col(chars)).otherwise(0)).cast("double"), n), 6).alias("low_share"))


def supported_gaps(proposals: DataFrame, item: str, place: str, text: str, engine: str, support: int = 2) -> DataFrame:
    """Insertions that so many engines propose, one for each place: the most supported, of equals the longest, then the last."""
    counted = proposals.groupBy(item, place, text).agg(F.count_distinct(engine).alias("support")).filter(F.col("support") >= support)
    return counted.groupBy(item, place).agg(F.max(F.struct("support", F.length(text).alias("n"), F.col(text).alias("t"))).alias("b")).select(item, place, F.col("b.t").alias(text), F.col("b.support").alias("support"))


def uniform(df: DataFrame, values: list[str]) -> DataFrame:
    """One row with the values, of which there must be exactly one combination."""
    got = df.select(F.struct(*values).alias("v")).agg(F.min("v").alias("v"), F.max("v").alias("w"))
    checked = got.filter(F.when(F.col("v").eqNullSafe(F.col("w")) & F.col("v").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("values are not uniform")).cast("boolean")))
    return checked.select("v.*")


def split_inventory(runs: DataFrame, held_out: DataFrame, run: str, chars: str) -> DataFrame:
    """Runs, pages and characters in the training and the hold-out part; a held-out run that is not there is an error."""
    named = held_out.select(run).distinct().withColumn("__h", F.lit(True))
    both = runs.join(named, run, "full")
    known = both.filter(F.when(F.col(chars).isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("a held-out run is unknown")).cast("boolean")))
    return known.groupBy(F.when(F.col("__h"), "hold_out").otherwise("train").alias("split")).agg(F.count_distinct(run).alias("runs"), F.count("*").alias("pages"), F.sum(chars).alias("chars"))


def deduplicated(df: DataFrame, digest: str, label: str, order: list[str], excluded: DataFrame) -> DataFrame:
    """The first record of each digest whose records have one label; digests with several labels must be in `excluded`, else
    it is an error, and are left out."""
    got = df.groupBy(digest).agg(F.count_distinct(label).alias("__n"), F.min(F.struct(*order, *[c for c in df.columns if c not in order and c != digest])).alias("__r"))
    got = got.join(excluded.select(digest).distinct().withColumn("__x", F.lit(True)), digest, "left")
    bad = (F.col("__n") > 1) & F.col("__x").isNull()
    kept = got.filter(F.when(bad, F.raise_error(F.lit("labels of one record disagree")).cast("boolean")).otherwise(F.col("__n") == 1))
    return kept.select(digest, *[F.col(f"__r.{c}").alias(c) for c in df.columns if c != digest])


def ordered_digest(df: DataFrame, group: str, order: str, fields: list[str]) -> DataFrame:
    """(group, digest): the digest of a group's rows in order, each field with its length before it."""
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.concat(*[F.concat(F.octet_length(field(c)).cast("string"), F.lit(":"), field(c)) for c in fields])
    lists = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.sha2(row, 256).alias("r")))).alias("l"))
    return lists.select(group, F.sha2(F.array_join(F.transform("l", lambda x: x["r"]), ""), 256).alias("digest"))


def compared(base: DataFrame, challenger: DataFrame, case: str, measures: list[str]) -> DataFrame:
    """Per case the change of each measure, and whether recall fell (a regression) or rose from nothing (a rescue)."""
    a = base.select(case, *[F.col(m).alias(f"base_{m}") for m in measures])
    j = a.join(challenger.select(case, *measures), case)
    return j.select(case, *[F.round(F.col(m) - F.col(f"base_{m}"), 6).alias(f"d_{m}") for m in measures], (F.col("recall") < F.col("base_recall")).alias("regressed"), ((F.col("base_recall") == 0) & (F.col("recall") > 0)).alias("rescued"))


def challenger_gate(base: DataFrame, challenger: DataFrame, case: str, gain: float = 0.05) -> DataFrame:
    """One row: regressions, relative gains of mrr and ndcg, and whether the challenger passes: no regression and one gain
    of 5 per cent at least."""
    j = base.select(case, *[F.col(m).alias(f"b_{m}") for m in ("recall", "mrr", "ndcg")]).join(challenger, case)
    relative = lambda m: F.try_divide(F.avg(m) - F.avg(f"b_{m}"), F.avg(f"b_{m}"))
    got = j.agg(F.count_if(F.col("recall") < F.col("b_recall")).alias("regressions"), F.round(relative("mrr"), 6).alias("mrr_gain"), F.round(relative("ndcg"), 6).alias("ndcg_gain"))
    return got.withColumn("passed", (F.col("regressions") == 0) & (F.greatest(F.coalesce("mrr_gain", F.lit(-1.0)), F.coalesce("ndcg_gain", F.lit(-1.0))) >= gain))


def paired(a: DataFrame, b: DataFrame, key: str, digest: str, values: dict[str, tuple[str, str]]) -> DataFrame:
    """Two sets of predictions side by side; their keys and the digests of their inputs must be the same."""
    j = a.select(key, F.col(digest).alias("__a"), *[F.col(x).alias(f"__x_{n}") for n, (x, _) in values.items()]).join(b.select(key, F.col(digest).alias("__b"), *[F.col(y).alias(f"__y_{n}") for n, (_, y) in values.items()]), key, "full")
    same = F.when(F.col("__a") == F.col("__b"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("predictions do not pair: "), F.col(key).cast("string"))).cast("boolean"))
    return j.filter(same).select(key, *[F.col(f"__{s}_{n}").alias(f"{n}_{s}") for n in values for s in "xy"])


def guarded(report: DataFrame, corpus: DataFrame, key: str, digest: str) -> DataFrame:
    """Report rows with the corpus row of their key; an other digest, or a corpus row that the report lacks, is an error."""
    j = corpus.join(report.withColumnRenamed(digest, "__d"), key, "left")
    return j.filter(F.when(F.col("__d") == F.col(digest), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no such input: "), F.col(key).cast("string"))).cast("boolean"))).drop("__d")


def evidence(aliases: DataFrame, pages: DataFrame, name: str, alias: str, derived: str, page: str, text: str, n: int = 3) -> DataFrame:
    """(name, first_page, pages) of names with evidence: pages whose text has any alias; a derived alias counts only if two
    pages have it. Texts meet only aliases that may be in them (`joins.containing`)."""
    a = aliases.filter(F.length(alias) >= n)
    hits = containing(pages, page, text, a.select(alias).distinct(), alias, n).join(a.hint("merge"), alias).select(name, alias, derived, page).distinct()
    enough = hits.groupBy(name, alias, derived).agg(F.collect_set(page).alias("p")).filter(~F.col(derived) | (F.size("p") >= 2))
    return enough.select(name, F.explode("p").alias(page)).groupBy(name).agg(F.min(page).alias("first_page"), F.count_distinct(page).alias("pages"))


def resolved_references(facts: DataFrame, references: DataFrame, group: str, fact: str, reference: str) -> DataFrame:
    """References with the fact they name: the same id, else the only one of the same number (F1 for F001); null if unresolved."""
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).try_cast("int")
    exact = facts.select(group, F.col(fact).alias(reference), F.col(fact).alias("__e")).distinct()
    by_number = facts.groupBy(group, number(fact).alias("__n")).agg(F.min(fact).alias("__u"), F.count_distinct(fact).alias("__k")).filter("__k = 1").drop("__k")
    j = references.join(exact, [group, reference], "left").withColumn("__n", number(reference)).join(by_number, [group, "__n"], "left")
    return j.withColumn("resolved", F.coalesce("__e", "__u")).drop("__e", "__u", "__n")


def verified(chunks: DataFrame, vectors: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, problem) where rows and their vectors do not agree: missing, stale, or different in a field."""
    a = chunks.select(*key, F.struct(*fields).alias("__a"))
    j = a.join(vectors.select(*key, F.struct(*fields).alias("__b")), key, "full")
    what = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "stale").when(~F.col("__a").eqNullSafe(F.col("__b")), "different")
    return j.select(*key, what.alias("problem")).filter("problem is not null")


def near_neighbours_in_order(df: DataFrame, group: str, order: str, print_: str, digest: str, most: int = 3) -> DataFrame:
    """Rows whose 64-bit print differs from that of the row before in at most so many bits, but whose digest is another."""
    by = Window.partitionBy(group).orderBy(order)
    j = df.withColumns({"__p": F.lag(print_).over(by), "__d": F.lag(digest).over(by)})
    return j.withColumn("distance", F.bit_count(F.col(print_).bitwiseXOR(F.col("__p")))).filter((F.col("distance") <= most) & (F.col(digest) != F.col("__d"))).drop("__p", "__d")


def first_middle_last(df: DataFrame, group: str, page: str, pages: str, workers: int) -> DataFrame:
    """The first, middle and last page of each group, once each, dealt to workers in turn."""
    wanted = F.array_distinct(F.array(F.lit(1).cast("long"), F.floor((F.col(pages) + 1) / 2), F.col(pages).cast("long")))
    picks = df.select(group, pages).distinct().select(group, F.explode(wanted).alias(page))
    return picks.withColumn("worker", ((F.row_number().over(Window.orderBy(group, page)) - 1) % workers).cast("int"))


def review_queue(df: DataFrame, similarity: str, proposals: str, least: float = 0.98) -> DataFrame:
    """Rows to review with reasons and a priority: the least similar first, then those with most proposals."""
    low, some = F.col(similarity) < least, F.col(proposals) >= 1
    reasons = F.array_compact(F.array(F.when(low, F.lit("low_similarity")), F.when(some, F.lit("proposals"))))
    return df.filter(low | some).withColumn("reasons", F.array_join(reasons, ",")).orderBy(similarity, F.desc(proposals))


def budgeted(evidence: DataFrame, book: str, claim: str, page: str, chars: str, most: int = 64, budget: int = 90_000, first: int = 2) -> DataFrame:
    """(book, page) of the evidence that is used: the first pages of each claim in any case, then by the number of claims and
    the page, up to so many pages, leaving out what exceeds the budget of characters. A book's pages are one row while they
    are chosen."""
    by = Window.partitionBy(book, claim).orderBy(page)
    ranked = evidence.withColumn("__k", F.row_number().over(by))
    pages = ranked.groupBy(book, page).agg(F.min("__k").alias("k"), F.count_distinct(claim).alias("n"), F.first(chars).alias("c"))
    lists = pages.groupBy(book).agg(F.array_sort(F.collect_list(F.struct((F.col("k") > first).alias("later"), (-F.col("n")).alias("n"), F.col(page).alias("p"), F.col("c").alias("c")))).alias("l"))
    start = F.struct(F.array().cast(f"array<{evidence.schema[page].dataType.simpleString()}>").alias("pages"), F.lit(0).cast("long").alias("used"))

    def add(s: Column, x: Column) -> Column:
        fits = ~x["later"] | ((F.size(s["pages"]) < most) & (s["used"] + x["c"] <= budget))
        return F.when(fits, F.struct(F.array_append(s["pages"], x["p"]).alias("pages"), (s["used"] + x["c"]).alias("used"))).otherwise(s)

    return lists.select(book, F.explode(F.aggregate("l", start, add)["pages"]).alias(page))
