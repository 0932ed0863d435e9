"""Replies of models as rows: relations, fact sheets, and judgements of claims. Texts are taken apart by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.validation import strict_object
from quire.sources.shared import stored

#: Marks of a fact sheet, and what says that there is none. Fixed values.
BOOK = r"(?s)\[BOOK_FACTS\](.*?)(?=\[CHARACTER_FACT:|$)"
CHARACTER = r"(?s)\[CHARACTER_FACT:([^\]]+)\](.*?)(?=\[CHARACTER_FACT:|$)"
NOTHING = r"^[（(]?\s*(?:該当(?:する)?事実|該当|関連事実|事実|言及|登場)(?:は|が)?(?:なし|ない|ありません)(?:[：:。、）)\s]|$)"
VERDICTS = ("supported", "contradicted", "unsupported")
LONGEST_RELATION = 20


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def unfenced(x: Column) -> Column:
    """A text without code fences: if it has one, only the lines between fences."""
    lines = F.split(x, r"\r\n|\n|\r")
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def add(s: Column, line: Column) -> Column:
        fence = F.startswith(line, F.lit("```"))
        kept = F.when(~fence & s["inside"], F.concat(s["kept"], F.array(line))).otherwise(s["kept"])
        return F.struct((s["inside"] != fence).alias("inside"), kept.alias("kept"))

    return F.when(F.contains(x, F.lit("```")), F.array_join(F.aggregate(lines, start, add)["kept"], "\n")).otherwise(x)


def relation_pairs(df: DataFrame, key: str, response: str) -> DataFrame:
    """(key, place, a, b, relation) of replies that are arrays of objects; what is none gives no rows, nor do pairs with a part
    that is blank or twice the same. A relation has 20 characters at most."""
    rows = df.select(key, F.posexplode(F.try_variant_get(F.try_parse_json(unfenced(F.col(response))), "$", "array<variant>")).alias("place", "v"))
    text = lambda name: stripped(F.coalesce(F.try_variant_get("v", f"$.{name}", "string"), F.lit("")))
    got = rows.select(key, "place", text("char_a").alias("a"), text("char_b").alias("b"), F.substring(text("relation"), 1, LONGEST_RELATION).alias("relation"))
    return got.filter("a <> '' and b <> '' and relation <> '' and a <> b")


def rewritten_relations(old: DataFrame, counts: DataFrame, labels: DataFrame, book: str) -> DataFrame:
    """(book, a, b, relation, weight): the relations of the books that have counts or labels written anew, those of others as they
    are. counts is (book, a, b, n) with a < b; labels (book, place, a, b, relation) in any order of a and b, of which the last of
    a pair holds; a pair that has a label alone weighs 0."""
    ordered = labels.select(book, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "place", "relation", F.lit(None).cast("long").alias("n"))
    counted = counts.select(book, "a", "b", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("relation"), F.col("n").cast("long").alias("n"))
    pairs = ordered.unionByName(counted).groupBy(book, "a", "b").agg(F.max_by("relation", "place").alias("relation"), F.sum("n").alias("n"))
    new = pairs.select(book, "a", "b", "relation", F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("weight"))
    books = labels.select(book).unionByName(counts.select(book)).distinct()
    # as many books as replies, in files so small that they would be taken for a table to broadcast
    return old.join(books.hint("merge"), book, "left_anti").unionByName(new)


def fact_sheets(df: DataFrame, key: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """(book facts, character facts) of sheets with marks: (key, facts) and (key, place, name, facts). Facts that say that there
    are none are left out, as are blank ones."""
    book = df.select(*key, stripped(F.regexp_extract(text, BOOK, 1)).alias("facts"))
    names, bodies = (F.regexp_extract_all(text, F.lit(CHARACTER), F.lit(i)) for i in (1, 2))
    rows = df.select(*key, F.posexplode(F.arrays_zip(names.alias("name"), bodies.alias("body"))).alias("place", "x"))
    found = rows.select(*key, "place", stripped(F.col("x.name")).alias("name"), stripped(F.col("x.body")).alias("facts"))
    return book, found.filter((F.col("name") != "") & (F.col("facts") != "") & ~F.col("facts").rlike(NOTHING))


def merged_sheets(books: DataFrame, characters: DataFrame, group: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Sheets of a group in order as one: (group, facts) with a blank line between blocks, and (group, name, facts)."""

    def joined(rows: DataFrame, by: list[str], at: list[str], between: str) -> DataFrame:
        lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*at, "facts"))).alias("l"))
        return lists.select(*by, F.array_join(F.transform("l", lambda x: x["facts"]), between).alias("facts"))

    return joined(books.filter("facts <> ''"), [group], [order], "\n\n"), joined(characters, [group, "name"], [order, "place"], "\n")


def claim_judgements(df: DataFrame, key: str, response: str, claims: str, pages: str) -> tuple[DataFrame, DataFrame]:
    """(judgements, problems) of replies {claims: [{id, verdict, evidence_pages, reason}], coverage: {verdict, missing_facts}}.

    `claims` is the number of claims of a row, `pages` the array of pages that may be cited. judgements: (key, id, verdict,
    pages, reason, passed), passed being that of the whole reply; a reply with a problem has none. problems: (key, id, problem)."""
    v = df.select(key, F.col(claims).alias("__n"), F.col(pages).alias("__pages"), strict_object(F.col(response)).alias("__v"))
    v = v.withColumns({"__c": F.try_variant_get("__v", "$.claims", "array<variant>"), "__cv": F.try_variant_get("__v", "$.coverage.verdict", "string"), "__m": F.try_variant_get("__v", "$.coverage.missing_facts", "array<variant>")})
    missing = F.size("__m")
    whole = (
        F.when(F.col("__v").isNull(), "no strict object")
        .when(F.col("__c").isNull(), "claims")
        .when(F.col("__m").isNull() | ~F.coalesce(F.col("__cv").isin("pass", "fail"), F.lit(False)), "coverage")
        .when((F.col("__cv") == "pass") & (missing > 0), "pass with missing facts")
        .when((F.col("__cv") == "fail") & (missing == 0), "fail without missing facts")
    )
    v = v.withColumn("__p", whole)
    one = v.filter("__p is null").select(key, "__n", "__pages", "__cv", F.posexplode("__c").alias("__place", "__x"))
    get = lambda name, kind: F.try_variant_get("__x", f"$.{name}", kind)
    integer = F.when(F.schema_of_variant(get("id", "variant")) == "BIGINT", get("id", "bigint"))
    one = one.select(key, "__n", "__pages", "__cv", "__place", integer.alias("id"), get("verdict", "string").alias("verdict"), get("evidence_pages", "array<bigint>").alias("cited"), stripped(F.coalesce(get("reason", "string"), F.lit(""))).alias("reason"))
    again = F.row_number().over(Window.partitionBy(key, "id").orderBy("__place")) > 1
    problem = (
        F.when(F.col("id").isNull() | ~F.col("id").between(1, F.col("__n")) | again, "claim id")
        .when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "verdict")
        .when(F.col("cited").isNull(), "evidence pages")
        .when(F.size(F.array_except("cited", "__pages")) > 0, "page outside")
        .when((F.col("verdict") == "supported") & (F.size("cited") == 0), "no evidence page")
        .when(F.col("reason") == "", "no reason")
    )
    one = stored(one.withColumn("problem", problem).drop("__place"), "judgements")  # JSON is parsed for these two tables alone
    v = stored(v.select(key, "__n", "__p"), "replies")
    given = one.filter("problem is null").select(key, "id")
    asked = v.filter("__p is null and __n > 0").select(key, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n").cast("bigint"))).alias("id"))
    omitted = asked.join(given, [key, "id"], "left_anti").join(one.filter("problem is not null").select(key).distinct(), key, "left_anti").withColumn("problem", F.lit("omitted"))
    none = F.lit(None).cast("bigint")
    problems = v.filter("__p is not null").select(key, none.alias("id"), F.col("__p").alias("problem")).unionByName(one.filter("problem is not null").select(key, "id", "problem")).unionByName(omitted)
    good = one.join(problems.select(key).distinct(), key, "left_anti")
    passed = F.min(((F.col("verdict") == "supported") & (F.col("__cv") == "pass")).cast("int")).over(Window.partitionBy(key)) == 1
    return good.select(key, "id", "verdict", F.col("cited").alias("pages"), "reason", passed.alias("passed")), problems


def discussion_checks(turns: DataFrame, key: str, place: str, speaker: str, text: str, segment: str, needed: list[str], least: int, most: int, turn_most: int, leaks: str) -> DataFrame:
    """(key, check, passed): the length of all turns, the segments that must come, two speakers and no turn too long, and nothing
    that `leaks` matches."""
    got = turns.groupBy(key).agg(F.sum(F.length(text)).alias("chars"), F.collect_set(segment).alias("segments"), F.count_distinct(speaker).alias("speakers"), F.max(F.length(text)).alias("longest"), F.count_if(F.col(text).rlike(leaks)).alias("leaks"))
    checks = {
        "length": F.col("chars").between(least, most),
        "segments": F.size(F.array_except(F.array(*map(F.lit, needed)), F.col("segments"))) == 0,
        "speakers": (F.col("speakers") >= 2) & (F.col("longest") <= turn_most),
        "leaks": F.col("leaks") == 0,
    }
    return got.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()])))
