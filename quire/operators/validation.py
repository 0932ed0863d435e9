"""Strict checks of generated JSON: what is wrong becomes rows of a table, not an exception.

JSON is held as VARIANT, whose parser takes no repeated key and no number that is not finite; keys are compared as exact
sets, kinds by the variant's own schema, so true is no number and "1" is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.shared import stored

#: What a fact may say. Fixed values.
TEMPORALITIES = ("past", "current", "future", "conditional", "unknown")
CERTAINTIES = ("fact", "inference", "unknown")
FACT_SCHEMA = "sol-fact-graph-v1"
FENCE = r"(?s)^\s*```json[ \t]*\r?\n(.*?)\r?\n```\s*$"
SPACES = r"(?U)\s+"


def strict_object(text: Column, most: int = 1 << 20) -> Column:
    """The VARIANT of a JSON object that stands alone or in one fence marked json; null for anything else: a repeated
    key, NaN or an infinity, text around it, a value of another kind, or more than `most` characters."""
    inner = F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text)
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), inner, F.lit("]"))), "$", "array<variant>")
    value = F.when((F.length(text) <= most) & (F.size(alone) == 1), F.get(alone, 0))
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), value)


def normalized_object(text: Column, most: int = 1 << 20) -> Column:
    """The compact text of a strict object, keys in order; null if it is none."""
    return F.to_json(strict_object(text, most))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("none"))


def _keys(v: Column) -> Column:
    return F.array_sort(F.map_keys(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))))


def _has_keys(v: Column, *names: str) -> Column:
    return F.startswith(_kind(v), F.lit("OBJECT")) & (_keys(v) == F.array(*map(F.lit, sorted(names))))


def _first(*cases: tuple[Column, str]) -> Column:
    """The name of the first case that holds; a null condition holds not."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(cases):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def quote_answers(answers: DataFrame, sources: DataFrame, key: str, raw: str, source: str, text: str, most: int = 16_384, quotes: int = 4, longest: int = 500) -> tuple[DataFrame, DataFrame]:
    """Answers {status, evidence: [{source_id, quote}]} against their sources: (problems, spans).

    problems has (key, place, problem), place null for the answer as a whole; an answer without a row is valid. spans has
    (key, place, source, start, stop) for each quote that is found: a quote is a span of its source if the two agree
    without white space, and must be there once. Only the sources that are named are joined.
    """
    v = answers.select(F.col(key), F.col(raw).alias("__raw"), strict_object(F.col(raw), most).alias("__v"))
    status, evidence = F.try_variant_get("__v", "$.status", "variant"), F.try_variant_get("__v", "$.evidence", "variant")
    v = v.withColumns({"__s": F.when(_kind(status) == "STRING", F.try_variant_get("__v", "$.status", "string")), "__k": _kind(evidence), "__e": F.try_variant_get("__v", "$.evidence", "array<variant>")})
    n = F.coalesce(F.size("__e"), F.lit(0))
    whole = _first(
        (F.col("__raw").isNull() | (F.trim("__raw") == "") | (F.length("__raw") > most), "empty or oversized"),
        (F.col("__v").isNull(), "no strict object"),
        (~_has_keys(F.col("__v"), "status", "evidence"), "answer keys"),
        (~F.coalesce(F.col("__s").isin("found", "not_found"), F.lit(False)) | ~F.startswith("__k", F.lit("ARRAY")), "status or evidence"),
        ((F.col("__s") == "not_found") & (n > 0), "evidence of not_found"),
        ((F.col("__s") == "found") & ~n.between(1, quotes), "number of quotes"),
    )
    v = v.withColumn("__p", whole)
    items = v.filter("__p is null").select(key, F.posexplode("__e").alias("place", "__i"))
    id_, quote = F.try_variant_get("__i", "$.source_id", "variant"), F.try_variant_get("__i", "$.quote", "variant")
    items = items.withColumns({"__id": F.when(_kind(id_) == "BIGINT", F.try_variant_get("__i", "$.source_id", "bigint")), "__q": F.when(_kind(quote) == "STRING", F.try_variant_get("__i", "$.quote", "string")), "__fine": _has_keys(F.col("__i"), "source_id", "quote")}).drop("__i")
    items, heads = stored(items, "items"), stored(v.filter("__p is not null").select(key, "__p"), "answers")  # JSON is parsed for these alone
    j = items.join(sources.select(F.col(source).cast("bigint").alias("__id"), F.col(text).alias("__t")), "__id", "left")
    needle, hay = F.regexp_replace("__q", SPACES, ""), F.regexp_replace("__t", SPACES, "")
    j = j.withColumns({"__n": needle, "__h": hay}).withColumn("__at", F.expr("locate(__n, __h)"))
    problem = _first(
        (~F.col("__fine"), "evidence keys"),
        (F.col("__id").isNull() | F.col("__t").isNull(), "source"),
        (F.col("__q").isNull() | ~F.length("__q").between(1, longest), "quote length"),
        (F.col("__n") == "", "empty quote"),
        (F.col("__at") == 0, "quote is not in its source"),
        (F.expr("locate(__n, __h, __at + 1)") > 0, "quote is there more than once"),
    )
    j = j.withColumn("__p", problem)
    same = F.row_number().over(Window.partitionBy(key, "__id", "__n").orderBy("place"))
    j = j.withColumn("__p", F.when(F.col("__p").isNull() & (same > 1), "duplicate quote").otherwise(F.col("__p")))
    problems = heads.select(key, F.lit(None).cast("int").alias("place"), F.col("__p").alias("problem")).unionByName(j.filter("__p is not null").select(key, "place", F.col("__p").alias("problem")))
    chars = F.split("__t", "")
    solid = F.filter(F.sequence(F.lit(1), F.length("__t")), lambda i: ~F.get(F.col("__c"), i - 1).rlike(r"(?U)^\s$"))
    spans = j.filter("__p is null").withColumn("__c", chars).withColumn("__w", solid)
    start, stop = F.element_at("__w", F.col("__at")) - 1, F.element_at("__w", F.col("__at") + F.length("__n") - 1)
    return problems, spans.select(key, "place", F.col("__id").alias(source), start.alias("start"), stop.alias("stop"))


def fact_graphs(graphs: DataFrame, pages: DataFrame, key: str, raw: str, page: str, text: str, roles: tuple[str, ...], shortest: int = 20, longest: int = 120) -> DataFrame:
    """Problems (key, fact, problem) of graphs {schema_version, facts: [{fact_id, subject, action, temporality, certainty,
    actors, evidence, related_fact_ids}]} against the pages (key, page, text) of their books; fact is the place of a fact,
    null for a graph as a whole. A fact may have several; a graph without a row is valid. Evidence are exact quotes."""
    g = graphs.select(key, strict_object(F.col(raw), 1 << 30).alias("__v"))
    g = g.withColumns({"__f": F.try_variant_get("__v", "$.facts", "array<variant>"), "__s": F.try_variant_get("__v", "$.schema_version", "string")})
    whole = _first((F.col("__v").isNull(), "no strict object"), (~F.coalesce(F.col("__s") == FACT_SCHEMA, F.lit(False)), "schema version"), (F.coalesce(F.size("__f"), F.lit(0)) < 1, "no facts"))
    g = g.withColumn("__p", whole)
    get = lambda name, kind: F.try_variant_get("__x", f"$.{name}", kind)
    is_text = lambda name: (_kind(get(name, "variant")) == "STRING") & (F.trim(get(name, "string")) != "")
    f = g.filter("__p is null").select(key, F.posexplode("__f").alias("fact", "__x"))
    f = f.withColumns({"__id": get("fact_id", "string"), "__actors": get("actors", "array<variant>"), "__evidence": get("evidence", "array<variant>"), "__related": get("related_fact_ids", "array<variant>")}).withColumn("__links", F.transform("__related", lambda r: F.when(_kind(r) == "STRING", F.try_variant_get(r, "$", "string"))))
    named = F.when(F.coalesce(F.col("__id"), F.lit("")) != "", F.col("__id"))
    repeated = (F.row_number().over(Window.partitionBy(key, "__id").orderBy("fact")) > 1) | named.isNull()
    actor = lambda a: (_kind(F.try_variant_get(a, "$.name", "variant")) == "STRING") & (F.trim(F.try_variant_get(a, "$.name", "string")) != "") & F.coalesce(F.try_variant_get(a, "$.role", "string").isin(*roles), F.lit(False))
    holds = lambda c: F.coalesce(c, F.lit(False))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    checks = {
        "fact id": repeated,
        "subject": ~holds(is_text("subject")),
        "action": ~holds(is_text("action")),
        "temporality": ~holds(get("temporality", "string").isin(*TEMPORALITIES)),
        "certainty": ~holds(get("certainty", "string").isin(*CERTAINTIES)),
        "actors": (size("__actors") < 1) | ~holds(F.forall("__actors", lambda a: holds(actor(a)))),
        "evidence": size("__evidence") < 1,
        "links": F.col("__related").isNull() | F.exists("__links", lambda x: x.isNull()),
        "link to itself": holds(F.array_contains(F.array_compact("__links"), F.col("__id"))),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    item = lambda name, kind: (lambda q: F.try_variant_get(q, f"$.{name}", kind))
    quote = lambda q: F.struct(F.when(_kind(item("page_no", "variant")(q)) == "BIGINT", item("page_no", "bigint")(q)).alias("page"), F.when(_kind(item("quote", "variant")(q)) == "STRING", item("quote", "string")(q)).alias("quote"))
    f = stored(f.select(key, "fact", "__id", "__links", F.transform("__evidence", quote).alias("__quotes"), found.alias("__p")), "facts")  # JSON is parsed for this alone
    own = f.select(key, "fact", F.explode("__p").alias("problem"))
    ids = f.select(key, F.col("__id").alias("__link")).distinct()
    unknown = f.select(key, "fact", F.explode(F.array_compact("__links")).alias("__link")).join(ids, [key, "__link"], "left_anti").select(key, "fact").distinct().withColumn("problem", F.lit("unknown link"))
    quotes = f.select(key, "fact", F.explode("__quotes").alias("__q")).select(key, "fact", F.col("__q.page").alias("__page"), F.col("__q.quote").alias("__quote"))
    j = quotes.join(pages.select(key, F.col(page).cast("bigint").alias("__page"), F.col(text).alias("__t")), [key, "__page"], "left")
    wrong = _first((F.col("__t").isNull(), "page"), (F.col("__quote").isNull() | ~F.length("__quote").between(shortest, longest), "quote length"), (~F.contains("__t", F.col("__quote")), "quote is not in its page"))
    bad = j.withColumn("problem", wrong).filter("problem is not null").select(key, "fact", "problem").distinct()
    of_graph = g.filter("__p is not null").select(key, F.lit(None).cast("int").alias("fact"), F.col("__p").alias("problem"))
    return of_graph.unionByName(own).unionByName(unknown).unionByName(bad)
