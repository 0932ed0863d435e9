"""Queries of page judgements, chunking, alignment and prose checks, over documents as pages and turns as readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import pages as rules
from quire.functions import sequential, text
from quire.operators import reports
from quire.plans.adapters import PAGES_SQL, pages
from quire.plans.registry import query
from quire.session import table

WITH_PAGES = f"WITH pages_ AS ({PAGES_SQL})"
#: A page's text with markers; the same expression in both SQLs.
MARKED = """CASE page_no % 7 WHEN 0 THEN 'もくじ ' || full_text WHEN 1 THEN '第1章 第2章 第3章' || full_text WHEN 2 THEN '序章 ' || full_text WHEN 3 THEN 'ISBN 奥付 ' || full_text
    WHEN 4 THEN book WHEN 5 THEN full_text || ' ISBN' ELSE full_text END"""
COMPACT = "regexp_replace({}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', '', 'g')"
KIND = f"""CASE WHEN page_no <= greatest(12, page_count // 8) AND (regexp_matches(t, '{rules.TOC}') OR len(regexp_extract_all(t, '{rules.SECTION}')) >= 3) THEN 'toc' WHEN n >= 300 AND regexp_matches(t, '{rules.NARRATIVE_START}') THEN 'narrative'
    WHEN len(regexp_extract_all(t, '{rules.COLOPHON}')) >= 2 OR (page_no >= greatest(1, page_count - greatest(8, page_count // 10)) AND len(regexp_extract_all(t, '{rules.COLOPHON}')) >= 1 AND n < 1200) THEN 'colophon_or_ad'
    WHEN n < 30 OR (page_no <= 3 AND n < 200) THEN 'illustration' WHEN n >= 300 THEN 'narrative' ELSE 'unknown' END"""
WITH_KINDS = f"{WITH_PAGES}, m AS (SELECT page_id, book, page_no, page_count, {MARKED} AS t FROM pages_), c AS (SELECT *, length({COMPACT.format('t')}) AS n FROM m), k AS (SELECT *, {KIND} AS kind FROM c)"


def marked(spark, d):
    return pages(spark, d).select("page_id", "book", "page_no", "page_count", F.expr(MARKED).alias("t"))


def kinds(spark, d):
    return marked(spark, d).withColumn("kind", rules.page_type(F.col("page_no"), F.col("page_count"), F.col("t"), F.lit(0)))


@query(f"{WITH_KINDS} SELECT page_id, kind, kind = 'narrative' AS eligible FROM k")
def page_type_classifier(spark, d):
    return kinds(spark, d).select("page_id", "kind", rules.index_eligible(F.col("kind")).alias("eligible"))


@query(f"{WITH_KINDS} SELECT kind, count(*) AS pages, count(*) FILTER (kind = 'unknown') AS unclassified, CAST(sum(n) AS BIGINT) AS chars FROM k GROUP BY 1")
def page_type_counts(spark, d):
    return kinds(spark, d).groupBy("kind").agg(F.count("*").alias("pages"), F.count_if(F.col("kind") == "unknown").alias("unclassified"), F.sum(F.length(rules.compact(F.col("t")))).alias("chars"))


@query(f"{WITH_KINDS} SELECT book, count(*) AS required, count(*) FILTER (kind = 'toc') AS rejected, count(*) FILTER (kind = 'unknown') AS unclassified, count(*) FILTER (kind = 'toc') = 0 AND count(*) FILTER (kind = 'unknown') = 0 AS ready FROM k GROUP BY 1")
def approval_check(spark, d):
    return reports.approval(kinds(spark, d), "book", F.col("kind") == "toc", F.col("kind") == "unknown")


HTML = """CASE page_no % 5 WHEN 0 THEN '<div data-label="Table" data-bbox="0 0 900 900">' WHEN 1 THEN '<div data-label="Text" data-bbox="0 0 700 900">' WHEN 2 THEN '<div data-label="Picture" data-bbox="0 0 x 900">'
    WHEN 3 THEN '<div data-label="Text" data-bbox="0 0 700 900"></div><div data-label="Text" data-bbox="10 0 760 900">' ELSE '' END || '</div>'"""


@query(
    f"""{WITH_KINDS} SELECT page_id, CASE WHEN kind = 'toc' OR page_no % 5 = 0 THEN 'structured' WHEN kind IN ('illustration', 'colophon_or_ad') AND n < 80 THEN 'image_only' WHEN page_no % 5 = 2 AND n >= 30 THEN 'mixed_illustration'
    WHEN n >= 100 AND page_no % 5 = 1 THEN 'full_width' WHEN n >= 300 THEN 'normal_prose' WHEN n < 30 THEN 'image_only' ELSE 'unknown' END AS layout FROM k"""
)
def layout_classifier(spark, d):
    k = kinds(spark, d)
    return k.select("page_id", rules.layout_type(F.expr(HTML), F.col("t"), F.lit(0), F.col("kind")).alias("layout"))


LINES = "list_filter(list_transform(regexp_split_to_array({x}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: {c}), lambda l: length(regexp_replace(l, '[^\\pL\\pN_]', '', 'g')) >= 10)"


def _repetition_sql(rows: str, key: str, x: str) -> str:
    """SQL: (key, again) by counting lines, neighbouring lines and 12-grams in groups."""
    content = lambda v: f"regexp_replace({v}, '[^\\pL\\pN_]', '', 'g')"
    lines = LINES.format(x=x, c=COMPACT.format("l"))
    return f"""l_ AS (SELECT {key} AS k, {lines} AS ls FROM {rows}), l1 AS (SELECT k, unnest(ls) AS v FROM l_), l2 AS (SELECT k, unnest([ls[i] || ls[i + 1] FOR i IN range(1, len(ls))]) AS v FROM l_),
    g_ AS (SELECT {key} AS k, {content(x)} AS c FROM {rows}), g1 AS (SELECT k, unnest([substr(c, i, 12) FOR i IN range(1, length(c) - 10)]) AS v FROM g_),
    bad AS (SELECT k FROM l1 GROUP BY k, v HAVING count(*) >= 3 OR (count(*) >= 2 AND length({content("v")}) >= 40) UNION SELECT k FROM l2 WHERE length({content("v")}) >= 40 GROUP BY k, v HAVING count(*) >= 2 UNION SELECT k FROM g1 GROUP BY k, v HAVING count(*) >= 8)"""


@query(f"WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), {_repetition_sql('d', 'doc_id', 'x')} SELECT doc_id, doc_id IN (SELECT k FROM bad) AS repeats FROM d")
def repetition_audit(spark, d):
    return table(spark, d, "documents").select("doc_id", rules.has_repetition(F.col("text")).alias("repeats"))


#: Two readings of a page: the text and one that lacks, doubles or changes something.
EXTERNAL = "CASE doc_id % 4 WHEN 0 THEN text || text WHEN 1 THEN substr(text, 1, 100) WHEN 2 THEN text || ' ChatGPT' ELSE text END"


@query(
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS p, coalesce({EXTERNAL}, '') AS e FROM documents), u AS (SELECT doc_id, p AS x FROM d UNION ALL SELECT -1 - doc_id, e FROM d), {_repetition_sql('u', 'doc_id', 'x')},
    n AS (SELECT doc_id, p, e, length({COMPACT.format('p')}) AS np, length({COMPACT.format('e')}) AS ne, doc_id IN (SELECT k FROM bad) AS rp, -1 - doc_id IN (SELECT k FROM bad) AS re FROM d)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN np < 30 AND greatest(np, ne) >= 300 THEN 'candidate_content_conflict' END, CASE WHEN re THEN 'external_text_repetition' END, CASE WHEN rp THEN 'primary_text_repetition' END, CASE WHEN rp THEN 'selected_text_repetition' END,
        CASE WHEN contains(lower({COMPACT.format('e')}), 'chatgpt') THEN 'ui_overlay_text_detected' END, CASE WHEN np > 0 AND ne > 0 AND {COMPACT.format('p')} <> {COMPACT.format('e')} AND np >= 256 AND ne - np >= 30 AND ne >= np * 1.02 THEN 'unselected_external_candidate_more_complete' END], lambda f: f IS NOT NULL), ',') AS flags,
        rp AND ne >= 256 AND NOT re AS fallback FROM n"""
)
def risk_flags(spark, d):
    p = table(spark, d, "documents").select("doc_id", "text", F.expr(EXTERNAL).alias("e"))
    p = p.select("*", rules.compact(F.col("text")).alias("ct"), rules.compact(F.col("e")).alias("ce"))
    flags = rules.risk_flags(F.lit("narrative"), F.col("text"), F.lit(0), F.col("text"), F.col("e"), (F.col("ct"), F.col("ct"), F.col("ce")))
    return p.select("doc_id", F.array_join(flags, ",").alias("flags"), rules.repetition_fallback(F.col("text"), F.col("e"), F.col("ce")).alias("fallback"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN lang ELSE source END AS selected FROM documents")
def selected_texts(spark, d):
    engine = F.element_at(F.array(F.lit("primary"), F.lit("external"), F.lit("corrected")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", rules.selected_text(engine, F.col("text"), F.col("lang"), F.col("source")).alias("selected"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * 20 < l_extendedprice / 90 AND l_extendedprice / 90 <= 1000 AND l_linenumber < l_quantity AS valid FROM lineitem")
def box_validity(spark, d):
    q, p, n = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.valid_box(q * 20, n, p / 90, q).alias("valid"))


NOISY = "CASE turn % 2 WHEN 0 THEN text || ' ... ' || text ELSE replace(text, ' ', '  ') END"


@query(f"SELECT conv_id, turn, {COMPACT.format('replace(' + NOISY + chr(44) + ' chr(46) || chr(46) || chr(46), chr(8230))')} AS strict, {COMPACT.format(NOISY)} AS simple FROM conversations")
def metric_texts(spark, d):
    x = F.expr(NOISY)
    return table(spark, d, "conversations").select("conv_id", "turn", text.metric_text(x).alias("strict"), text.metric_text_simple(x).alias("simple"))


@query(
    """WITH c AS (SELECT unnest(string_split(text || 'ぁ、漢カ', '')) AS c FROM benchmark)
    SELECT CASE WHEN c = 'ぁ' THEN 'small_kana' WHEN regexp_matches(c, '^\\pP$') OR c = '~' THEN 'punctuation' WHEN c = '漢' THEN 'kanji' WHEN c = 'カ' THEN 'kana' WHEN regexp_matches(c, '^[A-Za-z0-9]$') THEN 'ascii_or_digit' ELSE 'other' END AS category, count(*) AS n FROM c GROUP BY 1"""
)
def character_categories(spark, d):
    c = table(spark, d, "benchmark").select(F.explode(F.split(F.concat("text", F.lit("ぁ、漢カ")), "")).alias("c")).filter("c <> ''")
    return c.groupBy(text.character_category(F.col("c")).alias("category")).agg(F.count("*").alias("n"))


@query()
def page_chunks(spark, d):
    """Chunks of every page; held against a plain cutter in tests."""
    return sequential.chunked(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query()
def book_chunks(spark, d):
    """Chunks of conversations as books of turns, across their pages."""
    return sequential.chunked_books(table(spark, d, "conversations"), "conv_id", "turn", "text", 300, 40)


@query("SELECT conv_id, turn, role || chr(10) || chr(10) || text AS input, length(role) + 2 + length(text) AS chars FROM conversations WHERE length(text) >= 30")
def embedding_inputs(spark, d):
    c = table(spark, d, "conversations").filter(F.length("text") >= 30)
    x = F.concat_ws("\n\n", "role", "text")
    return c.select("conv_id", "turn", x.alias("input"), F.length(x).cast("long").alias("chars"))


@query()
def edit_histogram(spark, d):
    """Counts of edit operations between each item and a changed copy; held against a plain table in tests."""
    b = table(spark, d, "benchmark").select("item_id", "text", F.regexp_replace(F.concat(F.lit("x"), F.col("text")), "th", "t").alias("other"))
    return reports.operation_counts(sequential.operations(b, "item_id", "text", "other"))


@query(
    """WITH b AS (SELECT item_id, 100 + item_id % 5 AS chars, ['a', 'b', 'c'][1 + item_id % 3] AS best, unnest(['a', 'b', 'c']) AS engine FROM benchmark), p AS (SELECT item_id, chars, engine, unnest(range(chars)) AS place FROM b),
    m AS (SELECT * FROM p WHERE (place + ascii(engine) + item_id) % 3 > 0) SELECT item_id, chars, count(DISTINCT place) AS covered, chars - count(DISTINCT place) AS misses FROM m GROUP BY 1, 2"""
)
def union_coverage(spark, d):
    b = table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 5 + 100).alias("chars"), F.explode(F.array(*map(F.lit, "abc"))).alias("engine"))
    m = b.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chars") - 1))).filter((F.col("place") + F.ascii("engine") + F.col("item_id")) % 3 > 0)
    return reports.union_coverage(m, ["item_id", "chars"], "place", "chars")


@query(
    f"""{WITH_PAGES}, s AS (SELECT book, page_no, page_count, CASE page_no % 11 WHEN 3 THEN '試 し 読 み 版' WHEN 5 THEN '奥付' WHEN 6 THEN 'もくじ' ELSE 'x' END AS t FROM pages_),
    l AS (SELECT book, page_no, regexp_replace(t, '\\s', '', 'g') AS t FROM s WHERE page_no >= greatest(8, (page_count + 1) // 2)),
    e AS (SELECT book, min(page_no) AS p FROM l WHERE regexp_matches(t, '{rules.SAMPLE}') GROUP BY 1), a AS (SELECT book, min(page_no) AS p FROM l WHERE regexp_matches(t, '{rules.AFTERWORD}') GROUP BY 1),
    c AS (SELECT l.book, min(l.page_no) AS p FROM l JOIN a ON a.book = l.book AND l.page_no > a.p WHERE regexp_matches(t, '{rules.TOC}') GROUP BY 1)
    SELECT b.book, coalesce(e.p, c.p) AS boundary FROM (SELECT DISTINCT book FROM pages_) b LEFT JOIN e ON e.book = b.book LEFT JOIN c ON c.book = b.book"""
)
def sample_boundaries(spark, d):
    t = F.when(F.col("page_no") % 11 == 3, "試 し 読 み 版").when(F.col("page_no") % 11 == 5, "奥付").when(F.col("page_no") % 11 == 6, "もくじ").otherwise("x")
    return reports.sample_boundary(pages(spark, d).select("book", "page_no", "page_count", t.alias("t")), "book", "page_no", "page_count", "t")


PROSE = "CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '```' || text WHEN 2 THEN 'A long enough line. A long enough line.' WHEN 3 THEN 'same' || chr(10) || chr(10) || 'same' ELSE text END"


@query(
    f"""WITH p AS (SELECT doc_id, {PROSE} AS t FROM documents), g AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps, list_filter(list_transform(regexp_split_to_array(regexp_replace(t, '([.。！？!?])', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: length(x) >= 12) AS ss, t FROM p)
    SELECT doc_id, trim(t, ' ' || chr(10) || chr(9) || chr(13)) = '' AS empty, contains(t, '```') AS fence, len(ps) > len(list_distinct(ps)) AS same_paragraph, len(ss) > len(list_distinct(ss)) AS same_sentence FROM g"""
)
def prose_defects(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.expr(PROSE.replace("chr(10)", "'\\n'")).alias("t"))
    return p.select("doc_id", *[c.alias(n) for n, c in reports.prose_defects(F.col("t")).items()])
