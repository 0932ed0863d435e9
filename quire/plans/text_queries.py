"""Queries of the text, number and time functions over titles, notes and addresses made of the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import names, text
from quire.plans.registry import query
from quire.session import table

#: Titles as they come from a shop, of parts; the same expression in Spark's and DuckDB's SQL.
TITLE = """CASE p_partkey % 10 WHEN 0 THEN p_name || ' ' || p_size || '巻' WHEN 1 THEN '【限定】' || p_name || ' vol.' || p_size WHEN 2 THEN p_name || ' (' || p_brand || ')'
    WHEN 3 THEN '[' || p_brand || '] ' || p_name || '/特典付き' WHEN 4 THEN p_name || ' 第' || p_size || '巻 (' || p_type || ')' WHEN 5 THEN p_name || ' ' || p_size
    WHEN 6 THEN p_name || '(' || p_size || ')' WHEN 7 THEN p_name || ' 第十二巻' WHEN 8 THEN p_size || '巻' ELSE p_name || '(上) ' END"""
#: A person's name as it is written in a list, of customers.
RAW_NAME = """CASE c_custkey % 9 WHEN 0 THEN '「皇太子 ' || c_name || '様」' WHEN 1 THEN '母' WHEN 2 THEN c_name || '(' || c_mktsegment || ')' WHEN 3 THEN '北国の兵' WHEN 4 THEN c_name || 'さん さま'
    WHEN 5 THEN repeat(c_name, 3) WHEN 6 THEN '田中太郎' WHEN 7 THEN 'アルバート・' || c_mktsegment ELSE ' ' || c_name || '。' END"""


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def cut(x: str, pattern: str, by: str = "") -> str:
    """DuckDB SQL: x without a pattern and without blanks at its ends."""
    return f"trim(regexp_replace({x}, {_q(pattern)}, '{by}', 'g'))"


def _volume_cuts(x: str) -> str:
    for _ in range(3):
        for pattern in text.VOLUME_ENDS:
            x = cut(x, pattern)
    return cut(x, text.END_SIGN)


WITH_TITLES = f"WITH t AS (SELECT p_partkey, {TITLE} AS title FROM part)"


def titles(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(TITLE).alias("title"))


@query(
    f"""{WITH_TITLES}, x AS (SELECT p_partkey, {cut(cut(f"regexp_replace(trim(title), {_q(text.PREFIX_LABEL)}, '')", text.INLINE_LABEL, " "), text.SLASH_NOTE)} AS x FROM t),
    b AS (SELECT p_partkey, x, {_volume_cuts(cut("x", text.END_LABEL))} AS b FROM x) SELECT p_partkey, CASE WHEN b = '' THEN x ELSE b END AS key FROM b"""
)
def title_keys(spark, d):
    return titles(spark, d).select("p_partkey", text.title_key(F.col("title")).alias("key"))


@query(f"{WITH_TITLES} SELECT p_partkey, {cut('trim(title)', text.SERIES_VOLUME)} AS series FROM t")
def series_without_volume(spark, d):
    return titles(spark, d).select("p_partkey", text.without_volume(F.col("title")).alias("series"))


@query(
    rf"""{WITH_TITLES} SELECT p_partkey, trim(regexp_extract(title, '\s*\(([^)]+)\)\s*$', 1)) AS publisher, {cut("title", r"\s*\([^)]+\)\s*$")} AS clean,
    CAST(coalesce(nullif(regexp_extract(title, {_q(text.LAST_NUMBER)}, 1), ''), nullif(regexp_extract(title, {_q(text.INNER_NUMBER)}, 1), ''), nullif(regexp_extract(title, {_q(text.INNER_NUMBER)}, 2), '')) AS INTEGER) AS volume FROM t"""
)
def title_fields(spark, d):
    x = F.col("title")
    return titles(spark, d).select("p_partkey", text.publisher(x).alias("publisher"), text.without_publisher(x).alias("clean"), text.volume(x).alias("volume"))


@query("SELECT a.p_partkey, CAST(coalesce(list_sum([CASE WHEN left(a.p_name, i) = left(b.p_name, i) THEN 1 ELSE 0 END FOR i IN range(1, least(length(a.p_name), length(b.p_name)) + 1)]), 0) AS INTEGER) AS n FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def common_prefix_lengths(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(nxt, "p_partkey").select("p_partkey", text.common_prefix(F.col("p_name"), F.col("other")).alias("n"))


NOTE = "CASE o_orderkey % 3 WHEN 0 THEN '[Kindle 版] ' ELSE '' END || o_orderpriority || ', ' || o_orderstatus || '、 a b,,' || o_custkey || CASE o_orderkey % 2 WHEN 0 THEN '  販売: Shop, Inc.' ELSE '' END"


@query(
    rf"""WITH n AS (SELECT o_orderkey, regexp_replace(regexp_replace({NOTE}, '(?i)^\[Kindle\s*版\]\s*', ''), '\s+販売:.*$', '') AS x FROM orders)
    SELECT o_orderkey, array_to_string(list_filter(list_transform(regexp_split_to_array(x, '[,、]'), lambda p: trim(p)), lambda p: p <> ''), '|') AS authors FROM n"""
)
def order_authors(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.array_join(text.authors_of(F.expr(NOTE)), "|").alias("authors"))


NAMES_OF_ORDER = "list_value(' b' || o_custkey, o_orderstatus, o_orderstatus || ' ', '')"


@query(
    f"""WITH n AS (SELECT o_orderkey, {NAMES_OF_ORDER} AS a FROM orders)
    SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(a, lambda x: trim(x)), lambda x: x <> ''))), chr(10)) AS set_key, array_to_string(list_sort(a), chr(10)) AS list_key,
        substr(sha1('author' || chr(0) || array_to_string(a, chr(0))), 1, 12) AS id FROM n"""
)
def author_keys(spark, d):
    a = F.array(F.concat(F.lit(" b"), "o_custkey"), F.col("o_orderstatus"), F.concat("o_orderstatus", F.lit(" ")), F.lit(""))
    return table(spark, d, "orders").select("o_orderkey", text.author_set_key(a).alias("set_key"), text.author_list_key(a).alias("list_key"), text.stable_id("author", a).alias("id"))


@query("SELECT c_custkey, trim(regexp_replace(lower('  ' || c_mktsegment || '   ' || c_name), '\\s+', ' ', 'g')) AS key FROM customer")
def name_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.name_key(F.concat(F.lit("  "), "c_mktsegment", F.lit("   "), "c_name")).alias("key"))


AMOUNT = "CASE o_orderkey % 4 WHEN 0 THEN 'Not Available' WHEN 1 THEN ' ' ELSE 'JPY ' END || CASE WHEN o_orderkey % 4 > 1 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.75 ' ELSE '' END"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 1 THEN CAST(floor(o_totalprice) AS BIGINT) END AS amount FROM (SELECT *, {AMOUNT} AS x FROM orders)")
def money_amounts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.money(F.expr(AMOUNT.replace("VARCHAR", "STRING"))).alias("amount"))


WHEN = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN 'not available' ELSE 'soon' END"


@query(
    f"""WITH e AS (SELECT event_id, ts, {WHEN} AS x FROM events)
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN replace(x, 'Z', '+00:00') WHEN 1 THEN replace(x, ' ', 'T') WHEN 3 THEN x END AS iso,
        CASE event_id % 4 WHEN 0 THEN epoch(date_trunc('second', ts))::BIGINT WHEN 1 THEN epoch(date_trunc('second', ts))::BIGINT - 32400 END AS seconds, substr(x, 1, 10) AS day FROM e WHERE event_id % 4 <> 2
    UNION ALL SELECT event_id, NULL, NULL, NULL FROM e WHERE event_id % 4 = 2"""
)
def iso_times(spark, d):
    form = lambda f: F.date_format("ts", f)
    n = F.col("event_id") % 4
    x = F.when(n == 0, form("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 1, form("yyyy-MM-dd HH:mm:ss")).when(n == 2, F.lit("not available")).otherwise("soon")
    e = table(spark, d, "events").select("event_id", x.alias("x"))
    x = F.col("x")
    return e.select("event_id", text.iso_text(x).alias("iso"), F.unix_timestamp(text.iso_time(x)).alias("seconds"), F.when(x != "not available", text.date_prefix(x)).alias("day"))


PRODUCT = "'https://www.amazon.co.jp/' || p_name || '/dp/b' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || CASE WHEN p_partkey % 2 = 0 THEN '?ref=x' ELSE '/' END"


@query("SELECT p_partkey, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS asin FROM part")
def product_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", text.item_id(F.expr(PRODUCT.replace("VARCHAR", "STRING"))).alias("asin"))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS price, CAST(l_quantity * 100 AS BIGINT) AS points, CASE WHEN l_linenumber <> 5 THEN CAST(floor(l_extendedprice * 2) AS BIGINT) END AS list_price,
        CASE WHEN l_linenumber <> 2 THEN 'paper' END AS source FROM lineitem),
    s AS (SELECT *, CASE WHEN points <= price THEN greatest(price - points, 0) END AS effective, CASE WHEN price IS NOT NULL AND list_price > 0 AND source IS NOT NULL THEN 'ok' ELSE 'partial' END AS status FROM p)
    SELECT l_orderkey, l_linenumber, effective, status, round(CASE WHEN status = 'ok' AND list_price > 0 THEN effective * 100.0 / list_price END, 6) AS ratio FROM s"""
)
def price_states(spark, d):
    number, whole = F.col("l_linenumber"), lambda x: F.floor(x)
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(number != 3, whole(F.col("l_extendedprice"))).alias("price"), whole(F.col("l_quantity") * 100).alias("points"), F.when(number != 5, whole(F.col("l_extendedprice") * 2)).alias("list_price"), F.when(number != 2, F.lit("paper")).alias("source"))
    s = p.withColumns({"effective": text.effective_price(F.col("price"), F.col("points")), "status": text.observation_status(*map(F.col, ("price", "points", "list_price", "source")))})
    return s.select("l_orderkey", "l_linenumber", "effective", "status", F.round(text.ratio_percent(F.col("effective"), F.col("list_price"), F.col("status")), 6).alias("ratio"))


@query("SELECT s_suppkey, lower(replace(trim(' ' || s_name || ' X'), ' ', '_')) AS plain, replace(replace(lower(replace(trim(' ' || s_name || ' X'), ' ', '_')), '#', '%23'), '_', '_') AS key, replace(replace(lower(s_name), '#', '%23'), '_', '%20') || '%20x-japanese.nozomi' AS file FROM supplier")
def artist_keys(spark, d):
    x = F.concat(F.lit(" "), "s_name", F.lit(" X"))
    plain = F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit("_"))
    return table(spark, d, "supplier").select("s_suppkey", plain.alias("plain"), text.artist_key(x).alias("key"), text.index_name(plain, "japanese").alias("file"))


MARKED = "'<b>' || p_name || ' & <mark>' || p_brand || '</mark>' || chr(39)"


@query(
    f"""SELECT p_partkey, '&lt;b&gt;' || p_name || ' &amp; <mark>' || p_brand || '</mark>&#x27;' AS safe, '<b>' || p_name || ' & ' || p_brand || chr(39) AS bare FROM part"""
)
def escaped_marks(spark, d):
    x = F.expr(MARKED)
    return table(spark, d, "part").select("p_partkey", text.escaped(x).alias("safe"), text.without_marks(x).alias("bare"))


@query(
    """SELECT p_partkey, p_size BETWEEN 1 AND 99 AS is_kanji, p_size AS n FROM part WHERE p_size BETWEEN 1 AND 99"""
)
def kanji_numbers(spark, d):
    digits = "array('', '一', '二', '三', '四', '五', '六', '七', '八', '九')"
    numeral = F.expr(f"CASE WHEN p_size >= 20 THEN element_at({digits}, CAST(floor(p_size / 10) AS INT) + 1) ELSE '' END || CASE WHEN p_size >= 10 THEN '十' ELSE '' END || element_at({digits}, p_size % 10 + 1)")
    p = table(spark, d, "part").filter("p_size between 1 and 99").select("p_partkey", text.kanji_number(numeral).alias("n"))
    return p.select("p_partkey", F.col("n").isNotNull().alias("is_kanji"), "n")


PATH = "CASE n_nationkey % 5 WHEN 0 THEN '../' WHEN 1 THEN '/' WHEN 2 THEN 'C:\\\\' WHEN 3 THEN 'a\\\\..\\\\' ELSE 'a/b..c/' END || n_name"


@query("SELECT n_nationkey, n_nationkey % 5 = 4 AS safe, n_name || '_p' || lpad(CAST(n_regionkey AS VARCHAR), 3, '0') || '.png' AS image, row_number() OVER (ORDER BY n_nationkey) AS place FROM nation")
def path_checks(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "nation")
    natural = F.row_number().over(Window.orderBy(text.natural_key(F.col("n_name"))))
    return n.select("n_nationkey", text.safe_path(F.expr(PATH)).alias("safe"), text.image_name(F.col("n_name"), F.col("n_regionkey")).alias("image"), natural.cast("long").alias("place"))


@query(
    rf"""WITH n AS (SELECT c_custkey, {RAW_NAME} AS raw FROM customer),
    u AS (SELECT c_custkey, regexp_replace(trim(raw), '^{names.WRAPPERS.replace("'", "''")}+|{names.WRAPPERS.replace("'", "''")}+$', '', 'g') AS x FROM n),
    v AS (SELECT c_custkey, {cut(cut(cut("x", names.IN_BRACKETS), names.TITLE), "(?:" + names.HONORIFIC + r"\s*)+$")} AS x FROM u),
    w AS (SELECT c_custkey, CASE WHEN x <> '' AND length(x) <= 30 AND x NOT IN ({", ".join(map(_q, names.ROLES))}) AND NOT regexp_matches(x, {_q(names.ROLE_OF)}) THEN x END AS name FROM v)
    SELECT c_custkey, name, CASE WHEN name = '田中太郎' THEN '中太郎' WHEN name LIKE 'アルバート・%' THEN 'アルバート' END AS short FROM w"""
)
def character_names(spark, d):
    name = names.character_name(F.expr(RAW_NAME))
    return table(spark, d, "customer").select("c_custkey", name.alias("name")).withColumn("short", F.get(names.short_forms(F.col("name")), 0))


@query(
    rf"""WITH n AS (SELECT c_nationkey, c_custkey, {RAW_NAME} AS raw FROM customer), l AS (SELECT c_nationkey, string_agg(raw, '、' ORDER BY c_custkey) AS raw FROM n GROUP BY 1),
    p AS (SELECT c_nationkey, unnest(string_split(replace(raw, '、', ','), ',')) AS raw, unnest(range(len(string_split(replace(raw, '、', ','), ',')))) AS i FROM l),
    u AS (SELECT c_nationkey, i, regexp_replace(trim(raw), '^{names.WRAPPERS.replace("'", "''")}+|{names.WRAPPERS.replace("'", "''")}+$', '', 'g') AS x FROM p),
    v AS (SELECT c_nationkey, i, {cut(cut(cut("x", names.IN_BRACKETS), names.TITLE), "(?:" + names.HONORIFIC + r"\s*)+$")} AS x FROM u),
    w AS (SELECT c_nationkey, x, min(i) AS i FROM v WHERE x <> '' AND length(x) <= 30 AND x NOT IN ({", ".join(map(_q, names.ROLES))}) AND NOT regexp_matches(x, {_q(names.ROLE_OF)}) GROUP BY 1, 2)
    SELECT c_nationkey, string_agg(x, '|' ORDER BY i) AS names FROM w GROUP BY 1"""
)
def character_lists(spark, d):
    raw = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.expr(RAW_NAME).alias("raw"))
    joined = raw.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "raw"))), lambda x: x["raw"]), "、").alias("raw"))
    return joined.select("c_nationkey", F.array_join(names.character_names(F.col("raw")), "|").alias("names")).filter("names <> ''")


CLAIM_SOURCE = "replace(replace(text, '. ', '。'), '?', '？')"


@query(
    f"""WITH l AS (SELECT conv_id, turn, unnest(string_split({CLAIM_SOURCE}, chr(10))) AS line FROM conversations),
    p AS (SELECT conv_id, turn, trim(unnest(string_split(regexp_replace(line, '([。！？!?])', '\\1' || chr(1), 'g'), chr(1)))) AS x FROM l)
    SELECT conv_id, turn, count(*) AS claims, CAST(sum(length(x)) AS BIGINT) AS chars FROM p WHERE x <> '' GROUP BY 1, 2"""
)
def claim_counts(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.explode(names.claims(F.expr(CLAIM_SOURCE))).alias("x"))
    return c.groupBy("conv_id", "turn").agg(F.count("*").alias("claims"), F.sum(F.length("x")).alias("chars"))


