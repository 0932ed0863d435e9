"""The registered queries of this subpackage: thin uses of the operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, cotrain, cuckoo, decontaminate, fim, kdtree, language, line_clean, mixing, partenum, surrogate, token_files, trie
from quire.llm.workspace import materialize, new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.ByteBPE(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    both = codec.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return both.select("doc_id", bpe.n_tokens("token_ids").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out("doc_id"))
    model = language.fit(docs.filter("not held_out"), "text", "lang", ["doc_id"])
    return language.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, new_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), added=True)
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kdtree.split_by_kdtree(_table(spark, sf_dir, "documents"), shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_dedup(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(_table(spark, sf_dir, "documents"))


def op6_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = cotrain.train(docs, _table(spark, sf_dir, "labels"))
    return cotrain.score(docs, model).select("doc_id", "score", "score_text", "score_metadata", "kept")


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_clean.clean_lines(docs).drop("text", "clean_text")


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.temperature_mix(docs, max_repeats=2.0).select("doc_id", "source", "n_tokens", "pass", "block")


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.replace_entities(_table(spark, sf_dir, "documents").select("doc_id", "text"), key="surrogate-key").select("doc_id", "text", "n_entities")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    names = F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))
    hit = decontaminate.n_hit()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_forked(_table(spark, sf_dir, "conversations"))).withColumnRenamed("saved", "saved_tokens")


def _forked(turns: DataFrame) -> DataFrame:
    """Every conversation with the first turns of the one whose number is the next lower multiple of five, in place of as
    many of its own: how many, 0 to 8, its own number decides."""
    own = materialize(trie.conversation_paths(turns), "conversations")
    heads = own.filter("id % 5 = 0").select(F.col("id").alias("base"), F.slice("steps", 1, 8).alias("head"))
    both = own.withColumn("base", F.expr("id - id % 5")).join(heads, "base", "left").withColumn("h", F.expr("int(crc32(string(id)) % 9)"))
    return both.select("id", F.expr("concat(slice(coalesce(head, array()), 1, h), slice(steps, h + 1, size(steps)))").alias("steps"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_language_id,
        op3_token_files,
        op4_kdtree_shards,
        op5_exact_dedup,
        op6_cotrained_quality,
        op7_jaccard_join,
        op8_line_rules,
        op9_temperature_mix,
        op10_surrogates,
        op11_decontamination,
        op12_conversation_trie,
        op13_fill_in_middle,
    )
}

ORACLE_SQL = {
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op8_line_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
        r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM w), range(3) o(k) WHERE c > 1 GROUP BY 1),
        l AS (SELECT doc_id, line, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d)),
        m AS (SELECT *, len(lw) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again FROM l WHERE len(lw) > 0),
        f AS (SELECT *, again OR NOT regexp_matches(line, '[.!?;:…。！？]["''”’»)\]]*[\x20\x09-\x0D]*$') OR 2 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > n
            OR 4 * len(list_filter(lw, lambda x: x IN ('|', '·', '•', '»', '›', '>', '→', '/'))) >= n OR (n >= 5 AND line = upper(line) AND line <> lower(line))
            OR (n >= 4 AND 2 * len(list_filter(range(1, n), lambda i: lw[i] = lw[i + 1])) > n)
            OR (n <= 25 AND regexp_matches(lower(line), 'all rights reserved|licen[sc]ed under|released under|terms of (?:use|service)|privacy policy|cookie policy|(?:uses?|accept|enable) cookies|enable javascript|click here|subscribe to|sign up for|log ?in to|powered by|lorem ipsum')) AS fails FROM m),
        g AS (SELECT doc_id, count(*) FILTER (again) AS n_dup, coalesce(sum(length(array_to_string(lw, ''))) FILTER (fails), 0) AS lost, count(*) FILTER (fails) AS removed FROM f GROUP BY 1),
        b AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
            CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars, coalesce(removed, 0) AS n_lines_removed FROM d LEFT JOIN r USING (doc_id) LEFT JOIN g USING (doc_id))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept FROM b
    """,
    "op9_temperature_mix": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n_tokens, coalesce('=' || source, 'null') AS k FROM documents),
        s AS (SELECT k, CAST(sum(n_tokens) AS BIGINT) AS t FROM d GROUP BY 1),
        a AS (SELECT greatest(0, 1 - ln(2.0) / nullif(ln(max(t) / min(t)), 0)) AS x, sum(t) AS total FROM s),
        w AS (SELECT k, t, pow(t / total, coalesce(x, 0)) AS w FROM s, a),
        p AS (SELECT k, t, w / t * max(t / w) OVER () AS p FROM w),
        q AS (SELECT k, CAST(floor(p + 1e-9) AS BIGINT) AS whole, CAST(greatest(0, round((p - floor(p + 1e-9)) * t)) AS BIGINT) AS part, greatest(1, CAST(ceil(t / 100000) AS BIGINT)) AS blocks FROM p),
        r AS (SELECT d.*, whole, part, CAST('0x' || substr(md5('mix|' || doc_id), 1, 15) AS BIGINT) % blocks AS block FROM d JOIN q USING (k)),
        b AS (SELECT k, block, whole, part, sum(n_tokens) AS n FROM r GROUP BY ALL),
        c AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY md5('mix|block|' || k || '|' || block || '|' || whole), block) - n AS before FROM b),
        e AS (SELECT r.*, CASE WHEN before + n <= c.part THEN 1 WHEN c.part - before > 0 AND sum(n_tokens) OVER (PARTITION BY r.k, r.block ORDER BY md5('mix|doc|' || doc_id || '|' || r.whole), n_tokens ROWS UNBOUNDED PRECEDING) <= c.part - before THEN 1 ELSE 0 END AS more
            FROM r JOIN c ON c.k = r.k AND c.block = r.block)
        SELECT doc_id, source, n_tokens, unnest(range(whole + more)) AS pass, block FROM e
    """,
    "op11_decontamination": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        w AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
        g AS (SELECT row_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT row_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM w))),
        h AS (SELECT row_id, item_id, i, k FROM g JOIN w USING (k, gram)),
        c AS (SELECT row_id, count(DISTINCT i + o) AS n FROM (SELECT DISTINCT row_id, i, k FROM h), range(10) r(o) WHERE o < k GROUP BY 1),
        s AS (SELECT row_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
        SELECT doc_id, len(ws) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(s.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (row_id) LEFT JOIN s USING (row_id)
    """,
    "op12_conversation_trie": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, r, x) AS s FROM t GROUP BY 1),
        h AS (SELECT conv_id, s, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT)),
            lambda crc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, xor(crc, b)), 4294967295), 4294967295) % 9 AS h FROM o),
        f AS (SELECT h.conv_id AS c, list_concat(coalesce(o.s, [])[1:h], h.s[h + 1:]) AS s FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5),
        n AS (SELECT c, d, s[1:d] AS p, len(s) = d AS ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM f)),
        g AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ids FROM n GROUP BY p, d),
        k AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM g WHERE d > 0 GROUP BY ALL),
        m AS (SELECT g.*, coalesce(k.n, 0) AS n_children, CASE WHEN g.d > 0 THEN (g.n_convs - 1) * strlen(g.p[g.d].x) ELSE 0 END AS saved FROM g LEFT JOIN k USING (p, d)),
        u AS (SELECT p[1:a] AS p, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY ALL)
        SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, u.saved_tokens, sha256(m.ids) AS ends_sha256
        FROM m JOIN u USING (p, d) LEFT JOIN g q ON q.d = m.d - 1 AND q.p = m.p[1:m.d - 1]
    """,
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        x AS (SELECT *, len(w) AS n, [CAST('0x' || substr(h, i, 8) AS BIGINT) FOR i IN [1, 9, 17, 25]] AS r FROM d),
        y AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
        z AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM y)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
        FROM z
    """,
}
