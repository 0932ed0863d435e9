"""Steps that must not grow faster than their tables: what their plans have, beside the same rows."""

import random
import re
from collections import Counter

import regex
from pyspark.sql import Window
from pyspark.sql import functions as F

from compare import SMALL, assert_same
from quire.functions import pages
from quire.operators import postings, replies, search, text_index, vector_index, windows
from quire.plans import all as library
from quire.sources import publications
from quire.sources.publications import Publication


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def same_as_sql(spark, name, folder=SMALL):
    assert_same(library.QUERIES[name](spark, folder), library.ORACLE_SQL[name], folder)


def test_rewritten_relations_broadcast_no_books(spark):
    old = spark.createDataFrame([(1, "x", "y", "k", 1.0), (2, "x", "y", "k", 1.0), (3, "x", "y", "k", 1.0)], "book long, a string, b string, relation string, weight double")
    counts = spark.createDataFrame([(1, "a", "b", 3), (3, "c", "d", 2)], "book long, a string, b string, n long")
    labels = spark.createDataFrame([(1, 0, "b", "a", "old"), (1, 1, "a", "b", "new"), (1, 2, "a", "c", "alone")], "book long, place int, a string, b string, relation string")
    got = replies.rewritten_relations(old, counts, labels, "book")
    assert "Broadcast" not in plan(got)
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a", "b", "new", 3.0), (1, "a", "c", "alone", 0.0), (2, "x", "y", "k", 1.0), (3, "c", "d", None, 2.0)]
    same_as_sql(spark, "rewritten_relations")


def test_ranking_metrics_make_no_pairs(spark):
    got = library.QUERIES["ranking_metrics"](spark, SMALL)
    assert not re.search(r"Join.* NOT \(vec_id", plan(got))
    assert_same(got, library.ORACLE_SQL["ranking_metrics"])


def test_exact_cosine_is_that_of_columns(spark):
    rows = [(i, [float(i % 7 - 3), float(i % 5), float(i % 3)]) for i in range(60)] + [(60, None), (61, [1.0, None, 2.0]), (62, [0.0] * 3), (63, [float("nan"), 1.0, 1.0])]
    v = spark.createDataFrame(rows, "k long, v array<float>")
    asked = v.filter("k in (0, 7, 50, 60, 62, 63)")
    both = v.join(asked.select(F.col("k").alias("q"), F.col("v").alias("w")), F.col("k") != F.col("q"))
    scored = both.select("q", "k", F.round(search.cosine(F.col("w"), F.col("v")), 6).alias("s"))
    for top in (5, 62):
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "k"))
        want = scored.withColumn("r", rank).filter(F.col("r") <= top)
        got = vector_index.exact_cosine(v, "k", asked, "k", "v", top).select("query", "key", "score", "rank")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.toDF("query", "key", "score", "rank").collect()))


def test_metrics_by_label_are_those_of_pairs(spark):
    items = spark.createDataFrame([(i, None if i == 9 else i % 3, 1 + i % 2) for i in range(40)] + [(40, 7, 1)], "i long, label int, g int")
    queries = items.filter("i in (0, 4, 9, 40)").select(F.col("i").alias("q"), "label")
    ranked = spark.createDataFrame([(q, (q + 3 * k) % 41, k) for q in (0, 4, 9, 40) for k in range(1, 31)], "q long, i long, rank int").filter("q <> i")
    relevant = items.join(queries, "label").filter("q <> i").select("q", "i", "g")
    want = windows.ranking_metrics(ranked, relevant, "q", "i", "rank", "g")
    got = windows.ranking_metrics_by_label(ranked, queries, items, "q", "i", "rank", "label", "g")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_repeats_is_that_of_the_plain_form():
    def plain_form(text):
        content = lambda x: pages._NO_CONTENT.sub("", x)
        lines = [x for x in (pages._SPACES.sub("", line) for line in text.splitlines()) if len(content(x)) >= 10]
        if any(n >= 3 or n == 2 and len(content(x)) >= 40 for x, n in Counter(lines).items()):
            return True
        if any(n > 1 for n in Counter(x for x in map("".join, zip(lines, lines[1:])) if len(content(x)) >= 40).values()):
            return True
        c = content(text)
        return max(Counter(c[i : i + 12] for i in range(len(c) - 11)).values(), default=0) >= 8

    chance, found = random.Random(3), set()
    for _ in range(1500):
        signs = chance.choice(["ab", "abc d.", "あ漢 ー　b", "a\x1c\x1f\x85\xa0b 9_"])
        text = "".join(chance.choice(signs) for _ in range(chance.randrange(120))) * chance.choice([1, 1, 7, 8])
        text = "\n".join([text[i : i + 30] for i in range(0, len(text), 30)] * chance.choice([1, 1, 2, 3]))
        assert pages.repeats(text) == plain_form(text)
        found.add(pages.repeats(text))
    assert found == {True, False}


def test_risk_flags_read_each_text_once_for_repetition(spark):
    got = library.QUERIES["risk_flags"](spark, SMALL)
    calls = set(re.findall(r"has_repetition\([^)]*\)[^#]*#\d+", plan(got).split("ArrowEvalPython")[1].split("\n")[0]))
    assert len(calls) == 2
    same_as_sql(spark, "risk_flags")


def test_claim_evidence_of_texts_that_are_null(spark, tmp_path):
    rows = [(1, 0, None), (1, 1, None), (1, 2, "abc"), (2, 0, "ab, cd"), (2, 1, "xbcd"), (2, 2, None), (2, 3, ""), (2, 4, "𝒳bc d"), (3, 0, ""), (3, 1, "a")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    same_as_sql(spark, "claim_evidence", str(tmp_path))
    same_as_sql(spark, "claim_evidence")


def test_postings_are_counted_where_a_page_is_read(spark):
    rows = [(1, "Ab ab abc"), (2, None), (3, ""), (4, "𝒳é漢字 x " + "y" * 41), (5, "a " * 30)]
    docs = spark.createDataFrame(rows, "k long, text string")
    for sizes, tokens in (((), lambda ws: ws), ((2, 3), lambda ws: [w[i : i + n] for w in ws for n in (2, 3) for i in range(len(w) - n + 1)])):
        got = postings.index(docs, "k", postings.words(F.col("text")), sizes)
        assert "Exchange" not in plan(got)
        words = {k: [w for w in regex.findall(r"[\p{L}\p{N}]+", (t or "").lower()) if len(w) <= 40] for k, t in rows}
        want = [(t, k, n, len(tokens(ws))) for k, ws in words.items() for t, n in Counter(tokens(ws)).items()]
        assert sorted(map(tuple, got.select("token", "k", "tf", "length").collect())) == sorted(want)
    for name in ("gram_index", "index_refresh", "postings_index"):
        same_as_sql(spark, name)


def test_text_index_deals_texts_and_no_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "SEGMENT", 3)
    docs = spark.createDataFrame([(i, None if i == 5 else "b a " * (i % 4) + f"w{i}") for i in range(20)], "k long, t string")
    at = Publication(spark, f"file://{tmp_path}/index")
    dealt = []
    publish = at.publish
    at.publish = lambda tables, *a, **b: dealt.append(tables["postings"]) or publish(tables, *a, **b)
    text_index.build(at, docs, "k", "t", buckets=4)
    assert len(re.findall(r"Exchange hash", plan(dealt[0]))) == 1
    got = [(r.token, k, n, length, list(p)) for r in at.read("postings").collect() for k, n, length, p in zip(r["keys"], r.tf, r.lengths, r.positions)]
    texts = {r.k: (r.t or "").split() for r in docs.collect()}
    want = [(w, k, ws.count(w), len(ws), [i for i, x in enumerate(ws) if x == w]) for k, ws in texts.items() for w in set(ws)]
    assert sorted(got) == sorted(want)
    blocks = at.read("postings").collect()
    assert all(r["keys"] == sorted(r["keys"]) and r.most == max(r.tf) and r.shortest == min(r.lengths) and r.docs == len(r.tf) for r in blocks)
    assert len({(r.token, r.segment) for r in blocks}) == len(blocks)


def test_a_part_is_read_back_once_when_it_is_published(spark, tmp_path, monkeypatch):
    reads, real = [], publications.digest
    monkeypatch.setattr(publications, "digest", lambda df: reads.append("digest") or real(df))
    monkeypatch.setattr(type(spark.range(1)), "count", lambda df: reads.append("count"))
    at = Publication(spark, f"file://{tmp_path}/p")
    at.publish({"t": spark.range(7), "none": spark.range(0)})
    assert reads == ["digest", "digest"]
    assert {n: t["parts"][0]["rows"] for n, t in at.current()["tables"].items()} == {"t": 7, "none": 0}
