import math
import random
import re

import pytest

from quire.operators import text_index as ti
from quire.sources.publications import Publication
from quire.sources.writers import Conflict


def words(text):
    return [w for w in re.findall(r"[^\W_]+", (text or "").lower()) if len(w) <= 40]


def bm25(docs, count_of, top):
    """(key, score) of the best documents; count_of gives, for the words of a text, its occurrences of each term."""
    ws = {k: words(t) for k, t in docs}
    n, mean = len(ws), sum(map(len, ws.values())) / len(ws)
    tf = {k: count_of(w) for k, w in ws.items()}
    terms = {t for c in tf.values() for t in c}
    df = {t: sum(c.get(t, 0) > 0 for c in tf.values()) for t in terms}
    score = {k: round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(ws[k]) / mean)) for t, x in c.items() if x), 6) for k, c in tf.items()}
    return sorted(((k, s) for k, s in score.items() if s > 0), key=lambda x: (-x[1], x[0]))[:top]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(1)
    vocabulary = ["the", "of", "Été", "rare", "x1", "rights", "reserved", "日本", "a_b"]
    weights = [30, 20, 5, 1, 5, 6, 6, 3, 2]
    docs = [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(1, 40)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "the " * 5000 + "z" * 41), (903, "the rights reserved the rights reserved")]
    old, ti.SEGMENT, first, ti.FIRST = ti.SEGMENT, 20, ti.FIRST, 1
    at = Publication(spark, f"file://{tmp_path_factory.mktemp('texts')}/index")
    df = spark.createDataFrame(docs, "id long, body string").repartition(3)
    ti.build(at, df.filter("id < 250 or id >= 900"), "id", "body", buckets=5)
    ti.add(at, df.filter("id between 250 and 899"), "id", "body")
    yield docs, at
    ti.SEGMENT, ti.FIRST = old, first


@pytest.mark.parametrize("tokens", [["rare"], ["the", "rare"], ["the", "of", "日本", "the"], ["nowhere"], ["nowhere", "x1"], []])
def test_searches_as_by_scoring_all_documents(corpus, tokens):
    docs, at = corpus
    got = ti.Reader(at).search(tokens, 12).collect()
    want = bm25(docs, lambda ws: {t: ws.count(t) for t in set(tokens) if t in ws}, 12)
    assert [(r.key, r.score) for r in got] == want and [r["rank"] for r in got] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("tokens", [["rights", "reserved"], ["the", "of", "the"], ["the", "the"], ["rare", "rare", "rare", "rare", "rare"]])
def test_phrases_by_position(corpus, tokens):
    docs, at = corpus
    n = len(tokens)
    count = lambda ws: {"p": c} if (c := sum(ws[i : i + n] == tokens for i in range(len(ws)))) else {}
    reader = ti.Reader(at)
    assert [(r.key, r.score) for r in reader.phrase_search(tokens, 15).collect()] == bm25(docs, count, 15)
    assert {r.key: r.tf for r in reader.phrase(tokens).collect()} == {k: c["p"] for k, t in docs if (c := count(words(t)))}


def test_only_folders_of_the_words_are_opened_and_weak_segments_left_out(corpus, monkeypatch):
    docs, at = corpus
    reader = ti.Reader(at)
    plan = reader.blocks(["rare"])._jdf.queryExecution().executedPlan().toString()
    assert all(re.match(r"\[(isnotnull\(bucket#\d+\), )?\(?bucket#\d+", x) for x in plan.split("PartitionFilters: ")[1:])
    read = []
    scored = ti.Reader._scored
    monkeypatch.setattr(ti.Reader, "_scored", lambda self, blocks, idf: read.append({r.segment for r in blocks.select("segment").distinct().collect()}) or scored(self, blocks, idf))
    reader.search(["the", "rare"], 3)
    every = {r.segment for r in reader.blocks(["the", "rare"]).select("segment").distinct().collect()}
    assert len(read[0]) == 1 and read[0] <= read[1] < every


def test_publication_fails_when_the_source_has_moved_or_the_rule_differs(spark, corpus, tmp_path, monkeypatch):
    at = Publication(spark, f"file://{tmp_path}/index")
    df = spark.createDataFrame([(1, "a b")], "id long, body string")
    ti.build(at, df, "id", "body", expected=0)
    with pytest.raises(Conflict):
        ti.build(at, df, "id", "body", expected=0)
    monkeypatch.setattr(ti, "RULE", "another")
    with pytest.raises(Conflict):
        ti.Reader(at)


def test_an_empty_table(spark, tmp_path):
    at = Publication(spark, f"file://{tmp_path}/index")
    ti.build(at, spark.createDataFrame([], "id long, body string"), "id", "body")
    reader = ti.Reader(at)
    assert reader.search(["a"], 5).collect() == [] and reader.phrase_search(["a"], 5).collect() == []
