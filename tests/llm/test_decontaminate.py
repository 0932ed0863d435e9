import random
import re

import pytest
from compare import SMALL, assert_same
from pyspark.sql import functions as F

from quire.llm import decontaminate as dc
from quire.llm.queries import ORACLE_SQL, op11_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    """Number of words, hit words and the items of a text, from every place of every window."""
    ws, hit, who = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        k = min(10, len(iw))
        for j in range(len(iw) - k + 1) if k else ():
            for i in range(len(ws) - k + 1):
                if ws[i : i + k] == iw[j : j + k]:
                    hit |= set(range(i, i + k))
                    who |= {item} - {None}
    return len(ws), len(hit), sorted(who)


def tables():
    rnd = random.Random(7)
    vocabulary = ["the", "a", "Été", "x1", "日本", "of", "IN", "on", "zz", "12"]
    say = lambda n: rnd.choice([" ", ", ", "\n", "--"]).join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, say(rnd.choice([3, 6, 9, 10, 11, 25]))) for i in range(12)]
    items += [(3, items[1][1] + " also the tail"), (None, "a null item with these eleven words in a row here"), (20, None), (21, " .,- "), (22, items[5][1].upper())]
    docs = [(i, say(rnd.randrange(40))) for i in range(80)]
    for i in range(80, 140):
        cut = words(rnd.choice(items)[1] or "none")
        docs.append((i, f"{say(5)} {'! '.join(w.title() for w in cut[rnd.randrange(2):])} {say(7)}"))
    docs += [(200, None), (201, ""), (202, items[3][1] + " " + items[4][1]), (203, "a NULL item; with these eleven words in a row here."), (203, "clean"), (None, items[5][1]), (202, items[3][1] + " " + items[4][1])]
    return docs, items


@pytest.mark.parametrize("block", [500_000, 40])
def test_hits_as_by_comparing_all_places(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK", block)
    docs, items = tables()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as runs", "8 as k").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dc.find_leaks(df, bench).withColumn("n_hit", dc.n_hit())
    got = sorted(((r.doc_id, r.text, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str)
    want = sorted(((i, t, *brute(t, items)) for i, t in docs), key=str)
    assert got == want and sum(x[3] > 0 for x in want) > 40
    assert found.columns[:3] == ["doc_id", "text", "k"]


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(dc, "PIECE", 50)
    docs, items = tables()
    text = " ".join(t for _, t in docs if t)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = dc.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).withColumn("n_hit", dc.n_hit()).first()
    assert (r.n_words, r.n_hit, r["items"]) == brute(text, items)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(dc.Words, "hashes", lambda self, k, at, totals: dc.np.zeros(len(at), dc.np.uint64))
    found = dc.WindowSet([b"a b", b"c d"], [2, 2], ["x", "y"])
    assert sorted(found.hits(dc.Words([b"A, b c", b"d. C d"]))) == [(0, 2, ("x",)), (4, 2, ("y",))]


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before it. {item.title()}! After, é."), (2, "clean words"), (3, None), (4, item), (5, "")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")
    spans = {r.doc_id: r.text for r in dc.decontaminate(df, bench).collect()}
    assert spans == {1: "Before it. ! After, é.", 2: "clean words", 3: None, 4: "", 5: ""}
    kept = {r.doc_id for r in dc.decontaminate(df, bench, remove="documents").collect()}
    assert kept == {2, 3, 5}
    assert {r.doc_id for r in dc.decontaminate(df, bench, remove="documents", most_percent=90).collect()} == {1, 2, 3, 5}
    with pytest.raises(ValueError):
        dc.decontaminate(df, bench, remove="all")


def test_empty_tables(spark):
    df, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    r = dc.find_leaks(df, bench).first()
    assert (r.n_words, r.runs, r["items"]) == (2, [], [])
    assert dc.find_leaks(df.limit(0), bench).collect() == []


def test_query_gives_the_rows_of_its_sql(spark):
    out = op11_decontamination(spark, SMALL)
    assert_same(out, ORACLE_SQL["op11_decontamination"])
    assert out.filter(F.col("contaminated") & (F.col("n_items") > 0)).count() > 0
