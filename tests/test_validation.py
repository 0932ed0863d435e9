import json

import pytest
from pyspark.sql import functions as F

from quire.operators import validation as v

TEXT = "The fox  ran\nover the hill. The fox slept."


def strict(text):
    """What a strict reader takes: the object, or None."""

    def pairs(found):
        if len({k for k, _ in found}) < len(found):
            raise ValueError
        return dict(found)

    try:
        got = json.loads(text, object_pairs_hook=pairs, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    except (ValueError, TypeError):
        return None
    return got if isinstance(got, dict) else None


def test_only_strict_objects(spark):
    texts = ['{"a": 1, "b": [1, {"c": null}]}', ' {"b": 2.5, "a": "x"} ', '{"a":1,"a":2}', '{"a":{"b":1,"b":2}}', '{"a":NaN}', '{"a":-Infinity}', "[1]", '"x"', "1", "", None, '{"a":1} x', '{"a":1},{"b":2}', "{'a':1}", '{"a":1,}', '{"ü":"\\u00e9\\n"}', "{}"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", v.normalized_object(F.col("t")).alias("n")).collect()
    for r in rows:
        want = strict(r.t) if r.t is not None else None
        assert (r.n is None) == (want is None), r
        assert r.n is None or json.loads(r.n) == want
    fenced = spark.createDataFrame([('```json\n{"a":1}\n```',), ('```JSON\n{"a":1}\n```',), ('x ```json\n{"a":1}\n```',)], "t string")
    assert [r.n for r in fenced.select(v.normalized_object(F.col("t")).alias("n")).collect()] == ['{"a":1}', None, None]
    long = spark.createDataFrame([('{"a":"' + "x" * 100 + '"}',)], "t string").select(v.normalized_object(F.col("t"), 50).alias("n"))
    assert long.first().n is None


def found(*evidence):
    return json.dumps({"status": "found", "evidence": list(evidence)})


def quote(q, s=1):
    return {"source_id": s, "quote": q}


ANSWERS = {
    "good": (found(quote("fox ran over"), quote("sleep", 2)), {}),
    "none": ('{"status":"not_found","evidence":[]}', {}),
    "blank": (" ", {None: "empty or oversized"}),
    "null": (None, {None: "empty or oversized"}),
    "long": (found(quote("x" * 20_000)), {None: "empty or oversized"}),
    "twice": ('{"status":"found","status":"found","evidence":[]}', {None: "no strict object"}),
    "keys": ('{"status":"found"}', {None: "answer keys"}),
    "more": ('{"status":"found","evidence":[],"x":1}', {None: "answer keys"}),
    "status": ('{"status":"maybe","evidence":[]}', {None: "status or evidence"}),
    "kind": ('{"status":"found","evidence":{"a":1}}', {None: "status or evidence"}),
    "not": ('{"status":"not_found","evidence":[1]}', {None: "evidence of not_found"}),
    "empty": (found(), {None: "number of quotes"}),
    "five": (found(*[quote("hill")] * 5), {None: "number of quotes"}),
    "items": (found(7, {"source_id": 1}, quote("hill")), {0: "evidence keys", 1: "evidence keys"}),
    "ids": (found(quote("hill", 9), quote("hill", "1"), quote("hill", True)), {0: "source", 1: "source", 2: "source"}),
    "quotes": (found(quote(""), quote(5), quote("y" * 501), quote(" \n")), {0: "quote length", 1: "quote length", 2: "quote length", 3: "empty quote"}),
    "spans": (found(quote("wolf"), quote("The fox"), quote("fox"), quote("hill.")), {0: "quote is not in its source", 1: "quote is there more than once", 2: "quote is there more than once"}),
    "same": (found(quote("the hill"), quote("the  hill")), {1: "duplicate quote"}),
}


def test_each_kind_of_wrong_answer(spark):
    answers = spark.createDataFrame([(k, a) for k, (a, _) in ANSWERS.items()], "k string, raw string").repartition(2)
    sources = spark.createDataFrame([(1, TEXT), (2, "to sleep"), (3, None)], "id int, body string")
    problems, spans = v.quote_answers(answers, sources, "k", "raw", "id", "body")
    got = {k: {} for k in ANSWERS}
    for r in problems.collect():
        got[r.k][r.place] = r.problem
    assert got == {k: want for k, (_, want) in ANSWERS.items()}
    at = {(r.k, r.place): (r.id, r.start, r.stop) for r in spans.collect()}
    assert at["good", 0] == (1, 4, 17) and TEXT[4:17] == "fox  ran\nover" and at["good", 1] == (2, 3, 8)
    assert set(at) == {("good", 0), ("good", 1), ("items", 2), ("spans", 3), ("same", 0)}


PAGES = [("g", 1, "It was a dark and stormy night, and the rain fell."), ("h", 1, "another book with words enough")]


def fact(**more):
    base = {"fact_id": "F1", "subject": "rain", "action": "falls", "temporality": "past", "certainty": "fact", "actors": [{"name": "rain", "role": "target"}], "evidence": [{"page_no": 1, "quote": "a dark and stormy night"}], "related_fact_ids": []}
    return {k: x for k, x in {**base, **more}.items() if x is not ...}


@pytest.mark.parametrize(
    ("facts", "want"),
    [
        ([fact()], set()),
        ([fact(), fact(fact_id="F2", related_fact_ids=["F1"])], set()),
        ([], {(None, "no facts")}),
        ([fact(), fact()], {(1, "fact id")}),
        ([fact(fact_id="")], {(0, "fact id")}),
        ([fact(subject=" ", action=...)], {(0, "subject"), (0, "action")}),
        ([fact(subject=5)], {(0, "subject")}),
        ([fact(temporality="soon", certainty=None)], {(0, "temporality"), (0, "certainty")}),
        ([fact(actors=[])], {(0, "actors")}),
        ([fact(actors=[{"name": "x", "role": "king"}])], {(0, "actors")}),
        ([fact(evidence=[])], {(0, "evidence")}),
        ([fact(evidence=[{"page_no": 2, "quote": "a dark and stormy night"}, {"page_no": "1", "quote": "a dark and stormy night"}])], {(0, "page")}),
        ([fact(evidence=[{"page_no": 1, "quote": "a dark"}])], {(0, "quote length")}),
        ([fact(evidence=[{"page_no": 1, "quote": "another book with words"}])], {(0, "quote is not in its page")}),
        ([fact(related_fact_ids=["F1", "F7"])], {(0, "link to itself"), (0, "unknown link")}),
        ([fact(related_fact_ids=[3])], {(0, "links")}),
        ([fact(related_fact_ids=...)], {(0, "links")}),
    ],
)
def test_fact_graphs(spark, facts, want):
    raw = json.dumps({"schema_version": v.FACT_SCHEMA, "facts": facts})
    graphs = spark.createDataFrame([("g", raw)], "book string, raw string")
    pages = spark.createDataFrame(PAGES, "book string, page int, body string")
    got = {(r.fact, r.problem) for r in v.fact_graphs(graphs, pages, "book", "raw", "page", "body", ("target",)).collect()}
    assert got == want


def test_graphs_that_are_none(spark):
    rows = [("a", "x"), ("b", None), ("c", '{"schema_version":"0","facts":[{}]}'), ("d", '{"schema_version":"' + v.FACT_SCHEMA + '","facts":{}}')]
    pages = spark.createDataFrame([], "book string, page int, body string")
    got = {(r.book, r.problem) for r in v.fact_graphs(spark.createDataFrame(rows, "book string, raw string"), pages, "book", "raw", "page", "body", ("x",)).collect()}
    assert got == {("a", "no strict object"), ("b", "no strict object"), ("c", "schema version"), ("d", "no facts")}
