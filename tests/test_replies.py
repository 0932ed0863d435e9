import json

from pyspark.sql import functions as F

from quire.operators import replies


def test_text_between_fences(spark):
    cases = {"no fence": "no fence", "a\n```json\n[1]\n```\nb": "[1]", "```\nx\n```\ny\n```\nz": "x\nz", "``` inline": "", "```\r\nq\r\n```": "q"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.u for r in df.select("t", replies.unfenced(F.col("t")).alias("u")).collect()} == cases


def test_pairs_of_replies(spark):
    item = lambda a, b, r: {"char_a": a, "char_b": b, "relation": r}
    rows = [
        (1, json.dumps([item(" Ann ", "Bob", "friends"), item("Ann", "Ann", "self"), item("", "Bob", "x"), item("Ann", "Bob", ""), "text", {"char_a": "Ann"}, item("Ann", "Cid", "r" * 30), item(1, 2, "n")])),
        (2, "```json\n" + json.dumps([item("X", "Y", "z")]) + "\n```"),
        (3, "{}"),
        (4, "no json"),
        (5, None),
    ]
    got = {(r.k, r.a, r.b, r.relation) for r in replies.relation_pairs(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert got == {(1, "Ann", "Bob", "friends"), (1, "Ann", "Cid", "r" * 20), (1, "1", "2", "n"), (2, "X", "Y", "z")}


def test_sheets_with_marks(spark):
    sheets = [(1, 1, "x [BOOK_FACTS] one\n [CHARACTER_FACT: Ann] a1 [CHARACTER_FACT:Bob] 該当事実なし。 [CHARACTER_FACT:Ann] a2 "), (1, 2, "[BOOK_FACTS]two[CHARACTER_FACT:Ann]a3"), (2, 1, "nothing"), (2, 2, None)]
    df = spark.createDataFrame(sheets, "b int, n int, t string")
    books, characters = replies.fact_sheets(df, ["b", "n"], "t")
    assert {(r.b, r.n): r.facts for r in books.collect()} == {(1, 1): "one", (1, 2): "two", (2, 1): "", (2, 2): None}
    merged, people = replies.merged_sheets(books, characters, "b", "n")
    assert [(r.b, r.facts) for r in merged.collect()] == [(1, "one\n\ntwo")]
    assert [(r.b, r["name"], r.facts) for r in people.collect()] == [(1, "Ann", "a1\na2\na3")]


def reply(claims, verdict="pass", missing=()):
    return json.dumps({"claims": claims, "coverage": {"verdict": verdict, "missing_facts": list(missing)}})


def claim(**more):
    return {"id": 1, "verdict": "supported", "evidence_pages": [3], "reason": "seen", **more}


def test_each_wrong_judgement(spark):
    cases = {
        "good": (reply([claim(), claim(id=2, verdict="unsupported", evidence_pages=[])]), set()),
        "json": ("[]", {(None, "no strict object")}),
        "claims": ('{"coverage":{"verdict":"pass","missing_facts":[]}}', {(None, "claims")}),
        "coverage": ('{"claims":[]}', {(None, "coverage")}),
        "pass": (reply([], "pass", ["x"]), {(None, "pass with missing facts")}),
        "fail": (reply([], "fail"), {(None, "fail without missing facts")}),
        "ids": (reply([claim(), claim(), claim(id=3), claim(id="2")]), {(1, "claim id"), (3, "claim id"), (None, "claim id")}),
        "rest": (reply([claim(verdict="maybe"), claim(id=2, reason=" ")]), {(1, "verdict"), (2, "no reason")}),
        "pages": (reply([claim(evidence_pages=[9]), claim(id=2, evidence_pages=[])]), {(1, "page outside"), (2, "no evidence page")}),
        "kinds": (reply([claim(evidence_pages="3"), claim(id=2)]), {(1, "evidence pages")}),
        "omitted": (reply([claim(id=2)]), {(1, "omitted")}),
    }
    df = spark.createDataFrame([(k, t, 2, [3, 4]) for k, (t, _) in cases.items()], "k string, t string, n int, pages array<bigint>")
    judged, problems = replies.claim_judgements(df, "k", "t", "n", "pages")
    got = {k: set() for k in cases}
    for r in problems.collect():
        got[r.k].add((r.id, r.problem))
    assert got == {k: want for k, (_, want) in cases.items()}
    assert [(r.k, r.id, r.verdict, r.pages, r.passed) for r in judged.orderBy("id").collect()] == [("good", 1, "supported", [3], False), ("good", 2, "unsupported", [], False)]
