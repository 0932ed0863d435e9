import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import aggregates
from quire.sources import documents, readers


def test_texts_in_the_first_encoding_that_fits(spark, tmp_path):
    bodies = {"a": "﻿name,価格\n".encode(), "b": "価格,表示".encode("cp932"), "c": b"\xe3\x81\xff\x00\x81"}
    for k, v in bodies.items():
        (tmp_path / k).write_bytes(v)
    got = {r.name: r.text for r in readers.texts(spark, str(tmp_path)).collect()}

    def plain(data):
        for e in readers.ENCODINGS:
            try:
                return data.decode(e)
            except UnicodeDecodeError:
                pass
        return data.decode("utf-8", "replace")

    assert got == {k: plain(v) for k, v in bodies.items()} and got["a"] == "name,価格\n" and got["b"] == "価格,表示"


def test_files_of_several_kinds_and_a_ledger(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "genres.csv").write_text('ASIN,Genre\nB1,"a, b"\n,none\nB2,c\n')
    (tmp_path / "authors.csv").write_bytes("ASIN,Author Name\nB1,著者\n".encode("cp932"))
    (tmp_path / "other.csv").write_text("ASIN\nB9\n")
    kinds = {"genres.csv": ("genre", "ASIN"), "authors.csv": ("author", "ASIN"), "series.csv": ("series", "item-ASIN")}
    rows, told = readers.csv_kinds(spark, str(tmp_path), kinds)
    assert {(r.key, r.fields["Genre"]) for r in rows["genre"].collect()} == {("B1", "a, b"), ("B2", "c")}
    assert [r.fields["Author Name"] for r in rows["author"].collect()] == ["著者"] and rows["series"].count() == 0
    assert {(r.kind, r.name, r.status, r.records, r.missing) for r in told.collect()} == {("genre", "genres.csv", "success", 2, 1), ("author", "authors.csv", "success", 1, 0)}
    rows, again = readers.csv_kinds(spark, str(tmp_path), kinds, told.filter("kind = 'genre'"))
    assert {(r.kind, r.status) for r in again.collect()} == {("genre", "skipped"), ("author", "success")} and rows["genre"].count() == 0


def case(**more):
    return {"id": "c1", "query": " find it ", "source": "s", "scope": {"type": "all"}, "relevant": [{"book_name": "b", "page_no": 1, "grade": 3}], **more}


def page(**more):
    return [{"book_name": "b", "page_no": 1, "grade": 3, **more}]


@pytest.mark.parametrize(
    ("cases", "problem"),
    [
        ([case(id="")], "no id"),
        ([case(), case()], "case 2 (c1): repeated id"),
        ([case(query="  ")], "empty query"),
        ([case(scope={"type": "shelf"})], "scope"),
        ([case(scope={"type": "book"})], "scope without a book"),
        ([case(relevant=[])], "no relevant pages"),
        ([case(relevant=page(page_no=-1))], "relevant page"),
        ([case(relevant=page(book_name=" "))], "relevant page"),
        ([case(relevant=page(grade=4))], "grade"),
        ([case(relevant=page() * 2)], "relevant page twice"),
        ([], "has no cases"),
    ],
)
def test_wrong_evaluation_cases(spark, tmp_path, cases, problem):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps({"schema_version": "v1", "cases": cases}))
    with pytest.raises(readers.ContractError, match=problem.replace("(", r"\(").replace(")", r"\)")):
        readers.evaluation_cases(spark, str(path), "v1")


def test_evaluation_cases(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps({"schema_version": "v1", "cases": [case(), case(id="c2", scope={"type": "book", "book_name": "x"}), case(id="c3", scope=None)]}))
    got = {r.id: (r.query, r.scope_book, len(r.relevant)) for r in readers.evaluation_cases(spark, str(path), "v1").collect()}
    assert got == {"c1": ("find it", None, 1), "c2": ("find it", "x", 1), "c3": ("find it", None, 1)}
    with pytest.raises(readers.ContractError):
        readers.evaluation_cases(spark, str(path), "v2")


def test_documents_are_put_whole(spark, tmp_path):
    path = f"file://{tmp_path}/meta.json"
    df = spark.createDataFrame([("b", 2, None), ("a", 1, [1])], "k string, n int, l array<int>")
    documents.write_json(df, path, "k")
    assert json.loads((tmp_path / "meta.json").read_text()) == {"a": {"n": 1, "l": [1]}, "b": {"n": 2}}
    documents.write_json(df.filter("n = 1"), path)
    assert json.loads((tmp_path / "meta.json").read_text()) == [{"k": "a", "n": 1, "l": [1]}]
    assert [p.name for p in tmp_path.iterdir() if p.suffix != ".crc"] == ["meta.json"]
    vectors = spark.createDataFrame([(1, [0.5, 1.0]), (2, [2.0, 3.0])], "id int, v array<double>")
    documents.write_npz({"chunks": vectors}, f"file://{tmp_path}/v.npz")
    with np.load(tmp_path / "v.npz") as z:
        assert z["chunks_v"].shape == (2, 2) and z["chunks_id"].tolist() == [1, 2]
    with pytest.raises(Exception, match="(?i)exist"):
        documents.write_npz({"chunks": vectors}, f"file://{tmp_path}/v.npz")


def test_ranks_by_ranges(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.choice([7.0, rnd.random() * 100])) for g in ("a", "b", None) for _ in range(200)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {(r.g, r.p): r.v for r in aggregates.nearest_rank_by_ranges(df, ["g"], "v", [0.0, 0.5, 0.95, 1.0]).collect() if r.g}
    want = {}
    for g in "abc":
        values = sorted(v for k, v in rows if k == g and v is not None)
        want |= {(g, p): values[max(1, -(-int(p * 100) * len(values) // 100)) - 1] for p in (0.0, 0.5, 0.95, 1.0)}
    assert got == want


def test_heads(spark):
    assert spark.sql("select array(3,2,1) as a").select(readers.head(F.col("a"), 2).alias("h")).first().h == [3, 2]
