import json

import pytest
from pyspark.sql import functions as F

from quire.sources import readers, writers


def test_csv_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffASIN,Product Name\nB1,\"x, y\"\n".encode())
    df = readers.csv_with_contract(spark, str(tmp_path / "a.csv"), ["ASIN", "Product Name"])
    assert [tuple(r) for r in df.collect()] == [("B1", "x, y")]
    with pytest.raises(readers.ContractError):
        readers.csv_with_contract(spark, str(tmp_path / "a.csv"), ["Price"])


def test_json_and_integers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"id": 1}, {"id": 2}]}))
    assert sorted(r.id for r in readers.json_items(spark, str(tmp_path / "a.json"), "id:long").collect()) == [1, 2]
    (tmp_path / "l.jsonl").write_text('{"id": 1}\n{"id": 1}\n')
    with pytest.raises(readers.ContractError):
        readers.json_lines(spark, str(tmp_path / "l.jsonl"), "id long", "id")
    df = spark.createDataFrame([(bytearray(b"\0\0\1\0\xff\xff\xff\xff\7"),), (bytearray(b"\1"),)], "c binary")
    assert [r.x for r in df.select(readers.packed_integers(F.col("c")).alias("x")).collect()] == [[256, 4294967295], []]
    script = spark.createDataFrame([('var g = {"title": "t;"};',)], "s string")
    assert script.select(readers.assigned_json(F.col("s"), "title string").alias("x")).first().x.title == "t;"


def test_numbered_pages(spark, tmp_path):
    book = tmp_path / "book"
    book.mkdir()
    for n in (1, 2, 10):
        (book / f"{n}.png").write_bytes(bytes([n]))
    with pytest.raises(readers.ContractError):
        readers.numbered_pages(readers.files(spark, str(tmp_path), "*.png", content=True))
    (book / "10.png").rename(book / "3.png")
    got = readers.numbered_pages(readers.files(spark, str(tmp_path), "*.png", content=True)).collect()
    assert sorted((r.folder, r.page_no) for r in got) == [("book", 1), ("book", 2), ("book", 3)]


def test_html_blocks_and_log(spark):
    html = '<div data-label="Text" data-bbox="0 1 20 30"><p>a<b>b</b></p></div><p>no</p><div data-label="Title" data-bbox="1,2,3,4">c<br>d</div>'
    got = readers.html_blocks(spark.createDataFrame([(1, html), (2, None)], "k long, h string"), "k", "h").orderBy("place").collect()
    assert [(r.label, r.box, r.text) for r in got] == [("Text", [0.0, 1.0, 20.0, 30.0], "ab"), ("Title", [1.0, 2.0, 3.0, 4.0], "cd")]
    h, at = "query_hash=0123456789ab", "2024-01-02 03:04:05"
    lines = [
        f"{at} INFO lexical shadow: {h} fts_count=3 icu_count=4 overlap=2 fts_ms=1.5 icu_ms=2",
        f"{at} lexical shadow unavailable: {h} fts_count=3 fts_ms=1.5 icu_ms=2 error_type=X",
        f"2024-01-02T03:04:05 lexical ICU fallback: {h} error_type=X",
        "lexical shadow: query_hash=?",
        "something else",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.kind for r in readers.search_log(df).collect()] == ["success", "unavailable", "fallback", "malformed", "ignore"]
    since = F.lit("2024-01-02 03:04:06").cast("timestamp")
    assert [r.kind for r in readers.search_log(df, since=since).collect()] == ["filtered"] * 4 + ["ignore"]


def test_versions(spark, tmp_path):
    table = writers.Versioned(spark, str(tmp_path / "t"))
    assert table.current() is None
    assert table.write(spark.range(3).toDF("x")) == 1
    assert table.write(spark.range(5).toDF("x"), expected=1) == 2
    with pytest.raises(writers.Conflict):
        table.write(spark.range(9).toDF("x"), expected=1)
    assert table.read().count() == 5 and table.verify()
    assert table.mark_stale() == 3
    with pytest.raises(writers.Conflict):
        table.read()
    assert table.roll_back(1) == 4 and table.read().count() == 3
    df = spark.createDataFrame([(1, "a", None, True), (2, None, 3, False)], "k long, s string, n int, hidden boolean")
    assert {r.k: json.loads(r.entry) for r in writers.entries(df, ["k"], ["hidden"]).collect()} == {1: {"s": "a", "hidden": True}, 2: {"n": 3}}


def test_digest_does_not_depend_on_order(spark):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("s"))
    assert writers.digest(df) == writers.digest(df.orderBy(F.desc("id")).repartition(7))
    assert writers.digest(df) != writers.digest(df.filter("id < 99"))
