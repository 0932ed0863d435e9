import pytest
from pyspark.sql import functions as F

from quire.operators import audits, records


def test_indexes_for_one_or_all():
    assert records.assigned_index(["a", "b"], 2.0, "T") == [("a", 2.0), ("b", 2.0)]
    assert records.assigned_index(["a", "b"], [1.0, 5.0], "T") == [("a", 1.0), ("b", 5.0)]
    for names, index, title in ((["a"], [1.0, 2.0], "T"), ([], 1.0, "T"), (["a"], 1.0, "  ")):
        with pytest.raises(ValueError):
            records.assigned_index(names, index, title)


def test_series_are_assigned_to_the_named_records(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "old", 9.0), ("c", "old", 3.0)], "name string, series_title string, series_index double")
    got = {r.name: (r.series_title, r.series_index) for r in records.assign_series(df, ["a", "b"], [1.0, 2.5], " New ", "name").collect()}
    assert got == {"a": ("New", 1.0), "b": ("New", 2.5), "c": ("old", 3.0)}


def test_limits_of_a_history(spark):
    df = spark.range(600)
    assert [r.id for r in records.history(df, "id", 2).collect()] == [599, 598]
    for limit in (0, 501):
        with pytest.raises(ValueError):
            records.history(df, "id", limit)


def test_margins_and_blank_corrections(spark):
    rows = [(299, 10, 50), (300, 5, 50), (300, 6, 50), (300, 45, 50), (300, 46, 50)]
    df = spark.createDataFrame(rows, "n int, p int, k int")
    assert [r.s for r in df.select(records.skips_context(F.col("n"), F.col("p"), F.col("k")).alias("s")).collect()] == [True, True, False, False, True]
    pages = spark.createDataFrame([(True, "narrative", "normal_prose", "r", "x"), (True, "narrative", "normal_prose", "r", " 　"), (None, "narrative", "normal_prose", "r", "x"), (True, "toc", "normal_prose", "r", "x")], "a boolean, t string, l string, e string, c string")
    assert [r.s for r in pages.select(records.tuning_page(F.col("a"), F.col("t"), F.col("l"), F.col("e"), "r", F.col("c")).alias("s")).collect()] == [True, False, False, False]


def test_folded_order_topics_and_clocks(spark):
    df = spark.createDataFrame([("b",), ("A",), ("a",), ("B",)], "p string")
    assert [r.p for r in records.case_folded(df, "p").collect()] == ["A", "a", "B", "b"]
    topics = spark.createDataFrame([(1, "x", "y"), (2, "z", "x"), (3, "y", "z"), (1, "y", "x")], "topic int, s string, r string")
    assert {r.topic for r in records.per_participant(topics, "x", "s", "r", "topic").collect()} == {1, 2}
    ts = spark.sql("select timestamp_ntz'2024-01-01 20:30:00' as t")
    assert ts.select(records.wall_clock(F.col("t")).alias("x")).first().x == "2024-01-02 05:30:00"


def test_an_empty_reference_is_an_error(spark):
    df = spark.createDataFrame([(1, "g", "", "x")], "id int, g string, r string, h string")
    with pytest.raises(Exception, match="no reference text: 1"):
        records.grouped_error_report(df, "g", "r", "h", "id").collect()


def test_terms_are_counted_without_overlaps_and_gates_need_all(spark):
    df = spark.createDataFrame([("aaa", "aa"), ("abab", "ab"), ("x", ""), (None, "a")], "t string, w string")
    assert [r.n for r in df.select(audits.occurrences(F.col("t"), F.col("w")).alias("n")).collect()] == ["aaa".count("aa"), 2, 0, 0]
    none = spark.createDataFrame([], "digest string, term string, expected long, actual long, matched long, missing long")
    problems = spark.createDataFrame([], "digest string, term string, problem string")
    got = {r.check: r.passed for r in audits.term_gate(none, problems, 1, 1, 0.5, 0).collect()}
    assert got == {"resolved": True, "terms": False, "expected": False, "recall": False, "missing": True}
