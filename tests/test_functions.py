import random

import pytest
from pyspark.sql import functions as F

from quire.functions import names, pages, sequential, text


def one(spark, expression, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expression.alias("x")).first().x


def test_titles(spark):
    assert one(spark, text.title_key(F.col("t")), t="【期間限定】ＡＢＣ物語　第3巻") == "ABC物語"
    assert one(spark, text.without_volume(F.col("t")), t="A Tale vol. 12") == "A Tale"
    assert one(spark, text.without_volume(F.col("t")), t="12巻") == ""
    assert one(spark, text.volume(F.col("t")), t="A Tale 7") == 7
    assert one(spark, text.publisher(F.col("t")), t="A Tale (Some House)") == "Some House"
    assert one(spark, text.name_key(F.col("t")), t="  Ｓtraße  X ") == "strasse x"


def test_numbers_and_times(spark):
    assert one(spark, text.money(F.col("t")), t="￥1,234.9") == 1234
    assert one(spark, text.money(F.col("t")), t="free") is None
    assert one(spark, text.money(F.col("t")), t="not available") is None
    with pytest.raises(Exception, match="no amount"):
        one(spark, text.money(F.col("t")), t="1-2")
    assert one(spark, text.effective_price(F.col("a"), F.col("b")), a=100, b=30) == 70
    assert one(spark, text.effective_price(F.col("a"), F.col("b")), a=100, b=130) is None
    assert one(spark, text.ratio_percent(F.col("a"), F.col("b"), F.lit("ok")), a=90, b=180) == 50.0
    assert str(one(spark, text.iso_time(F.col("t")), t="2024-01-02 03:04:05")) == "2024-01-01 18:04:05"
    assert one(spark, text.iso_time(F.col("t")), t="nonsense") is None
    for numeral, n in (("一", 1), ("十", 10), ("十二", 12), ("九十九", 99)):
        assert one(spark, text.kanji_number(F.col("t")), t=numeral) == n
    assert one(spark, text.kanji_number(F.col("t")), t="百") is None


def test_strings(spark):
    assert one(spark, text.percent_encoded(F.col("t")), t="a b/ü") == "a%20b%2F%C3%BC"
    assert one(spark, text.escaped(F.col("t")), t="<b>&<mark>x</mark>'") == "&lt;b&gt;&amp;<mark>x</mark>&#x27;"
    names = ["p10", "p9", "p010b", "p1"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n"))).collect()
    assert [r.n for r in got] == ["p1", "p9", "p10", "p010b"]
    assert one(spark, text.safe_path(F.col("t")), t="a/b..c/d")
    for bad in ("../a", "a\\..\\b", "/a", "C:\\a"):
        assert not one(spark, text.safe_path(F.col("t")), t=bad)
    assert one(spark, text.metric_text(F.col("t")), t="ａ ―...　b") == "a-…b"
    assert one(spark, text.character_error_rate(F.lit(""), F.lit("x"))) is None
    assert one(spark, text.bigram_overlap(F.col("a"), F.col("b")), a="ab, cd", b="xbcd") == 2
    assert one(spark, pages.has_repetition(F.col("t")), t="a line of ten!\n" * 3)
    assert not one(spark, pages.has_repetition(F.col("t")), t="a line of ten!\n" * 2)
    assert one(spark, text.split_list(F.col("t")), t="a、 b,,c") == ["a", "b", "c"]
    assert one(spark, text.expansion_line(F.col("t")), t='2. "some query"') == "some query"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edit_operations_are_shortest_and_lead_to_the_other_text():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(9))) for _ in range(2))
        steps = sequential.edit_operations(a, b)
        assert len(steps) == plain_distance(a, b)
        out, at = [], 0
        for kind, place, _, found in steps:
            out.append(a[at:place])
            at = place
            if kind != "insertion":
                at += 1
            out.append(found)
        assert "".join(out) + a[at:] == b


def test_chunks_cover_the_text():
    text_ = "One sentence here. " * 200
    parts = sequential.chunks(text_)
    assert all(len(p) <= 800 for p in parts) and parts[0][-1] in "!?." or len(parts[0]) == 800
    assert all(p in text_ for p in parts)
    assert sequential.chunks("   ") == []


def test_vote_and_selection():
    assert sequential.vote(["abcd", "abxd", "abxd"], 0) == "abxd"
    assert sequential.vote(["abd", "abcd", "abcd"], 0) == "abcd"
    assert sequential.vote(["abcd", "abd", "abd"], 0) == "abcd"
    assert sequential.vote(["abcd", "abd", "abd", "abd"], 0) == "abd"
    assert sequential.balanced([5, 3, 3, 1], 2) == [0, 1, 1, 0]
    assert sequential.segments([10, 10, 10], 60) == [0, 1, 2]
    assert sequential.segments([10, 10, 100, 1], 84) == [0, 0, 1, 2]
    assert sequential.richest([(1, 5), (2, 50), (3, 7), (4, 5)], 200) == [1, 2, 3, 4]
    assert sequential.richest([(1, 5), (2, 50), (3, 7), (4, 5)], 90) == [1, 3, 4]
    assert sequential.richest([(k, 10 + k % 5) for k in range(1, 14)], 100) == [1, 2, 3, 13]
    with pytest.raises(ValueError):
        sequential.richest([(1, 50), (2, 50)], 60)


def test_sequential_operators(spark):
    df = spark.createDataFrame([(1, "abc", "axc"), (2, "a", None)], "k long, a string, b string")
    assert {tuple(r) for r in sequential.operations(df, "k", "a", "b").collect()} == {(1, "substitution", 1, "b", "x"), (2, "deletion", 0, "a", "")}
    readings = spark.createDataFrame([(1, 0, "abd"), (1, 1, "abcd"), (1, 2, "abcd")], "g long, i int, reading string")
    assert [tuple(r) for r in sequential.consensus(readings, "g", "i", "reading").collect()] == [(1, "abcd")]
    cut = sequential.chunked(spark.createDataFrame([(1, "x. " * 600), (2, None)], "k long, t string"), "k", "t").collect()
    assert {r.k for r in cut} == {1} and len(cut) > 1
    assert spark.range(1).select(sequential.similarity(F.lit("abcd"), F.lit("bcde")).alias("x")).first().x == 0.75


def test_page_rules(spark):
    assert one(spark, pages.has_repetition(F.col("t")), t="abcdefghijkl" * 8) and not one(spark, pages.has_repetition(F.col("t")), t="abcdefghijkl" * 7)
    scattered = " and then ".join(f"{i:05d}abcdefghijkl" for i in range(8))
    assert one(spark, pages.has_repetition(F.col("t")), t=scattered)
    block = "the first line of twenty x\nthe second line of twenty y\n"
    assert one(spark, pages.has_repetition(F.col("t")), t=block + "other\n" + block)
    assert not one(spark, pages.has_repetition(F.col("t")), t=None)
    kind = lambda t, page=50, n=0: one(spark, pages.page_type(F.lit(page), F.lit(100), F.col("t"), F.lit(n)), t=t)
    assert kind("もくじ", 2) == "toc" and kind("第1章 第2章 第3章", 12) == "toc" and kind("第1章 第2章 第3章", 13) == "illustration"
    assert kind("ISBN 発行所") == "colophon_or_ad" and kind("x" * 300) == "narrative" and kind("x" * 100, 3) == "illustration" and kind("x" * 100, 30) == "unknown"
    assert one(spark, pages.risk_flags(F.lit("narrative"), F.lit("x"), F.lit(0), F.lit("田中太郎さんと"), F.lit("田中大郎さんと"))) == ["named_entity_candidate_disagreement"]


def test_names(spark):
    n = lambda t: one(spark, names.character_name(F.col("t")), t=t)
    assert n("「皇太子 田中様」") == "田中" and n("母") is None and n("北国の兵") is None and n("鈴木さんさま（兄）") == "鈴木"
    assert one(spark, names.character_names(F.col("t")), t="田中、鈴木さん,田中様") == ["田中", "鈴木"]
    assert one(spark, names.short_forms(F.col("t")), t="田中太郎") == ["中太郎"] and one(spark, names.short_forms(F.col("t")), t="アルバート・ホー") == ["アルバート"]
    assert one(spark, names.claims(F.col("t")), t="一つ。二つ！\n 三つ ") == ["一つ。", "二つ！", "三つ"]


def test_title_parts(spark):
    assert one(spark, text.title_key(F.col("t")), t="[新装版] 物語／特典付き") == "物語" and one(spark, text.title_key(F.col("t")), t="第3巻") == "第3巻"
    assert one(spark, text.without_volume(F.col("t")), t="物語 第十二巻") == "物語" and one(spark, text.without_volume(F.col("t")), t="物語(上)") == "物語"
    assert one(spark, text.volume(F.col("t")), t="物語 第3巻 (社)") == 3 and one(spark, text.without_number(F.col("t")), t="物語 第3巻 (社)") == "物語  (社)"
    assert one(spark, text.common_prefix(F.col("a"), F.col("b")), a="abcd", b="abx") == 2 and one(spark, text.common_prefix(F.col("a"), F.col("b")), a="", b="x") == 0
    assert one(spark, text.authors_of(F.col("t")), t="[Kindle 版] 石田, 起家、乙  販売: X") == ["石田", "起家", "乙"]
    assert one(spark, text.iso_text(F.col("t")), t="2024-01-02 03:04Z") == "2024-01-02T03:04:00+00:00" and one(spark, text.iso_text(F.col("t")), t="soon") == "soon"


def test_edit_operations_of_long_texts_keep_few_rows():
    rnd = random.Random(5)
    a = "".join(rnd.choice("abcd") for _ in range(700))
    b = a[:100] + "xx" + a[150:400] + "y" + a[401:]
    assert len(sequential.edit_operations(a, b)) == plain_distance(a, b)


def test_book_chunks_belong_to_the_page_they_begin_on():
    got = sequential.book_chunks([(7, "a" * 100), (8, "short"), (9, "b" * 100)], size=120, overlap=20)
    assert got == [(7, 0, "a" * 100 + "b" * 20), (9, 1, "b" * 100)]
