import hashlib
import random
import re

from compare import SMALL, assert_same
from pyspark.sql import functions as F

from quire.llm import fim
from quire.llm.queries import ORACLE_SQL, op13_fill_in_middle


def plain(text, key, seed=1, fim_percent=90, spm_percent=20):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < spm_percent:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


EDGES = ["", None, "a", "é", "abc", "a b", "\n\n", "x<P>y", "<S", "S>", "<<S>>", "a<", "<" * 9, "P>" * 5, "日本語 text 🙂🙂 end", "é" * 50 + "abc" * 40, "Ab9cD_é", "[]`@{z"]


def test_rows_as_a_walk_over_characters_gives_them(spark):
    rnd = random.Random(3)
    texts = EDGES + ["".join(rnd.choice("abZ é日🙂<>PSM\n9") for _ in range(rnd.randrange(60))) for _ in range(400)] + ["wörd ab, " * 60_000]
    rows = [(None if i % 50 == 9 else i % 170, t) for i, t in enumerate(texts)] + [(3, "same words"), (3, "same words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as n", "'x' as form", "1 as other").repartition(3)
    out = fim.fill_in_middle(df).withColumn("back", fim.restored())
    assert out.columns == ["doc_id", "text", "other", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    found = out.collect()
    assert len(found) == len(rows) and {r.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.text, r.doc_id), r.text
        assert r.back == (r.text or "")
    assert fim.fill_in_middle(df.limit(0)).collect() == []


def test_shares_of_forms_and_seeds(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words to cut").alias("text"))
    got = {r.form: r["count"] for r in fim.fill_in_middle(df).groupBy("form").count().collect()}
    assert abs(got["plain"] - 400) < 100 and abs(got["spm"] - 720) < 130
    assert {r.form for r in fim.fill_in_middle(df, fim_percent=0).select("form").distinct().collect()} == {"plain"}
    one, two = (fim.fill_in_middle(df, seed=s).agg(F.sum("prefix_chars")).first()[0] for s in (1, 2))
    assert one != two


def test_select_finds_each_bit():
    rnd = random.Random(4)
    for width in (1, 2, 3, 7, 64, 65, 1000):
        bits = rnd.getrandbits(width)
        at = [i for i in range(width) if bits >> (width - 1 - i) & 1]
        assert [fim.select(bits, width, k) for k in range(len(at) + 2)] == at + [width, width]


def test_query_gives_the_rows_of_its_sql(spark):
    assert_same(op13_fill_in_middle(spark, SMALL), ORACLE_SQL["op13_fill_in_middle"])
