import zlib

from pyspark.sql import functions as F

from quire.llm import language
from quire.llm.queries import op2_language_id

FOLDER = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = op2_language_id(spark, FOLDER).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_other_scripts_and_empty_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.fit(docs, "text", "lang", ["doc_id"])
    texts = [None, "", "123 !?", "これは日本語の文章です。" * 20, "Это русский текст, совсем другой. " * 20, docs.filter("lang = 'fr'").first().text * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("score", F.lit("clash"))
    got = {r.i: r for r in language.identify(df, model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and all(got[i].rejected and got[i].score == 0 for i in range(3))
    assert got[3].rejected and got[4].rejected and got[3].lang_pred in model.labels
    assert got[5].lang_pred == "fr" and not got[5].rejected


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.fit(df, "text", "lang", ["doc_id"]) is None
    assert [r.lang_pred for r in language.identify(df, None).collect()] == ["und"]
    assert language.identify(df.limit(0), None).collect() == []


def test_several_centroids_per_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.fit(docs, "text", "lang", ["doc_id"])
    assert model.centroids.shape[0] == language.CENTROIDS * len(model.labels)
    assert abs((model.centroids**2).sum(1) - 1).max() < 1e-3


def plain_counts(text):
    """Buckets of all n-grams, one n-gram at a time."""
    import regex

    letters = [ord(c) if regex.match(r"[\p{L}\p{M}]", c) else 32 for c in f" {text.lower()} "]
    c = [x for i, x in enumerate(letters) if x != 32 or not i or letters[i - 1] != 32]
    out = [0] * language.BUCKETS
    for n in language.ORDERS:
        for i in range(len(c) - n + 1):
            h = 0
            for x in c[i : i + n]:
                h = (h + x) * 0x9E3779B97F4A7C15 % (1 << 64)
                h ^= h >> 31
            out[(h >> 40) % language.BUCKETS] += 1
    return out


def plain_nearest(text, model):
    """The label of the centroid with the largest cosine, and that cosine, by sums over buckets."""
    import math

    x = [math.log1p(n) * w for n, w in zip(plain_counts(text), model.idf)]
    norm = math.sqrt(sum(v * v for v in x)) or 1.0
    cosines = [sum(v * w for v, w in zip(x, c) if v) / norm for c in model.centroids.tolist()]
    best = max(range(len(cosines)), key=lambda i: cosines[i])
    return model.labels[model.of[best]], cosines[best]


def test_predictions_as_by_a_plain_nearest_centroid(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.fit(docs, "text", "lang", ["doc_id"])
    some = docs.filter("length(text) < 700").limit(25).unionByName(docs.limit(1).withColumn("text", F.lit("İé ß  \n12 ÀB Ünï—cödé")))
    rows = language.identify(some, model).select("text", "lang_pred", "score").collect()
    assert len(rows) == 26
    for r in rows:
        label, cosine = plain_nearest(r.text, model)
        assert (r.lang_pred, abs(r.score - min(max(cosine, 0), 1)) < 1e-4) == (label, True), r.text


def test_counts_of_a_long_text_in_pieces(monkeypatch):
    text = "Ein längerer Text, in Stücken gezählt. " * 60
    whole = language.ngram_counts(text)
    assert whole.tolist() == plain_counts(text)
    monkeypatch.setattr(language, "PIECE", 500)
    apart = abs(language.ngram_counts(text) - whole).sum()
    assert apart <= 12 * (len(text) // 500 + 1)  # only n-grams at the cuts


def test_rows_that_repeat_are_alike(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40)
    model = language.fit(docs.unionByName(docs.filter("doc_id = 0")), "text", "lang", ["doc_id"])
    got = {}
    for r in language.identify(docs.unionByName(docs), model).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score, r.rejected))
    assert all(len(v) == 2 and v[0] == v[1] for v in got.values())
