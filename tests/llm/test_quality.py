import re
import tracemalloc
import zlib

import numpy as np
from compare import SMALL, assert_same
from pyspark.sql import functions as F

from quire.llm import cotrain, line_clean
from quire.llm.queries import ORACLE_SQL, op6_cotrained_quality, op8_line_rules

FOLDER = "/root/testdata/sf0.01"


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    return len(words), len("".join(words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), failed


TEXTS = [
    None,
    "",
    " \n\n",
    "a b c a b c",
    "word " * 60,
    "One two three. " * 3 + "\n" + "x. y. z. é漢 <tag> #1\n" * 4,
    "\n".join(f"Sentence number {i} says this and that." for i in range(30)),
    "\n".join(f"Sentence number {i} says this and that." for i in range(30)) + "\nHome | About | News | Contact\nAll rights reserved.",
    "\n".join("Home | About | News | Contact" for _ in range(30)),
    " wide space\x0b tab\x0c " * 30,
]


def test_counts_as_by_hand_and_verdicts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = {r.doc_id: r for r in line_clean.clean_lines(df).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(t), i
        assert not (r.kept and r.base_failed)
    assert got[7].n_lines_removed == 2 and got[7].clean_text == TEXTS[6] and got[7].kept == got[6].kept
    assert not got[8].kept
    assert line_clean.clean_lines(df.limit(0)).collect() == []


def test_long_text():
    row = line_clean.examine("A sentence of six words, here. " * 50_000, line_clean._Words())
    assert row["n_words"] == 300_000 and row["n_repeat_words"] == 300_000 and row["base_failed"]


def test_rules_query_gives_the_rows_of_its_sql(spark):
    assert_same(op8_line_rules(spark, SMALL), ORACLE_SQL["op8_line_rules"])


def test_clean_documents_stay_and_junk_goes(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = op8_line_rules(spark, FOLDER).join(labels, "doc_id").filter("not base_failed").collect()
    clean, junk = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert sum(r.kept for r in junk) <= 0.1 * len(junk)


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = cotrain.train(docs, labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    rows = [r for r in cotrain.score(docs, model).join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(rows) > 40
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.95 * len(rows)
    assert sum(r.kept for r in rows if r.quality == 1) >= 0.98 * sum(r.quality == 1 for r in rows)


def test_views_label_for_each_other():
    import numpy as np

    rnd = np.random.default_rng(1)
    y = rnd.integers(0, 2, 4000)
    x = rnd.normal(size=(4000, 5)) + y[:, None] * 1.5
    m = rnd.normal(size=(4000, 4)) + y[:, None] * 0.9
    few = slice(0, 60)
    alone = cotrain.co_train(x[few], m[few], y[few].astype(float), x[:0], m[:0])
    both = cotrain.co_train(x[few], m[few], y[few].astype(float), x[60:2000], m[60:2000])
    right = lambda v: ((v.score(x[2000:], m[2000:])[:, 0] > 0.5) == y[2000:]).mean()
    assert right(both) >= right(alone) - 0.005 and right(both) > 0.93


def test_a_fit_holds_little_beside_its_rows():
    rng = np.random.default_rng(8)
    x = rng.random((20_000, 100), np.float32)
    y = (x[:, 0] + 0.3 * rng.standard_normal(len(x)) > 0.5).astype(float)
    tracemalloc.start()
    w = cotrain.fit_logistic(x, y, np.ones(len(x)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # x as 64-bit numbers is 16 MB
    rows = np.concatenate((x.astype(np.float64), np.ones((len(x), 1))), 1)
    gradient = rows.T @ (1 / (1 + np.exp(-rows @ w)) - y) + np.append(w[:-1], 1e-6 * w[-1])
    assert np.abs(gradient).max() < 1e-3 and w[0] > 3


def test_a_round_that_hurts_is_not_kept():
    import numpy as np

    rnd = np.random.default_rng(2)
    y = rnd.integers(0, 2, 400).astype(float)
    x, m = rnd.normal(size=(400, 3)) + y[:, None] * 2, rnd.normal(size=(400, 3)) + y[:, None]
    wrong = lambda weights, most: {v: (np.concatenate([{"x": x, "m": m}[v][y == 1]] * 4), np.zeros(4 * int(y.sum()))) for v in "xm"}
    spoilt, alone = cotrain.co_train_by(x, m, y, wrong, 2), cotrain.co_train(x, m, y, x[:0], m[:0])
    assert [r[v]["accepted"] for r in spoilt.rounds for v in "xm"] == [False] * 4
    assert np.allclose(spoilt.text, alone.text) and np.allclose(spoilt.metadata, alone.metadata)


def test_metadata_alone_tells_something_and_the_sum_is_best(spark):
    import numpy as np

    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = cotrain.train(docs.filter("doc_id % 4 < 2"), labels.filter("doc_id % 4 = 0"))
    rows = cotrain.score(docs.filter("doc_id % 4 = 1"), model).join(labels, "doc_id").collect()
    y = np.array([r.quality for r in rows])

    def loss(name):
        p = np.clip([r[name] for r in rows], 1e-6, 1 - 1e-6)
        return -np.log(np.where(y == 1, p, 1 - p)).mean()

    order = np.argsort([r.score_metadata for r in rows])
    ranks = np.empty(len(y))
    ranks[order] = np.arange(len(y))
    area = (ranks[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert area > 0.7 and loss("score") < loss("score_metadata") and loss("score") < loss("score_text") + 0.01


def test_rows_that_repeat_a_labelled_id_count_once(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    hot = labels.filter("quality = 1").first().doc_id
    many = docs.unionByName(docs.filter(F.col("doc_id") == hot).withColumn("text", F.explode(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.concat("text", i.cast("string"))))))
    seen = []
    by = cotrain.co_train_by
    monkeypatch.setattr(cotrain, "co_train_by", lambda x, m, y, *a: seen.append(len(y)) or by(x, m, y, *a))
    assert cotrain.train(many, labels) is not None
    assert seen == [labels.filter("quality is not null").select("doc_id").distinct().count()]


def test_all_unlabelled_rows_take_part(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(cotrain, "MAX_POOL", 10, raising=False)
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(5), spark.read.parquet(f"{FOLDER}/labels.parquet")
    some, metadata = labels.filter("doc_id % 3 = 0"), ("source", "lang", "n_chars")
    got = cotrain.train(docs, some)
    of = {r.doc_id: float(r.quality) for r in some.filter("quality is not null").collect()}
    rows = docs.orderBy(F.xxhash64("doc_id", F.lit("quality"))).toArrow()
    x = np.stack([cotrain.text_features(t) for t in rows["text"].to_pylist()])
    m = cotrain.metadata_features({c: rows[c].combine_chunks() for c in metadata}, rows["text"].to_pylist()).astype(np.float32)
    y = np.array([of.get(i, np.nan) for i in rows["doc_id"].to_pylist()])
    known = np.flatnonzero(~np.isnan(y))
    known = known[np.argsort([cotrain.xxhash.xxh3_64_intdigest(x[i].tobytes() + m[i].tobytes()) for i in known], kind="stable")]
    want = cotrain.co_train(x[known], m[known], y[known], x[np.isnan(y)], m[np.isnan(y)])
    assert np.allclose(got.text, want.text, atol=1e-6) and np.allclose(got.metadata, want.metadata, atol=1e-6)
    alone = cotrain.co_train(x[known], m[known], y[known], x[:0], m[:0])
    assert not np.allclose(want.text, alone.text, atol=1e-2)
    assert len(got.rounds) == len(want.rounds) == cotrain.ROUNDS
    for a, b in zip(got.rounds, want.rounds):
        assert all(a[v]["given"] == b[v]["given"] and a[v]["accepted"] == b[v]["accepted"] for v in "xm")


def test_no_labels_nulls_and_clashes(spark):
    schema = "doc_id long, text string, source string, lang string, n_chars long, score string"
    df = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "", "s", "en", 0, "y")], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert cotrain.train(df, none) is None
    assert [(r.score, r.kept) for r in cotrain.score(df, None).collect()] == [(None, True)] * 2
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = cotrain.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert all(0 <= r.score <= 1 for r in cotrain.score(df, model).collect())
    assert cotrain.score(df.limit(0), model).collect() == []


def test_quality_query_scores_every_document(spark):
    got = op6_cotrained_quality(spark, SMALL)
    assert got.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
