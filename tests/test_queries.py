import pytest
from compare import SMALL, assert_same
from pyspark.sql import functions as F

from quire.plans.all import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLE_SQL[name])


def test_hybrid_search(spark):
    hits = QUERIES["hybrid_search"](spark, SMALL).collect()
    assert 0 < len(hits) <= 10
    assert [h.score for h in hits] == sorted((h.score for h in hits), reverse=True)
    per_book = {}
    for h in hits:
        per_book[h.book] = per_book.get(h.book, 0) + 1
    assert max(per_book.values()) <= 3


def rows(spark, name):
    return [tuple(r) for r in QUERIES[name](spark, SMALL).collect()]


def test_page_chunks_are_those_of_a_plain_cutter(spark):
    def cut(text, size=800, overlap=50):
        if len(text) <= size:
            return [text.strip()] if text.strip() else []
        out, start = [], 0
        while True:
            end = min(start + size, len(text))
            if end < len(text):
                end = next((j for j in range(end, max(start + size - 100, start + 1), -1) if text[j - 1] in "。」!?"), end)
            if text[start:end].strip():
                out.append(text[start:end].strip())
            if end >= len(text):
                return out
            start = max(end - overlap, start + 1)

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {}
    for doc, i, part in sorted(rows(spark, "page_chunks")):
        got.setdefault(doc, []).append(part)
    assert got == {k: c for k, t in docs.items() if (c := cut(t))}


def test_book_chunks_begin_on_their_page(spark):
    turns = {}
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        if len(r.text or "") >= 30:
            turns.setdefault(r.conv_id, []).append((r.turn, r.text))
    for book, page, i, part in rows(spark, "book_chunks"):
        whole, begins = "", {}
        for t, x in turns[book]:
            begins[t] = len(whole)
            whole += x
        at = [k for k in range(len(whole)) if whole.startswith(part, k)]
        assert len(part) <= 300 and any(max(t for t, b in begins.items() if b <= k) == page or whole[k - 1 : k].isspace() for k in at)


def test_edit_histogram_counts_every_difference(spark):
    counted = {(r[0], r[3], r[4]): r[5] for r in rows(spark, "edit_histogram")}
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert counted == {("insertion", "", "x"): len(texts), ("deletion", "h", ""): sum(t.count("th") for t in texts)}


def test_budgeted_evidence_by_a_plain_selection(spark):
    used = {(r.event_id % 97 * 13 % 400 + 100, r.user_id % 5, r.event_id % 20, r.event_id % 97) for r in spark.read.parquet(f"{SMALL}/events.parquet").collect()}
    want = set()
    for book in {u[1] for u in used}:
        claims, chars = {}, {}
        for n, b, claim, page in used:
            if b == book:
                claims.setdefault(claim, set()).add(page)
                chars[page] = n
        chosen = {p for pages in claims.values() for p in sorted(pages)[:2]}
        total = sum(chars[p] for p in chosen)
        for p in sorted(set(chars) - chosen, key=lambda p: (-sum(p in c for c in claims.values()), p)):
            if len(chosen) < 12 and total + chars[p] <= 3000:
                chosen.add(p)
                total += chars[p]
        want |= {(book, p) for p in chosen}
    assert set(rows(spark, "budgeted_evidence")) == want


def test_cells_find_nine_of_ten_neighbours(spark):
    from quire.operators import ann, search

    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    found = ann.centroids(e, "vec_id", "embedding", 16)
    cells = ann.assigned(e, "embedding", found).cache()
    assert cells.count() == e.count()
    both = n = 0
    for r in e.filter("vec_id % 50 = 0").collect():
        want = {x.vec_id for x in search.knn(e, r.embedding, 10, "vec_id").collect()}
        both, n = both + len(want & {x.vec_id for x in ann.search(cells, found, r.embedding, 10, "vec_id", probes=12).collect()}), n + 10
    assert both >= 0.9 * n


def test_entry_and_keys(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["page_id", "book", "page_no", "score", "snippet"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_guards_fail_when_they_should(spark):
    from quire.operators import reports, sets

    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "id long, digest string, v string")
    moved = spark.createDataFrame([(1, "x", "p"), (2, "z", "q")], "id long, digest string, v string")
    lacking = a.filter("id = 1")
    assert reports.guarded(a, a, "id", "digest").count() == 2
    for report in (moved, lacking):
        with pytest.raises(Exception, match="no such input: 2"):
            reports.guarded(report, a, "id", "digest").collect()
        with pytest.raises(Exception, match="predictions do not pair: 2"):
            reports.paired(a, report, "id", "digest", {"v": ("v", "v")}).collect()
    with pytest.raises(Exception, match="not uniform"):
        reports.uniform(a, ["digest"]).collect()
    assert sets.same_keys(a, lacking, "id").first().equal is False and sets.same_keys(a, a, "id").first().equal is True


def test_parts_are_looked_for_by_their_rarest_gram(spark):
    from quire.operators import joins

    texts = [(i, f"common start {i % 10} and {i}") for i in range(60)] + [(100, None), (101, "ab")]
    parts = ["common start 3", "and 5", "common", "mon", "absent common", "ab"]
    df = spark.createDataFrame(texts, "id long, t string")
    got = {(r.id, r.p) for r in joins.containing(df, "id", "t", spark.createDataFrame([(p,) for p in parts], "p string"), "p").collect()}
    assert got == {(i, p) for i, t in texts for p in parts if t and len(p) >= 3 and p in t}


def test_numbers_that_share_their_digits_are_found_by_longer_grams(spark):
    """Names that differ in some digits alone: what is compared must not grow with the square of their number."""
    from quire.operators import joins

    names = spark.range(4000).selectExpr("id", "'Name#' || lpad(id * 7919 % 1000000, 9, '0') as p")
    found = joins.containing(names, "id", "p", names.select("p"), "p")
    compared = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in compared
    assert found.count() == 4000
    assert joins.containing(names, "id", "p", names.selectExpr("substr(p, 2) as p"), "p").count() == 4000


def test_related_items_are_limited_before_the_join(spark):
    from quire.operators import joins

    rows = [(i, None if i % 11 == 0 else f"s{i % 3}", [i % 7, i % 5 + 10], None if i % 4 == 0 else i % 6) for i in range(120)]
    items = spark.createDataFrame(rows, "item long, series string, authors array<long>, volume long")
    found = joins.related(items, items.filter("item % 9 = 2 or item = 22"), "item", "series", "authors", "volume", 3, 4)
    want = set()
    for i, s, a, _ in (r for r in rows if r[0] % 9 == 2 or r[0] == 22):
        same = sorted((r[3] is None, r[3] or 0, r[0]) for r in rows if s is not None and r[1] == s and r[0] != i)[:3]
        other = sorted(r[0] for r in rows if r[0] != i and (s is None or r[1] is None or r[1] != s) and set(a) & set(r[2]))[:4]
        want |= {(i, x[2], "series", k) for k, x in enumerate(same, 1)} | {(i, x, "author", k) for k, x in enumerate(other, 1)}
    assert {(r.of, r.item, r.why, r.rank) for r in found.collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") >= 5


def test_pairs_meet_by_what_they_must_have_in_common(spark):
    from quire.operators import joins

    rows = [(i, i % 2, f"t{i % 5}", [i % 6, i % 4] if i % 9 else None) for i in range(60)]
    left, right = (spark.createDataFrame(rows, "i long, block long, t string, a array<long>").select("block", *[F.col(c).alias(f"{c}_{x}") for c in "ita"]) for x in "ab")
    rules = [(F.col("t_a") == F.col("t_b"), 100), (F.arrays_overlap("a_a", "a_b"), 20)]
    keys = [(F.array("t_a"), F.array("t_b")), (F.col("a_a"), F.col("a_b"))]
    of = lambda df: sorted((r.i_a, r.i_b, r.score) for r in df.collect())
    every = joins.candidate_scores(left, right, "block", rules, 0)
    assert of(joins.candidate_scores(left, right, "block", rules, 0, keys, ("i_a", "i_b"), F.col("i_a") < F.col("i_b"))) == [x for x in of(every) if x[0] < x[1]]


def test_pairs_are_scored_where_they_are_found(spark, monkeypatch):
    from quire.operators import joins

    rows = [(k, None if i % 31 == 0 else i % 2, None if i % 13 == 0 else f"t{i % 5}{i % 3}", None if i % 9 == 0 else [i % 6, None, i % 4, i % 6]) for i in range(90) for k in ([i, i] if i == 40 else [None] if i == 41 else [i])]
    df = spark.createDataFrame(rows, "i long, block long, t string, a array<long>")
    rules = [(F.array("t"), 100), (F.array(F.substring("t", 1, 2)), 15), (F.col("a"), 20)]

    def score(x, y):
        t = x[2] is not None and y[2] is not None
        return 100 * (t and x[2] == y[2]) + 15 * (t and x[2][:2] == y[2][:2]) + 20 * bool((set(x[3] or ()) & set(y[3] or ())) - {None})

    every = sorted((x[0], y[0], score(x, y)) for x in rows for y in rows if None not in (x[0], y[0], x[1]) and x[1] == y[1] and x[0] < y[0])
    got = lambda least: sorted(map(tuple, joins.shared_scores(df, "i", ["block"], rules, least).collect()))
    for least in (0, 15, 20, 35, 120):
        assert got(least) == [x for x in every if x[2] > least]
    # large blocks in parts, few pairs at a time
    monkeypatch.setattr(joins, "PART", 7)
    monkeypatch.setattr(joins, "PAIRS", 10)
    assert got(15) == [x for x in every if x[2] > 15]
    with pytest.raises(ValueError, match="without any value"):
        joins.shared_scores(df, "i", ["block"], rules, -1)


def test_candidates_are_not_shuffled_as_pairs(spark):
    from compare import SMALL, assert_same
    from quire.plans import all as library

    found = library.QUERIES["candidate_scoring"](spark, SMALL)
    above = found._jdf.queryExecution().executedPlan().toString().split("InArrow")[0]
    assert "Exchange" not in above and "Join" not in above
    assert_same(found, library.ORACLE_SQL["candidate_scoring"], SMALL)


def test_series_are_suggested_by_counts_of_prefixes(spark):
    from quire.operators import catalog

    a = [(u, t, k) for u, t, k in [("x", "abc", "k"), ("x", "abd", "k"), ("x", "abd", "k"), ("y", "abcdef", None), ("y", "zz", None), ("z", "zzz", None), ("w", "abc", "k"), ("w", "ab", None)]]
    b = [(1, "abc", "k"), (2, "abcd", "k"), (2, "abx", "j"), (3, "zzz", None), (4, "abc", None), (4, "abc", None), (5, "q", "k")]
    want = {}
    for u in {r[0] for r in a}:
        mine = [r for r in a if r[0] == u]
        scored = []
        for s in {r[0] for r in b}:
            met = [(t, k, v, j) for _, t, k in mine for g, v, j in b if g == s and t[0] == v[0]]
            share = sum(next((i for i, (x, y) in enumerate(zip(t, v)) if x != y), min(len(t), len(v))) / max(len(t), len(v)) for t, _, v, _ in met)
            score = round(min(1.0, share / len(mine) + (0.2 if len(met) == len(mine) and all(k == j for _, k, _, j in met) else 0)), 4)
            scored += [(-score, s)] if met and score >= 0.4 else []
        want |= {(u, s): (-score, k) for k, (score, s) in enumerate(sorted(scored)[:5], 1)}
    found = catalog.series_suggestions(spark.createDataFrame(a, "selection string, title string, author_key string"), spark.createDataFrame(b, "series long, title string, author_key string"))
    assert {(r.selection, r.series): (r.score, r["rank"]) for r in found.collect()} == want
    assert "p#" in found._jdf.queryExecution().optimizedPlan().toString()
