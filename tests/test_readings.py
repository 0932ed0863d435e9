import itertools
import random

import pytest
from compare import SMALL
from pyspark.sql import functions as F

from quire.operators import readings
from quire.plans import reading_queries
from quire.plans.all import QUERIES


def optimal_cells(r, h):
    """The distance of two strings and all cells (i, j) that any optimal alignment passes, from two whole tables."""

    def distances(r, h):
        t = [[0] * (len(h) + 1) for _ in range(len(r) + 1)]
        for i, j in itertools.product(range(len(r) + 1), range(len(h) + 1)):
            if i or j:
                t[i][j] = min([t[i - 1][j] + 1] * (i > 0) + [t[i][j - 1] + 1] * (j > 0) + [t[i - 1][j - 1] + (r[i - 1] != h[j - 1])] * (i > 0 and j > 0))
        return t

    a, b = distances(r, h), distances(r[::-1], h[::-1])
    d = a[-1][-1]
    return d, {(i, j) for i in range(len(r) + 1) for j in range(len(h) + 1) if a[i][j] + b[len(r) - i][len(h) - j] == d}


def test_boundaries_of_all_optimal_alignments():
    rnd = random.Random(1)
    for _ in range(300):
        r = "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 9)))
        h = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9)))
        d, cells = optimal_cells(r, h)
        for most in (d - 1, d, d + 2):
            got = readings.boundary_places(r, h, list(range(len(h) + 1)), most) if most >= 0 else None
            if most < d:
                assert got is None
            else:
                assert got == (d, [(min(i for i, k in cells if k == j), max(i for i, k in cells if k == j)) for j in range(len(h) + 1)]), (r, h, most)


def test_labels_and_their_reasons(spark):
    reference = "the quick brown fox jumps over the lazy dog and runs"
    rows = [
        (1, reference, ["the quick brown ", "fox jumps over ", "the lazy dog and runs"]),
        (2, reference, ["the quick brown ", "fox jxmps over ", "the lazy dog an", " runs"]),  # the d may go to either side
        (3, reference, ["quite another text"]),
        (4, reference, []),
        (5, None, ["x"]),
        (6, "a" * 130 + "bcdefgh", ["a" * 130, "bcd", "efgh"]),
        (7, "aaaaaaaaaaaaaaaaaaaa", ["aaaaaaaaaa", None, "aaaaaaaaa"]),
    ]
    df = spark.createDataFrame(rows, "id long, reference string, parts array<string>")
    got = {}
    for r in readings.segment_labels(df, "id", "reference", "parts").collect():
        got.setdefault(r.id, []).append((r.page_reason, r.segment, r.label, r.reasons))
    assert [x[1:] for x in sorted(got[1])] == [(i, p, []) for i, p in enumerate(rows[0][2])]
    second = {s: (label, reasons) for _, s, label, reasons in got[2]}
    assert second[1] == ("fox jumps over ", []) and "ambiguous_boundary" in second[2][1] and "ambiguous_boundary" in second[3][1]
    assert got[3] == [("page_rate_exceeded", None, None, None)] and got[4] == got[5] == [("empty_page_text", None, None, None)]
    assert [r[3] for r in sorted(got[6], key=lambda x: x[1])] == [["label_length"], ["label_length"], ["label_length"]]
    assert all("ambiguous_boundary" in r[3] for r in got[7])


def test_query_labels_are_cut_from_their_references(spark):
    found = QUERIES["segment_labels"](spark, SMALL).collect()
    good = [r for r in found if r.reasons == []]
    assert len(good) > 40 and all(r.page_rate <= 0.15 for r in good)


def test_missing_columns_at_the_limits(spark):
    pages = {"gap": [100, 90, 80, 50, 40], "header": [100, 60, 50, 40, 30], "few": [100, 90, 50], "flat": [100, 100, 90, 50], "wide": [900, 890, 880, 100, 90], "half": [100, 90, 80, 55, 45]}
    rows = [(p, c - 2.0, c + 2.0, 3) for p, cs in pages.items() for c in cs]
    df = spark.createDataFrame(rows, "page string, x0 double, x1 double, chars int")
    got = {}
    for r in readings.missing_columns(df, "page", "x0", "x1", "chars", 2.0, 4).collect():
        got.setdefault(r.page, []).append((r.missing_count, r.center))
    assert {p: sorted(v) for p, v in got.items()} == {"gap": [(2, 60.0), (2, 70.0)], "wide": [(3, 295.0), (3, 490.0), (3, 685.0)], "half": [(1, 67.5)]}
    assert {r.page for r in readings.missing_columns(df, "page", "x0", "x1", "chars", 2.0, 2).collect()} == {"gap", "wide", "half", "header"}


def clusters(tiles, stride=32, share=0.2, fewest=3, least=2):
    open_, common = [], []
    for t in sorted(tiles, key=lambda t: (-len(t[2]), t[1], t[0])):
        need = max(fewest, -(-t[3] * share // 1))
        for i, c in enumerate(open_):
            shared = common[i] & t[2]
            if len(shared) >= need and any((m[0], m[1]) != (t[0], t[1]) and abs(m[0] - t[0]) <= stride and abs(m[1] - t[1]) <= stride for m in c):
                c.append(t)
                common[i] = shared
                break
        else:
            open_.append([t])
            common.append(t[2])
    kept = [(c, s) for c, s in zip(open_, common) if len(c) >= least and s]
    return {(k, t[0], t[1], len(s)) for k, (c, s) in enumerate(kept) for t in c}


def test_tiles_join_the_first_open_cluster(spark):
    books = {}
    for r in reading_queries.tiles(spark, SMALL).collect():
        books.setdefault(r.book, []).append((r.x, r.y, set(r.pages), r.sampled))
    rnd = random.Random(5)
    for b in range(1000, 1010):
        books[b] = [(x, y, set(rnd.sample(range(12), rnd.randrange(2, 9))), 12) for x, y in {(rnd.randrange(8) * 16, rnd.randrange(8) * 16) for _ in range(30)}]
    df = spark.createDataFrame([(b, x, y, sorted(p), n) for b, ts in books.items() for x, y, p, n in ts], "book long, x int, y int, pages array<int>, sampled int")
    got = {}
    for r in readings.tile_clusters(df, "book", "x", "y", "pages", "sampled").collect():
        got.setdefault(r.book, set()).add((r.cluster, r.x, r.y, r.common))
    assert got == {b: c for b, ts in books.items() if (c := clusters(ts))} and len(got) > 5
    one = QUERIES["tile_clusters"](spark, SMALL)
    assert {r.book for r in one.collect()} == {b for b in got if b < 1000}


def plain_corrections(text, others, terms):
    """Proposals and the corrected text by trying every term at every place."""
    found = []
    for term in terms:
        for s in range(len(text) - len(term) + 1):
            variant = text[s : s + len(term)]
            if len(term) >= 2 and sum(a != b for a, b in zip(variant, term)) == 1:
                windows = [readings._aligned(text, o)[s : s + len(term)] for o in others]
                exact, same = sum(w == list(term) for w in windows), sum(w == list(variant) for w in windows)
                found.append([s, variant, term, exact, same, "?" if exact else "unsupported" if same >= 2 and any(term in o for o in others) else "dropped"])
    backed = [f for f in found if f[5] == "?"]
    for f in backed:
        f[5] = "overlapping" if any(g is not f and g[0] < f[0] + len(f[2]) and f[0] < g[0] + len(g[2]) for g in backed) else "applied"
    out = list(text)
    for s, _, term, _, _, result in found:
        if result == "applied":
            out[s : s + len(term)] = term
    return sorted(map(tuple, found)), "".join(out)


@pytest.mark.parametrize("listed", [2_000_000, 0])
def test_corrections_as_by_trying_every_term_everywhere(spark, monkeypatch, listed):
    monkeypatch.setattr(readings, "LISTED", listed)
    rnd = random.Random(3)
    terms = ["abc", "abca", "bb", "éab", "x", "cabab"]
    texts = ["".join(rnd.choice("abcé") for _ in range(rnd.randrange(14))) for _ in range(40)] + ["", None]
    rows = []
    for i, t in enumerate(texts):
        t = t or ""
        change = lambda: "".join(rnd.choice("abc") if rnd.random() < 0.15 else c for c in t if rnd.random() > 0.05)
        rows.append((i, texts[i], [change(), change(), t, None]))
    df = spark.createDataFrame(rows, "id long, text string, others array<string>").repartition(3)
    proposals, fixed = readings.supported_corrections(df, "id", "text", "others", spark.createDataFrame([(t,) for t in terms + ["abc", None]], "term string"), "term")
    got = {}
    for r in proposals.collect():
        got.setdefault(r.id, []).append((r.start, r.variant, r.term, r.exact, r.same, r.result))
    want = {i: plain_corrections(t or "", [o or "" for o in os], terms) for i, t, os in rows}
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, (v, _) in want.items() if v}
    assert {r.id: r.corrected for r in fixed.collect()} == {i: (None if t is None else want[i][1]) for i, t, _ in rows}
    assert {x[5] for v in got.values() for x in v} == {"applied", "overlapping", "unsupported", "dropped"}


def test_query_finds_and_mends_changed_words(spark):
    pages, terms = reading_queries.corrected_pages(spark, SMALL)
    proposals, texts = readings.supported_corrections(pages, "page", "consensus", "readings", terms, "term")
    known = [r.term for r in terms.collect()]
    rows = {r.page: r for r in pages.filter("page % 7 = 0").collect()}
    got = {}
    for r in proposals.filter("page % 7 = 0").collect():
        got.setdefault(r.page, []).append((r.start, r.variant, r.term, r.exact, r.same, r.result))
    assert {p: sorted(v) for p, v in got.items()} == {p: v for p, r in rows.items() if (v := plain_corrections(r.consensus, r.readings, known)[0])}


def test_insertions_between_anchors(spark):
    spark.udtf.register("insertion_proposals", readings.InsertionProposals)
    cases = [("abcdefghij", "abcdeXYZfghij", [(5, "XYZ")]), ("abcdefghij", "abcdeXYfghij", []), ("abcdefghij", "abXYZcdefghij", []), ("abcdefghij", "abcde...fghij", []), ("abcdefghij", "abcdefghijXYZ", []), (None, "a", [])]
    for a, b, want in cases:
        df = spark.createDataFrame([(a, b)], "a string, b string")
        got = spark.sql("SELECT p.* FROM {df}, LATERAL insertion_proposals(a, b, 3, 9, 4) p", df=df).collect()
        assert [tuple(r) for r in got] == want


def test_fact_lines(spark):
    sheets = {
        "plain": "- one fact [page 3]\n  goes on [Page 4、5]\n\n* two [page 3, page 9]\n・three",
        "head": "no bullet [page 1]\nand more",
        "bare": "- [page 2]",
        "empty": " \n ",
        "null": None,
    }
    df = spark.createDataFrame(list(sheets.items()), "k string, sheet string").withColumn("allowed", F.array(*[F.lit(i).cast("long") for i in range(6)]))
    got = {}
    for r in readings.fact_records(df, "k", "sheet", "allowed").collect():
        got.setdefault(r.k, []).append((r.place, r.text, r.pages, r.problem))
    assert got["plain"] == [(0, "one fact goes on", [3, 4, 5], None), (1, "two", [3, 9], "invented page"), (2, "three", [], "no page")]
    assert got["head"] == [(0, "no bullet and more", [1], None)] and got["bare"] == [(0, "", [2], "no text")]
    assert got["empty"] == got["null"] == [(None, None, None, "no facts")]


def test_alignment_by_reach_is_that_of_the_table():
    from quire.functions import sequential

    made = random.Random(3)
    for n in range(600):
        a = "".join(made.choice("abé" if n % 2 else "ab") for _ in range(made.randrange(12)))
        b = "".join(made.choice("ab☃") if made.random() < 0.2 else c * made.choice((1, 1, 1, 0, 2)) for c in a) if n % 3 else a[::-1]
        assert sequential._by_reach(a, b, 99) == sequential._by_table(a, b) == sequential.edit_operations(a, b), (a, b)
    text = "".join(made.choice("abcdefgh ") for _ in range(3000))
    assert sequential._by_reach(text, text[:1500] + "xy" + text[1501:], 10) == sequential._by_table(text, text[:1500] + "xy" + text[1501:])
    assert sequential._by_reach("a" * 50, "b" * 50, 10) is None


def test_the_medoid_of_a_consensus_is_that_of_the_operator(spark):
    from quire.functions import sequential
    from quire.operators.aggregates import medoid

    made = random.Random(5)
    rows = [(g, i, None if made.random() < 0.1 else "".join(made.choice("abc") for _ in range(made.randrange(7)))) for g in range(80) for i in range(made.randrange(1, 6))]
    got = {r.g: r.i for r in medoid(spark.createDataFrame(rows, "g int, i int, t string"), "g", "i", "t").collect()}
    assert got == {g: sequential.medoid_place([t for h, _, t in rows if h == g], {}) for g in range(80)}
    plan = sequential.consensus(spark.createDataFrame(rows, "g int, i int, t string"), "g", "i", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_pages_are_aligned_once(spark):
    pages, terms = reading_queries.corrected_pages(spark, SMALL)
    proposals, _ = readings.supported_corrections(pages, "page", "consensus", "readings", terms, "term")
    assert proposals._jdf.queryExecution().optimizedPlan().toString().count("support(") == 1
