import random
import re

import numpy as np

from quire.llm import partenum
from quire.llm.components import components


def brute(rows):
    """Component ids by comparing all pairs of shingle sets."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(5, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: (len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)}


def corpus(seed):
    """Near copies at many distances, chains, a shared passage in many texts, short texts, empty ones."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(30)]
    texts = []
    for size in (1, 3, 4, 5, 6, 8, 9, 10, 12, 20, 40, 90, 200):
        for _ in range(4):
            base = [word() for _ in range(size)]
            texts.append(base)
            for _ in range(4):
                copy = list(base)
                for _ in range(rnd.randrange(0, 1 + max(1, size // 20))):
                    copy[rnd.randrange(len(copy))] = word()
                texts.append(copy if rnd.random() < 0.6 else copy + [word() for _ in range(rnd.randrange(1, 2 + size // 6))])
    crowd = [word() for _ in range(60)]
    for _ in range(40):
        copy = list(crowd)
        for _ in range(rnd.randrange(1, 3)):
            copy[rnd.randrange(60)] = word()
        texts.append(copy)
    for _ in range(40):
        texts.append(passage + [word() for _ in range(rnd.randrange(1, 30))])
    for _ in range(20):
        texts.append([word() for _ in range(20)] + passage)
    family = [word() for _ in range(70)]
    for k in range(70):  # from equal to too far apart, so many stay alone in the crowd
        copy = list(family)
        for _ in range(k // 12):
            copy[rnd.randrange(70)] = word()
        texts.append(copy)
    parts = [[word() for _ in range(35)] for _ in range(6)]
    texts += [parts[i] + parts[j] + [word()] for i in range(6) for j in range(6) if i != j]
    chain = [word() for _ in range(40)]
    for _ in range(12):
        chain = chain[1:] + [word()]
        texts.append(chain)
    rows = [" ".join(w.upper() if rnd.random() < 0.1 else w for w in t) for t in texts] + [None, "", "  \n", "\x0b"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_components_as_by_all_pairs(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.jaccard_components(df).collect()}
    assert got == brute(rows)


def test_every_linked_pair_shares_a_signature():
    rnd = random.Random(3)
    begins = np.array(partenum.bands())
    with np.errstate(over="ignore"):
        for size in [4, 5, 7, 9, 10, 15, 16, 23, 24, 36, 50, 99, 100, 101, 500, 1500]:
            for _ in range(30):
                a = np.unique(np.array([rnd.getrandbits(64) for _ in range(size)], np.uint64))
                k = partenum.most_differences(size)
                gone = rnd.randrange(0, k + 1)
                new = np.array([rnd.getrandbits(64) for _ in range(rnd.randrange(0, k - gone + 1))], np.uint64)
                b = np.unique(np.concatenate((np.delete(a, rnd.sample(range(size), gone)), new)))
                both = len(np.intersect1d(a, b))
                if 100 * both >= 80 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                    shared = np.intersect1d(partenum.signatures(a, begins), partenum.signatures(b, begins))
                    assert len(shared) > partenum.slack(min(len(a), len(b))) - 2, (size, len(a), len(b))


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert partenum.jaccard_components(empty).collect() == []
    df = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b c", "y"), (3, None, None), (4, "q " * 30000, "z")], "doc_id long, text string, class string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in partenum.jaccard_components(df).collect())
    assert got == [(-1, 1, 1), (1, 1, 1), (1, 1, 1), (3, 0, 3), (4, 1, 4)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}}


def test_few_edges_take_few_jobs_and_give_what_stars_give(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randrange(-300, 300), rnd.randrange(-300, 300)) for _ in range(150)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(7).cache()
    table.count()
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    before = jobs()
    at_once = {(r.node, r.label) for r in components(table).collect()}
    assert jobs() - before <= 4
    assert at_once == {(r.node, r.label) for r in components(table, at_once=10).collect()}


def test_a_crowd_of_the_count_gives_all_its_light_members_as_pivots(spark):
    row = {"n_shingles": 100, "rare": 0, "label": 0, "earlier": [0], **{s: 0 for s in partenum.SKETCH}}
    rows = spark.createDataFrame([{"sig": s, "class": 7 * c, "size": n} | row for s, n in ((1, 16), (2, 40)) for c in range(n)])
    got = [r.sig for r in partenum._pivots(rows, 16, 80).collect()]
    assert got.count(1) == 16 and got.count(2) <= 16


def test_prints_never_tell_more_differences_than_there_are():
    rng = np.random.default_rng(4)
    for n, m, both in ((1, 1, 1), (1, 2, 1), (7, 9, 6), (100, 120, 95), (1000, 700, 650), (4000, 3900, 0)):
        pool = np.unique(rng.integers(0, 1 << 63, 2 * (n + m), np.int64).astype(np.uint64))
        rng.shuffle(pool)
        x, y = np.sort(pool[:n]), np.sort(np.concatenate((pool[:both], pool[n : n + m - both])))
        apart = partenum.cells_apart(partenum.print_of(x), partenum.print_of(y))
        assert apart <= n + m - 2 * both and apart == partenum.cells_apart(partenum.print_of(y), partenum.print_of(x))
        assert partenum.cells_apart(partenum.print_of(x), partenum.print_of(x)) == 0


def test_linked_pairs_share_more_than_the_slack_of_the_smaller():
    rng = np.random.default_rng(5)
    begins = np.array(partenum.bands())
    with np.errstate(over="ignore"):
        for size in (4, 8, 10, 16, 20, 24, 25, 39, 48, 60, 90, 240):
            for _ in range(60):
                k = partenum.most_differences(size)
                pool = rng.integers(0, 1 << 63, size + k, np.int64).astype(np.uint64)
                gone = int(rng.integers(0, k + 1))
                a, b = np.unique(pool[:size]), np.unique(pool[gone : size + k - gone])
                both = len(np.intersect1d(a, b))
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    shared = np.intersect1d(partenum.signatures(a, begins), partenum.signatures(b, begins))
                    assert len(shared) > partenum.slack(min(len(a), len(b))), (size, len(a), len(b))


def gap_family():
    """Texts of which one of 24 shingles and one of 30 link, share no signature but crowded ones, and the larger has
    no more of those than its own slack; the others link with the smaller alone."""
    begins, rnd = np.array(partenum.bands()), random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    with np.errstate(over="ignore"):
        sig = lambda ws: set(partenum.signatures(partenum.shingles(" ".join(ws), partenum._Words()), begins).tolist())
        for _ in range(20_000):
            large = [word() for _ in range(34)]
            small = large[:28]
            s, b = sig(small), sig(large)
            if len(s & b) != partenum.slack(30):
                continue
            copies = [[*small[:27], word()] for _ in range(60)]
            copies = [c for c in copies if s & b <= sig(c)][:12]
            if len(copies) == 12 and all(sum(x in sig(c) for c in copies) + (x in s) < 1 for x in b - s):
                return [" ".join(x) for x in (large, small, *copies)]
    raise AssertionError("none found")


def test_crowded_pair_across_a_step_of_the_slack(spark):
    rows = list(enumerate(gap_family()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert want[0] == (30, 0) and want[1] == (24, 0)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.jaccard_components(df).collect()} == want


def test_near_copies_go_by_id_and_text(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    near = a + " more"
    rows = [(5, a), (3, near), (5, b), (5, b), (None, a.upper()), (7, None), (7, ""), (7, ""), (8, "c d"), (8, "C  D"), (None, "e f"), (None, "g h")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class", "2 as place", "3 as copies").repartition(3)
    got = partenum.drop_near_copies(df)
    assert got.columns == df.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert [x for x in left if x[0] != 8] == sorted([(3, near), (5, b), (7, None), (7, ""), (7, ""), (None, "e f"), (None, "g h")], key=str)
    assert [x for x in left if x[0] == 8] in ([(8, "c d")], [(8, "C  D")])
    assert partenum.drop_near_copies(df.limit(0)).collect() == []


def test_pairs_meet_once_in_crowds_that_are_alike(spark):
    rnd = random.Random(11)
    sigs = {c: {s for s in range(90) if rnd.random() < 0.9} if c < 15 else {rnd.randrange(90) for _ in range(3)} for c in range(30)}
    row = {"n_shingles": 100, "rare": 0, **{s: 0 for s in partenum.SKETCH}}
    rows = spark.createDataFrame([{"sig": s, "class": c, "label": c} | row for c in sigs for s in sigs[c]])
    rows = partenum._with_earlier(rows)
    near = rows.join(partenum._pivots(rows, 1 << 20, 80), "sig").filter(partenum._near_by_shape(80))
    many = near.count()
    met = near.filter("not arrays_overlap(earlier, a.earlier)").selectExpr("class", "a.class as pivot").collect()
    assert {(r["class"], r["pivot"]) for r in met} == {(c, d) for c in sigs for d in sigs if c != d and sigs[c] & sigs[d]}
    assert many > 8 * len(met)
    alike = [r for r in met if max(r) < 15]
    assert len(alike) == len(set(alike)) == 15 * 14
