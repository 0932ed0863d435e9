import hashlib
import random
import re

import pytest
from compare import SMALL, assert_same
from pyspark.sql import functions as F

from quire.llm import cuckoo
from quire.llm.queries import ORACLE_SQL, op5_exact_dedup
from quire.llm.workspace import materialize


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_index_finds_what_is_live():
    index, live, rnd = cuckoo.CuckooIndex(buckets=4), {}, random.Random(5)
    for step in range(20_000):
        i = rnd.randrange(4000)
        slot = index.find(key(i))
        assert (slot >= 0) == (i in live)
        if slot < 0:
            index.insert(key(i), step)
            live[i] = step
        elif rnd.random() < 0.6:
            assert index.values[slot] == live.pop(i)
            index.delete(slot)
    assert index.live == len(live) and dict(index.items()) == {key(i): v for i, v in live.items()}
    assert index.mask + 1 > 4


def test_digests_that_share_fingerprint_and_bucket_are_told_apart():
    index = cuckoo.CuckooIndex(buckets=4)
    a, b = key(1), key(1)[:16] + bytes(16)
    index.insert(a, "a")
    assert index.find(b) < 0
    index.insert(b, "b")
    assert index.values[index.find(a)] == "a" and index.values[index.find(b)] == "b"


ROWS = [(5, "a b"), (3, "a \n\tb"), (9, "a b"), (None, "a b"), (None, "z"), (1, None), (2, ""), (7, "x" * 200_000), (8, "x" * 200_000), (4, " a b"), (4, " a b")]


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    out = []
    for doc, text in rows:
        same = [d for d, t in rows if norm(t) == norm(text)]
        keep = min((d for d in same if d is not None), default=None)
        out.append((doc, keep, len(same), doc == keep, hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_as_by_comparing_texts(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("digest", F.lit(1)).repartition(3)
    got = cuckoo.exact_dedup(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)
    assert cuckoo.exact_dedup(df.limit(0)).collect() == []


def test_small_indexes_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(cuckoo, "HELD", 10)
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 97}") for i in range(2000)]
    got = cuckoo.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_insertion_and_deletion(spark):
    frame = lambda rows: cuckoo.digests(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    known = cuckoo.groups(frame([(1, "a"), (2, "a"), (3, "b")]))
    after = cuckoo.update_groups(known, inserted=frame([(0, "a"), (9, "c")]), deleted=frame([(3, "b"), (2, "a")]), live=frame([(0, "a"), (1, "a"), (9, "c")]))
    got = {bytes(r.digest): (r.keep_id, r.group_size) for r in after.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    assert got == {sha("a"): (0, 2), sha("c"): (9, 1)}


def test_deletion_of_the_smallest_id_brings_the_next_forward(spark):
    frame = lambda rows: cuckoo.digests(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    rnd = random.Random(9)
    live = [(i, f"t{rnd.randrange(12)}") for i in range(80)] + [(None, "t1"), (200, "t2"), (200, "t2")]
    known = cuckoo.groups(frame(live))
    for step in range(3):
        gone = rnd.sample(live, 15) + [min((r for r in live if r[1] == "t3" and r[0] is not None), default=live[0])]
        gone = list(dict.fromkeys(gone))
        new = [(1000 + 10 * step + k, f"t{rnd.randrange(14)}") for k in range(4)] + [(-step, "t5")]
        for r in gone:
            live.remove(r)
        live += new
        known = materialize(cuckoo.update_groups(known, inserted=frame(new), deleted=frame(gone), live=frame(live)), "known")
        want = {}
        for i, t in live:
            ids = want.setdefault(hashlib.sha256(t.encode()).digest(), [])
            ids.append(i)
        want = {d: (min((i for i in ids if i is not None), default=None), len(ids)) for d, ids in want.items()}
        assert {bytes(r.digest): (r.keep_id, r.group_size) for r in known.collect()} == want
    with pytest.raises(ValueError):
        cuckoo.update_groups(known, deleted=frame(gone))


def test_query_gives_the_rows_of_its_sql(spark):
    assert_same(op5_exact_dedup(spark, SMALL), ORACLE_SQL["op5_exact_dedup"])
