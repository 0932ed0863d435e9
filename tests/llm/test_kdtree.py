import random
import zlib

from pyspark.sql import functions as F

from quire.llm import kdtree
from quire.llm.kdtree import split_by_kdtree
from quire.llm.queries import op4_kdtree_shards


def rows_of(n, seed=6):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        text = "hot text " * 4 if rnd.random() < 0.33 else None if i % 97 == 0 else f"{i % (n // 2)} " + "x" * rnd.randrange(400)
        out.append((i, text, "big" if rnd.random() < 0.4 else f"s{rnd.randrange(9)}", rnd.choice(["en", "de", None])))
    return out


def check(got, rows, shards, slack):
    texts = {i: t or "" for i, t, *_ in rows}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    for s in range(shards):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    sums = [sum(r.size for r in got if r.shard == s) for s in range(shards)]
    mean = sum(sums) / shards
    assert max(abs(x - mean) for x in sums) <= slack * mean, sums


def test_sizes_are_near_equal_and_slots_have_no_gaps(spark):
    rows = rows_of(3000)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("shard", F.lit("clash")).repartition(4)
    got = split_by_kdtree(df, shards=8).collect()
    check(got, rows, 8, 0.05)
    where = {}
    for r, (_, text, *_) in zip(sorted(got, key=lambda r: r.doc_id), rows):
        where.setdefault(text or "", set()).add(r.shard)
    # only the group that is larger than half a shard may lie in several
    assert all(len(s) == 1 for t, s in where.items() if not t.startswith("hot"))
    check(split_by_kdtree(df, shards=5).collect(), rows, 5, 0.05)


def test_target_bytes(spark):
    rows = rows_of(1000)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    total = sum(len((t or "").encode()) + 1 for _, t, *_ in rows)
    got = split_by_kdtree(df, target_bytes=total // 4).collect()
    check(got, rows, 4, 0.05)


def test_edge_cases(spark):
    schema = "doc_id long, text string, source string, lang string"
    assert split_by_kdtree(spark.createDataFrame([], schema), shards=8).collect() == []
    same = spark.createDataFrame([(1, "a", None, None)] * 3 + [(None, None, None, None)], schema)
    got = split_by_kdtree(same, shards=2).collect()
    assert len(got) == 4
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = op4_kdtree_shards(spark, folder).collect()
    check(got, rows, 8, 0.5)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_many_leaves_by_few_intervals(spark, monkeypatch):
    """Medians by few intervals a round give shards of the sizes that sorting by the key would give."""
    monkeypatch.setattr(kdtree, "DRIVER_ROWS", 512)
    rows = [(i, "x" * (20 + i * 7919 % 400), f"s{i % 5}", "en") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    got = kdtree.split_by_kdtree(df, shards=8).collect()
    size = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.size
    mean = sum(size.values()) / 8
    assert len(got) == 2000 and set(size) == set(range(8)) and all(abs(v - mean) < 0.1 * mean + 421 for v in size.values())
    for shard in size:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def plain_tree(items, dims, leaves, leaf):
    """The leaf of each item (dims..., weight, tie), by sorting each node's items by the key of the dimension that is split."""
    root = [max(1, max(x[d] for x in items) - min(x[d] for x in items)) for d in dims]
    out = {}

    def grow(some, first, n):
        if n == 1 or not some:
            out.update({x: first for x in some})
            return
        extent = [max(x[d] for x in some) - min(x[d] for x in some) for d in dims]
        target = sum(x[-2] for x in some) * (n // 2) / n
        best = None
        for d in sorted(dims, key=lambda d: -extent[d] / root[d]):
            below = 0
            for x in sorted(some, key=lambda x: (x[d] << 32) + x[-1]):
                key = (x[d] << 32) + x[-1]
                if below + x[-2] >= target:
                    break
                below += x[-2]
            low, high = target - below, below + x[-2] - target
            found = (low, d, key) if low <= high else (high, d, key + 1)
            best = found if best is None or found[0] < best[0] else best
            if best[0] <= leaf * kdtree.MISS:
                break
        _, d, cut = best
        grow([x for x in some if (x[d] << 32) + x[-1] < cut], first, n // 2)
        grow([x for x in some if (x[d] << 32) + x[-1] >= cut], first + n // 2, n - n // 2)

    grow(items, 0, leaves)
    return out


def test_tree_as_by_sorting_node_by_node(spark):
    rnd = random.Random(11)
    for leaves, weights in ((8, (1,)), (5, (1, 7, 30))):
        items = list({(rnd.randrange(1 << 20), rnd.choice([5, 900, 70_000]), rnd.randrange(1 << 30), rnd.choice(weights), rnd.randrange(1 << 32)) for _ in range(300)})
        leaf = sum(x[-2] for x in items) / leaves
        df = spark.createDataFrame([(*x[:3], float(x[3]), x[4]) for x in items], "d0 long, d1 long, d2 long, weight double, tie long").repartition(3)
        got = {(r.d0, r.d1, r.d2, int(r.weight), r.tie): r.node for r in kdtree._grow(df, ["d0", "d1", "d2"], leaves, leaf).collect()}
        assert got == plain_tree(items, range(3), leaves, leaf)


def test_shards_of_a_whole_table_are_within_one_per_cent(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(op4_kdtree_shards(spark, folder).collect(), rows, 8, 0.01)
