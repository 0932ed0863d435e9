import hashlib
import random
import zlib

import pytest
from compare import SMALL, assert_same

from quire.llm import trie
from quire.llm.queries import ORACLE_SQL, _forked, op12_conversation_trie


def nodes_of(sequences, weigh):
    """Rows of the trie of {id: tuple of steps}, from all prefixes."""
    members = {}
    for i, s in sequences.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(i)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p] for p in members}
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(i) for i in sorted(ids) if len(sequences[i]) == len(p))
        saved = sum((len(members[q]) - 1) * weigh(q[-1]) for q in below if q)
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_sequences(rnd, n, letters, longest):
    out = {}
    for i in range(n):
        known = rnd.choice(list(out.values())) if out and rnd.random() < 0.7 else ()
        stem = known[: rnd.randrange(len(known) + 1)]
        out[i * 3 + 1] = stem + tuple(rnd.choice(letters) for _ in range(rnd.randrange(longest)))
    return out


def frame(spark, sequences):
    key = lambda s: hashlib.sha256(s.encode()).digest()[:16]
    rows = [(i, [(key(s), ord(s[0])) for s in steps]) for i, steps in sequences.items()]
    return spark.createDataFrame(rows, "id long, steps array<struct<key:binary,weight:long>>")


CASES = [
    {},
    {5: ()},
    {5: (), 2: ()},
    {5: ("a",)},
    {5: ("a", "b", "c"), 7: ("a", "b", "c")},
    {5: (), 1: ("a", "b"), 3: ("a",), 4: ("a", "c"), 9: ("b",)},
    {i: ("a",) * i for i in range(12)},
    {i: ("a",) * 9 + (chr(98 + i),) for i in range(12)},
]


@pytest.mark.parametrize("ranges", [1, 7])
def test_nodes_as_from_all_prefixes(spark, ranges):
    rnd = random.Random(ranges)
    cases = CASES + [random_sequences(rnd, 60, "ab", 6), random_sequences(rnd, 150, "abcdefgh", 5)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for sequences in cases if ranges > 1 else cases[-2:]:
            assert rows_of(trie.prefix_trie(frame(spark, sequences))) == nodes_of(sequences, ord), sequences
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("cuts", [1, 2, 3, 5, 40])
def test_ranges_cut_anywhere(cuts):
    """The walk alone, without Spark: any cut of the sorted paths gives parts that add up."""
    rnd = random.Random(cuts)
    for _ in range(40):
        sequences = random_sequences(rnd, 30, "ab", 5)
        key = {c: hashlib.sha256(c.encode()).digest()[:16] for c in "ab"}
        by_path = {}
        for i, s in sequences.items():
            by_path.setdefault(b"".join(key[c] for c in s), []).append((i, s))
        order = sorted(by_path)
        at = sorted(rnd.sample(range(1, len(order)), min(cuts, len(order)) - 1)) if len(order) > 1 else []
        parts = [order[a:b] for a, b in zip([0, *at], [*at, len(order)])]
        folded, whole = {}, []
        for n, part in enumerate(parts):
            above = trie._common(parts[n - 1][-1], part[0]) if n else -1
            below = trie._common(part[-1], parts[n + 1][0]) if n + 1 < len(parts) else -1
            walk = trie._Range(above, below)
            for p in part:
                steps = by_path[p][0][1]
                walk.add(p, [ord(c) for c in steps], min(i for i, _ in by_path[p]), len(by_path[p]), p)
            walk.close()
            for least, depth, *sums, end, shared, k, parent in walk.out:
                if shared:
                    old = folded.get((depth, k))
                    folded[depth, k] = (least, *sums) if old is None else (min(least, old[0]), *map(sum, zip(sums, old[1:])))
                else:
                    whole.append((least, depth, *sums))
        whole += [(v[0], depth, *v[1:]) for (depth, _), v in folded.items()]
        got = sorted((least, depth, convs, children, leaves, heavy - light) for least, depth, convs, children, leaves, heavy, light in whole)
        assert got == sorted((x[0], x[1], *x[3:7]) for x in nodes_of(sequences, ord))


def forked(rows):
    """{conv_id: rebuilt turns} of rows (conv_id, turn, role, text) whose turns have no ties."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    return out


def test_forks_and_nulls(spark):
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "", None, "ünï", "a\nb"])) for c in range(3, 60) for t in rnd.sample([None, *range(9)], rnd.randrange(1, 10))]
    rows += [(None, 1, "user", "of no conversation"), (61, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as key", "2 as id").repartition(3)
    got = trie.prefix_trie(_forked(df))
    assert rows_of(got) == nodes_of(forked(rows), lambda s: len(s[1].encode()))
    assert trie.prefix_trie(_forked(df.limit(0))).collect() == []


def test_ties_and_repeats_are_turns_in_a_fixed_order(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (2, 0, "user", "b"), (2, 0, "user", "b"), (2, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = rows_of(trie.prefix_trie(trie.conversation_paths(df)))
    assert [(r[1], r[3]) for r in got] == [(0, 2), (1, 2), (2, 2), (3, 2)]


def test_many_ids_at_one_end(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    sequences = {i: ("a",) if i % 3 else ("b", "c") for i in range(500)}
    assert rows_of(trie.prefix_trie(frame(spark, sequences).repartition(5))) == nodes_of(sequences, ord)


def test_query_gives_the_rows_of_its_sql(spark):
    assert_same(op12_conversation_trie(spark, SMALL), ORACLE_SQL["op12_conversation_trie"])
