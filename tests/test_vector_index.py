import numpy as np
import pytest
from compare import SMALL
from pyspark.sql import functions as F

from quire.operators import vector_index as vi
from quire.plans.all import QUERIES
from quire.sources.publications import Publication


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<float>")


def nearest(x, q, top):
    d = ((x - q) ** 2).sum(1)
    return d, np.lexsort((np.arange(len(x)), d.round(6)))[:top]


def test_query_finds_nine_of_ten_in_a_quarter_of_the_cells(spark):
    want = {(r.query_id, r.vec_id) for r in QUERIES["vector_exact_search"](spark, SMALL).collect()}
    found = QUERIES["vector_index_search"](spark, SMALL).collect()
    got = {(r.query_id, r.vec_id) for r in found}
    assert len(found) == len(got) == len(want) and len(want & got) >= 0.9 * len(want)
    assert all(r.distance == 0 for r in found if r["rank"] == 1)


def test_index_is_added_to_and_read_in_part(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 16)) * 4
    x = np.float32(np.concatenate([c + rng.normal(size=(60, 16)) for c in centers]))
    x[300:540] = x[300]  # one vector that a third of the rows have
    monkeypatch.setattr(vi, "PART", 50)
    monkeypatch.setattr(vi, "BLOCK", 4)
    at = Publication(spark, f"file://{tmp_path}/index")
    assert vi.build(at, frame(spark, x[:500]), "id", "v", cells=12, sub_vectors=4, spill=2) == 1
    assert vi.add(at, frame(spark, x[500:], 500), "id", "v") == 2
    assert at.read("codes").count() == 2 * len(x) and at.read("vectors").count() == len(x)
    found = vi.search(at, frame(spark, x).filter("id % 50 = 0"), "id", "v", top=10, refine=40)
    rows = {}
    for r in found.collect():
        rows.setdefault(r.query, []).append(r)
    hits = 0
    for q, got in rows.items():
        d, best = nearest(np.float64(x), np.float64(x[q]), 10)
        assert len({r.key for r in got}) == 10 and [r["rank"] for r in sorted(got, key=lambda r: (r.distance, r.key))] == list(range(1, 11))
        assert all(abs(r.distance - d[r.key]) < 1e-5 for r in got)
        hits += sum(r.distance <= d[best[-1]] + 1e-6 for r in got)
    assert len(rows) == len(range(0, len(x), 50)) and hits >= 9 * len(rows)
    assert sorted(r.key for r in rows[300]) == list(range(300, 310))
    one = vi.search(at, frame(spark, x[:1]), "id", "v", probes=0.1)
    assert one.count() == 10
    plan = at.read("codes").filter(F.col("cell").isin([3, 4]))._jdf.queryExecution().executedPlan().toString()
    assert all("cell" in x[:80] for x in plan.split("PartitionFilters: ")[1:]) and plan.count("PartitionFilters: ") == 2


def test_exact_search_in_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vi, "PART", 30)
    monkeypatch.setattr(vi, "BLOCK", 3)
    rng = np.random.default_rng(2)
    x = np.float32(rng.normal(size=(150, 6)))
    x[40:90] = x[40]
    df = frame(spark, x).unionByName(spark.createDataFrame([(500, None)], "id long, v array<float>"))
    got = {}
    for r in vi.exact_search(df, "id", df.filter("id % 7 = 0 or id = 500"), "id", "v", top=4).collect():
        got.setdefault(r.query, []).append((r["rank"], r.key))
    assert set(got) == set(range(0, 150, 7))
    for q, rows in got.items():
        assert [k for _, k in sorted(rows)] == nearest(np.float64(x), np.float64(x[q]), 4)[1].tolist()


def test_nothing_to_fit(spark, tmp_path):
    at = Publication(spark, f"file://{tmp_path}/index")
    with pytest.raises(ValueError):
        vi.build(at, frame(spark, []), "id", "v")
    assert at.current() is None
    assert vi.indexed(50_000) and not vi.indexed(49_999) and vi.cells_for(1) == 4
