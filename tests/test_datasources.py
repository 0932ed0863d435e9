import json

import numpy as np
import pytest

from quire.sources import datasources as ds


@pytest.fixture
def small_parts(spark):
    ds.register(spark)


def test_packed_arrays_in_parts(spark, tmp_path, small_parts):
    x = np.arange(3000, dtype="<f4").reshape(1000, 3)
    for i, part in enumerate(np.split(x, [400, 400])):
        (tmp_path / f"{i}.bin").write_bytes(part.tobytes())
    df = spark.read.format("packed").option("width", 3).option("partbytes", 200).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 20
    got = {(r.file[-5:], r.place): r.numbers for r in df.collect()}
    assert len(got) == 1000 and got["0.bin", 399] == [1197.0, 1198.0, 1199.0] and got["2.bin", 0] == [1200.0, 1201.0, 1202.0]
    (tmp_path / "3.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="3.bin has 5 bytes"):
        spark.read.format("packed").option("width", 3).option("partbytes", 200).load(str(tmp_path)).count()


def test_members_of_archives(spark, tmp_path, small_parts):
    x, ids = np.random.default_rng(1).normal(size=(500, 4)), np.arange(500, dtype=np.int32)
    np.savez(tmp_path / "a.npz", vectors=x, ids=ids)
    np.savez_compressed(tmp_path / "b.npz", vectors=x[:7], ids=ids[:0])
    df = spark.read.format("npz").option("partbytes", 200).option("member", "vectors").load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 50
    rows = {(r.file[-5:], r.place): r.numbers for r in df.collect()}
    assert len(rows) == 507 and rows["a.npz", 123] == x[123].tolist() and rows["b.npz", 6] == x[6].tolist()
    assert spark.read.format("npz").load(str(tmp_path)).groupBy("member").count().count() == 2
    with pytest.raises(Exception, match="has a member nothing"):
        spark.read.format("npz").option("member", "nothing").load(str(tmp_path)).count()
    data = bytearray((tmp_path / "a.npz").read_bytes())
    at = data.index(b"\x93NUMPY")
    data[at : at + 6] = b"broken"
    (tmp_path / "a.npz").write_bytes(data)
    with pytest.raises(Exception, match=r"a.npz!vectors.npy is damaged"):
        spark.read.format("npz").load(str(tmp_path)).count()


def test_a_stream_of_lines_goes_on_where_it_was(spark, tmp_path):
    ds.register(spark)
    source, got = tmp_path / "in", []
    source.mkdir()

    def feed():
        q = spark.readStream.format("jsonlines").load(str(source)).writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: got.extend((r.file[-7:], r.kind, r.problem) for r in df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()

    line = lambda **x: json.dumps(x) + "\n"
    (source / "a.jsonl").write_text(line(type="start") + line(type="progress", done=1) + '{"type":"ha')
    (source / "b.jsonl").write_text("[1]\nnot json\n\n" + line(type=5))
    feed()
    first = sorted(got, key=str)
    assert first == sorted([("a.jsonl", "start", None), ("a.jsonl", "progress", None), ("b.jsonl", None, "no object"), ("b.jsonl", None, "no json"), ("b.jsonl", None, None)], key=str)
    with (source / "a.jsonl").open("a") as f:
        f.write('lf"}\n' + line(type="end"))
    got.clear()
    feed()
    assert sorted(got) == [("a.jsonl", "end", None), ("a.jsonl", "half", None)]
    got.clear()
    feed()
    assert got == []


def test_offsets_give_the_same_rows_again(tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("".join(json.dumps({"type": f"t{i}", "pad": "x" * i}) + "\n" for i in range(300)))
    r = ds.JsonLinesStream({"path": str(tmp_path)})
    end = r.latestOffset()
    parts = r.partitions({}, end)
    once = [x for p in parts for x in r.read(p)]
    assert once == [x for p in r.partitions({}, end) for x in r.read(p)] and len(once) == 300
    half = {k: path.read_bytes().index(b"\n", v // 2) + 1 for k, v in end.items()}
    two = [x for a, b in (({}, half), (half, end)) for p in r.partitions(a, b) for x in r.read(p)]
    assert two == once and r.partitions(end, end) == []
    path.write_text("{}\n")
    with pytest.raises(ValueError, match="became shorter"):
        list(r.read(parts[0]))
