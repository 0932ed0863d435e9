import datetime
import random

import pytest

from quire.streaming import leases

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "job long, ts timestamp, done boolean"


def plain(signs, timeout, watermark):
    """(job, last sign) of leases that ran out up to a watermark, of (job, seconds, done)."""
    out = set()
    for job in {s[0] for s in signs}:
        mine = sorted((at, done) for j, at, done in signs if j == job)
        for (at, done), following in zip(mine, [*mine[1:], (float("inf"), False)]):
            if not done and at + timeout <= watermark and following[0] > at + timeout:
                out.add((job, at))
    return out


def test_undecided_signs_wait():
    assert leases.decided([(0, False), (50, False)], 30, 20) == ([], [(0, False), (50, False)])
    assert leases.decided([(50, False), (0, False)], 30, 40) == ([0], [(50, False)])
    assert leases.decided([(0, False), (25, True)], 30, 100) == ([], [])
    assert leases.decided([(0, False), (30, False), (61, False)], 30, 60) == ([30], [(61, False)])


@pytest.mark.parametrize("seed", [1, 2])
def test_late_signs_and_a_restart_from_the_checkpoint(spark, tmp_path, seed):
    rnd = random.Random(seed)
    signs = sorted(((rnd.randrange(4), rnd.randrange(0, 3000), rnd.random() < 0.1) for _ in range(120)), key=lambda s: s[1])
    late = [(s, s[1] + rnd.randrange(90)) for s in signs]  # up to 90 seconds late, within the delay
    arrival = [s for s, _ in sorted(late, key=lambda x: x[1])]
    batches = [arrival[i : i + 20] for i in range(0, len(arrival), 20)] + [[(99, 100_000, True)], [(99, 100_001, True)]]
    source, got = tmp_path / "in", []
    source.mkdir()
    row = lambda s: (s[0], DAY + datetime.timedelta(seconds=s[1]), s[2])

    def feed(some):
        stream = leases.expiries(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source)), 120_000, "100 seconds")
        q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).start()
        try:
            for rows in some:
                spark.createDataFrame(list(map(row, rows)), SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
                q.processAllAvailable()
        finally:
            q.stop()

    leases.with_store(spark, lambda: feed(batches[:3]))
    early = len(got)
    leases.with_store(spark, lambda: feed(batches[3:]))
    start = int(DAY.replace(tzinfo=datetime.UTC).timestamp()) * 1000
    assert len(got) == len(set(got)) > early
    assert {(j, (at - start) // 1000) for j, at, _ in got} == plain(signs, 120, 99_900)
    assert all(end == at + 120_000 for _, at, end in got)
    table = spark.createDataFrame(list(map(row, signs)), SCHEMA)
    whole = {(r.job, (r.last_sign - start) // 1000) for r in leases.expiries_of_table(table, 120_000, 0).collect()}
    assert whole == plain(signs, 120, max(s[1] for s in signs))
