import math
import random
from collections import Counter

from compare import SMALL, assert_same
from pyspark.sql import functions as F

from quire.llm import mixing
from quire.llm.queries import ORACLE_SQL, op9_temperature_mix


def frame(spark, seed=8):
    rnd = random.Random(seed)
    rows = [(i, "big" if i % 3 else rnd.choice(["a", "b", None]), "w " * rnd.randrange(60)) for i in range(2000)] + [(None, "a", None), (5000, "tiny", "w")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("block", F.lit("clash")).repartition(4)


def test_plan_meets_the_limit_and_the_entropy():
    tokens = {"a": 1000, "b": 100, "c": 50}
    x, passes = mixing.plan(tokens, max_repeats=3.0)
    assert 0 < x < 1 and math.isclose(max(passes.values()), 3.0, rel_tol=1e-9) and math.isclose(min(passes.values()), 1.0)
    x, passes = mixing.plan(tokens, max_repeats=100.0)
    assert x == 0 and math.isclose(passes["c"], 20)
    x, passes = mixing.plan(tokens, target_entropy=0.9)
    mix = {s: passes[s] * t for s, t in tokens.items()}
    shares = [v / sum(mix.values()) for v in mix.values()]
    assert math.isclose(-sum(p * math.log(p) for p in shares), 0.9, rel_tol=1e-9)
    _, passes = mixing.plan(tokens, max_repeats=1.0, budget=575)
    assert math.isclose(sum(passes[s] * t for s, t in tokens.items()), 575)


def test_mix_is_as_planned(spark):
    df = frame(spark)
    got = mixing.temperature_mix(df, max_repeats=None, target_entropy=1.2, block_tokens=500).collect()
    docs = df.select("doc_id", "source", mixing.word_tokens("text").alias("t")).collect()
    tokens = Counter()
    for r in docs:
        tokens["null" if r.source is None else "=" + r.source] += r.t
    _, passes = mixing.plan(dict(tokens), target_entropy=1.2)
    taken, copies = Counter(), Counter()
    for r in got:
        s = "null" if r.source is None else "=" + r.source
        taken[s] += r.n_tokens
        copies[(s, r.doc_id)] += 1
    most = max(r.t for r in docs)
    for s, t in tokens.items():
        assert passes[s] * t - most - 1 <= taken[s] <= passes[s] * t + 1, s
    for r in docs:
        s = "null" if r.source is None else "=" + r.source
        assert copies[(s, r.doc_id)] in (math.floor(passes[s] + 1e-9), math.floor(passes[s] + 1e-9) + 1)
    again = mixing.temperature_mix(df.repartition(7), max_repeats=None, target_entropy=1.2, block_tokens=500).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_cells_of_any_number_give_the_same_mix(spark, monkeypatch):
    df = frame(spark)
    mixes = []
    for digits in (0, 1, 3, 32):
        monkeypatch.setattr(mixing, "CELL_DIGITS", digits)
        mixes.append(Counter(map(str, mixing.temperature_mix(df, max_repeats=None, target_entropy=1.2, block_tokens=100).collect())))
    assert mixes[0] == mixes[1] == mixes[2] == mixes[3]


def test_budget_below_one_pass_and_empty_table(spark):
    df = frame(spark)
    got = mixing.temperature_mix(df, max_repeats=1.0, budget=5000, block_tokens=100).collect()
    assert 3500 <= sum(r.n_tokens for r in got) <= 5000 and {r["pass"] for r in got} == {0}
    assert mixing.temperature_mix(df.limit(0)).collect() == []


def test_only_built_in_operations(spark, capsys):
    op9_temperature_mix(spark, SMALL).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_gives_the_rows_of_its_sql(spark):
    assert_same(op9_temperature_mix(spark, SMALL), ORACLE_SQL["op9_temperature_mix"])
