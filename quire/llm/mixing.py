"""Mixing sources to target weights by temperature, in DataFrame operations only.

A source's weight is its share of tokens to the power of an exponent, normalised. The exponent is bisected until
the most repeated source is repeated no more than allowed, or until the weights have a target entropy. A
source is then passed as often as its weight asks for: whole passes, and a part of one, for which its blocks are taken in
the order of a keyed permutation as far as its budget of tokens goes, the last of them document by document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.workspace import materialize, small_enough

#: Sources at most; the driver sees one row for each.
MAX_SOURCES = 100_000
#: Tokens of a block, about.
BLOCK_TOKENS = 100_000
#: Leading digits of a block's place in the permutation that make a cell: 16 ** 3 cells of a source at most.
CELL_DIGITS = 3


def word_tokens(text: str) -> Column:
    """A text's words and an end mark; null has the end mark alone."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def _bisect(meets, steps: int = 60) -> float:
    """The least exponent in 0..1 that meets a condition which holds from some exponent on; 1 if none does."""
    if meets(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if meets(middle) else (middle, high)
    return high


def _weights(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    total = sum(tokens.values())
    powered = {s: (t / total) ** exponent for s, t in tokens.items()}
    norm = math.fsum(powered.values())
    return {s: w / norm for s, w in powered.items()}


def plan(tokens: dict[str, int], max_repeats: float | None = None, target_entropy: float | None = None, budget: int | None = None) -> tuple[float, dict[str, float]]:
    """The exponent, and how often each source is passed.

    Without a budget the mix is just so large that every source is passed once at least, so no document goes. With a
    target entropy (in nats) the exponent is the one at which the weights have it, or the nearest.
    """
    total = sum(tokens.values())

    def passes(exponent: float) -> dict[str, float]:
        weights = _weights(tokens, exponent)
        size = budget if budget is not None else max(tokens[s] / w for s, w in weights.items())
        return {s: w * size / tokens[s] for s, w in weights.items()}

    def entropy(exponent: float) -> float:
        return -math.fsum(w * math.log(w) for w in _weights(tokens, exponent).values() if w)

    if target_entropy is not None:
        exponent = _bisect(lambda x: entropy(x) <= target_entropy)
    elif max_repeats is not None:
        exponent = _bisect(lambda x: max(passes(x).values()) <= max_repeats)
    else:
        raise ValueError("a repetition limit or a target entropy is needed")
    return exponent, passes(exponent)


def temperature_mix(
    df: DataFrame,
    source: str = "source",
    id_col: str = "doc_id",
    text: str = "text",
    max_repeats: float | None = 2.0,
    target_entropy: float | None = None,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: str = "mix",
) -> DataFrame:
    """The rows of the mix: those of df, each as often as it is taken, with the columns n_tokens, pass (from 0) and
    block in place of columns of these names.

    A null source is a source. Every text has one token at least, so null and empty texts take part. Documents are
    put into blocks, and both into order, by a keyed hash of the id; rows that repeat are taken one by one. A part
    of a pass never exceeds its budget. An empty table gives an empty mix. A row of a large source is never moved to
    one task: what is added up by source are the totals of its cells, and of the blocks of one of these.
    """
    kept = [c for c in df.columns if c not in ("n_tokens", "pass", "block")]
    rows = df.select(*kept, word_tokens(text).alias("n_tokens"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")).alias("__key"))
    totals = rows.groupBy("__key").agg(F.sum("n_tokens").alias("tokens")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = {r["__key"]: r["tokens"] for r in totals}
    _, passes = plan(tokens, max_repeats, target_entropy, budget) if tokens else (1.0, {})
    table = []
    for s, t in tokens.items():
        whole = math.floor(passes[s] + 1e-9)
        table.append((s, whole, max(0, round((passes[s] - whole) * t)), max(1, -(-t // block_tokens))))
    sources = df.sparkSession.createDataFrame(table, "__key string, __whole long, __part long, __blocks long")

    digest = lambda *x: F.md5(F.concat_ws("|", F.lit(seed), *x))
    number = F.conv(F.substring(digest(F.col(id_col).cast("string")), 1, 15), 16, 10).cast("long")
    rows = rows.join(F.broadcast(sources), "__key").withColumn("block", F.pmod(number, F.col("__blocks")))

    # blocks in permuted order until a source's part of a pass is full: first by cells of that order, of which a source has few
    # thousand, then block by block inside the one cell where the part ends
    blocks = rows.groupBy("__key", "block").agg(F.sum("n_tokens").alias("tokens"), F.first("__part").alias("part"), F.first("__whole").alias("whole"))
    place = digest(F.lit("block"), F.col("__key"), F.col("block").cast("string"), F.col("whole").cast("string"))
    # one row to a block; texts are counted for it once, not by each of its uses
    blocks = materialize(blocks.withColumn("place", place).withColumn("cell", F.substring("place", 1, CELL_DIGITS)), "blocks")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = blocks.groupBy("__key", "cell").agg(F.sum("tokens").alias("in_cell"), F.first("part").alias("part"))
    cells = cells.withColumn("before", F.sum("in_cell").over(upto(Window.partitionBy("__key").orderBy("cell"))) - F.col("in_cell"))
    edges = cells.filter("before < part and before + in_cell > part").select("__key", "cell", F.col("before").alias("edge"))
    of_cells = cells.select("__key", "cell", (F.col("before") + F.col("in_cell") <= F.col("part")).alias("__all"))
    few = lambda df: F.broadcast(df) if small_enough(df) else df
    edges, of_cells = few(edges), few(of_cells)
    outside = blocks.join(of_cells, ["__key", "cell"]).join(edges, ["__key", "cell"], "left_anti").select("__key", "block", "__all", F.lit(0).cast("long").alias("__room"))
    inside_edge = blocks.join(edges, ["__key", "cell"])
    before = F.col("edge") + F.sum("tokens").over(upto(Window.partitionBy("__key").orderBy("place", "block"))) - F.col("tokens")
    inside_edge = inside_edge.withColumn("before", before).select("__key", "block", (F.col("before") + F.col("tokens") <= F.col("part")).alias("__all"), (F.col("part") - F.col("before")).alias("__room"))
    blocks = outside.unionByName(inside_edge)
    rows = rows.join(F.broadcast(blocks) if small_enough(blocks) else blocks, ["__key", "block"])
    inside = Window.partitionBy("__key", "block").orderBy(digest(F.lit("doc"), F.col(id_col).cast("string"), F.col("__whole").cast("string")), "n_tokens")
    edge = ~F.col("__all") & (F.col("__room") > 0)
    in_edge = rows.filter(edge).withColumn("__taken", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) <= F.col("__room"))
    rest = rows.filter(~edge).withColumn("__taken", F.col("__all"))
    taken = in_edge.unionByName(rest).withColumn("__n", F.col("__whole") + F.col("__taken").cast("long")).filter("__n > 0")
    return taken.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).select(*kept, "n_tokens", "pass", "block")
