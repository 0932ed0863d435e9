"""Sharding by a k-d tree over document metadata.

The items are groups of equal texts, which stay together, with the bytes they hold and the metadata of the group. A node
that holds more than one leaf's bytes is split at the weighted median (or the quantile that leaves whole leaves on both
sides) of the dimension in which it is widest, until each leaf has the target. Medians are found exactly from histograms:
each round adds up bytes by a few thousand intervals of the key, on all nodes of a level at once, and goes on inside
the interval that holds the median.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.workspace import lookup, materialize

#: Intervals of a node in one round, at most.
INTERVALS = 4096
#: Numbers that reach the driver in one round, about.
DRIVER_ROWS = 100_000
#: A split may miss its target by this part of a leaf.
TOLERANCE = 0.001
#: A group of equal texts with more than this part of a leaf's bytes is dealt in parts, as no balance is possible otherwise.
LARGE_GROUP = 0.5
#: ... of about this part of a leaf.
GROUP_PART = 0.05
#: A dimension whose median misses by more than this part of a leaf gives way to the next widest, if that misses by less.
MISS = 0.01
#: Rows of a shard that are numbered together.
CELL = 20_000
_RANGE = 1 << 31


def _hashed(column: Column) -> Column:
    return F.coalesce((F.crc32(column.cast("string")) / 2).cast("long"), F.lit(0))


def split_by_kdtree(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("source", "lang"), shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """For every row: id_col, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes and one. The tree has `shards` leaves, or as many as target_bytes asks for. Its
    dimensions are the size (in logarithm) and the metadata columns (by hash; null is a value of its own), of the row
    with the least values in a group of equal texts. Equal keys are split by a hash of the text, so a value that most
    rows have does not hinder a median. Equal texts share a shard unless they have over LARGE_GROUP of a leaf's bytes.
    slot numbers the rows of a shard from 0. A null text counts as empty; rows that repeat are numbered one by one; an
    empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        *[_hashed(F.col(c)).alias(f"d{i + 1}") for i, c in enumerate(metadata)],
    )
    rows = materialize(rows, "metadata")
    dims = [f"d{i}" for i in range(len(metadata) + 1)]
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    leaves = shards if shards is not None else max(1, round(total / target_bytes))
    leaf = total / leaves

    # groups of equal texts; the few large ones in parts
    log_size = (F.log2(F.min("size").cast("double")) * (_RANGE // 48)).cast("long").alias("d0")
    groups = rows.groupBy("group").agg(F.sum("size").alias("weight"), log_size, *[F.min(d).alias(d) for d in dims[1:]])
    groups = groups.withColumn("parts", F.greatest(F.lit(1), F.when(F.col("weight") > LARGE_GROUP * leaf, F.ceil(F.col("weight") / max(1.0, GROUP_PART * leaf)))).cast("int"))
    items = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    items = items.withColumn("weight", F.col("weight") / F.col("parts")).withColumn("tie", F.xxhash64("group", "part").bitwiseAND(0xFFFFFFFF))
    items = materialize(items, "items")
    placed = materialize(_grow(items, dims, leaves, leaf).select("group", "part", "parts", F.col("node").alias("shard")), "placed")

    # every row takes its group's shard
    parts = placed.select("group", "parts").filter("parts > 1").distinct()
    in_parts = rows.select("id", "size", "text_crc32", "group").join(F.broadcast(parts), "group", "left")  # fewer than 1 / LARGE_GROUP for each leaf
    keyed = in_parts.select("id", "size", "text_crc32", F.xxhash64("group", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id", "group"), F.col("parts"))).otherwise(0).cast("int")).alias("item"))
    items = placed.select(F.xxhash64("group", "part").alias("item"), "shard", "parts")
    found = lookup(keyed, items.drop("parts"), "item", hot=items.filter("parts > 1").drop("parts"))
    return _numbered(found, n_rows, leaves).withColumnRenamed("id", id_col)


def _key(dim: str) -> Column:
    return F.col(dim) * F.lit(1 << 32) + F.col("tie")


def _table(items: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A table of one row for each node, which is broadcast: a tree has at most as many nodes as leaves."""
    return F.broadcast(items.sparkSession.createDataFrame(rows, schema))


def _grow(items: DataFrame, dims: list[str], leaves: int, leaf: float) -> DataFrame:
    """The items with their leaf, `node`. The tree is a table of nodes that is joined level by level."""
    nodes = {0: (0, leaves)}  # node -> first leaf, number of leaves
    items = items.withColumn("node", F.lit(0))
    root: dict[str, int] = {}
    while any(n > 1 for _, n in nodes.values()):
        extent = items.groupBy("node").agg(F.sum("weight").alias("weight"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("low", F.min), ("high", F.max))])
        extent = {r.node: r for r in extent.collect()}
        root = root or {d: max(1, extent[0][f"high_{d}"] - extent[0][f"low_{d}"]) if extent else 1 for d in dims}
        open_nodes = {}
        for k, (first, n) in nodes.items():
            if n > 1 and k in extent:
                r = extent[k]
                widest = sorted(dims, key=lambda d: -(r[f"high_{d}"] - r[f"low_{d}"]) / root[d])
                open_nodes[k] = [(d, r[f"low_{d}"] << 32, (r[f"high_{d}"] + 1) << 32, r.weight * (n // 2) / n) for d in widest]
        cuts: dict[int, tuple[float, str, int]] = {}
        for i in range(len(dims)):
            rest = {k: by[i] for k, by in open_nodes.items() if k not in cuts or cuts[k][0] > leaf * MISS}
            for k, (miss, cut) in _medians(items, dims, rest, leaf * TOLERANCE).items():
                cuts[k] = min(cuts.get(k, (math.inf, "", 0)), (miss, rest[k][0], cut), key=lambda x: x[0])
        grown: dict[int, tuple[int, int]] = {}
        steps = []
        for k, (first, n) in nodes.items():
            if n == 1 or k not in cuts:
                grown[first] = (first, 1)
                continue
            grown[first], grown[first + n // 2] = (first, n // 2), (first + n // 2, n - n // 2)
            steps.append((k, dims.index(cuts[k][1]), cuts[k][2], first + n // 2))
        nodes = grown
        if steps:
            joined = items.join(_table(items, steps, "node int, dim int, cut long, above int"), "node", "left")
            items = materialize(joined.withColumn("node", F.when(_of_dim(dims) >= F.col("cut"), F.col("above")).otherwise(F.col("node"))).select(*items.columns), "nodes")
    return items


def _of_dim(dims: list[str]) -> Column:
    """The key of the dimension whose number is in `dim`."""
    return F.get(F.array(*map(_key, dims)), F.col("dim"))


def _medians(items: DataFrame, dims: list[str], open_nodes: dict[int, tuple], tolerance: float) -> dict[int, tuple[float, int]]:
    """For each open node (dimension, low, high, target) by how much the target is missed, and the key below which it has that
    many bytes. The more nodes, the fewer intervals of each come to the driver, and the more rounds are made."""
    cuts: dict[int, tuple[float, int]] = {}
    search = {k: [low, high, target] for k, (_, low, high, target) in open_nodes.items()}
    while search:
        intervals = max(8, min(INTERVALS, DRIVER_ROWS // len(search)))
        wide = lambda lo, hi: max(1, -(-(hi - lo) // intervals))  # noqa: B023, E731
        asked = _table(items, [(k, dims.index(open_nodes[k][0]), lo, wide(lo, hi)) for k, (lo, hi, _) in search.items()], "node int, dim int, low long, width long")
        spread = items.join(asked, "node").select("node", "weight", _of_dim(dims).alias("key"), "low", "width")
        spread = spread.filter("key >= low").withColumn("interval", F.expr("(key - low) div width")).filter(F.col("interval") < intervals)
        sums: dict[int, dict[int, float]] = {k: {} for k in search}
        for r in spread.groupBy("node", "interval").agg(F.sum("weight").alias("weight")).collect():
            sums[r.node][r.interval] = r.weight
        for k, (lo, hi, target) in list(search.items()):
            width = wide(lo, hi)
            below, at, inside = 0.0, lo, 0.0
            for i in sorted(sums[k]):
                if below + sums[k][i] >= target:
                    at, inside = lo + i * width, sums[k][i]
                    break
                below += sums[k][i]
            else:
                at = hi
            if inside <= tolerance or width == 1 or at >= hi:
                low_side, high_side = target - below, below + inside - target
                cuts[k] = (low_side, at) if low_side <= high_side else (high_side, at + width)
                del search[k]
            else:
                search[k] = [at, min(hi, at + width), target - below]
    return cuts


def _numbered(rows: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """Number the rows of each shard from 0: cells of a shard, by a hash, are numbered on their own after those before."""
    cells = max(1, math.ceil(n_rows / (CELL * shards)))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(cells)).cast("int"))
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "text_crc32", "size"))
    return rows.withColumn("n", within).join(starts, ["shard", "cell"]).select("id", "size", "text_crc32", "shard", (F.col("start") + F.col("n") - 1).alias("slot"))
