"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.workspace import BROADCAST_ROWS, discard, materialize, small_enough


def components(edges: DataFrame, at_once: int = BROADCAST_ROWS) -> DataFrame:
    """Stored edges (a long, b long) to rows (node, label): label is the smallest node that can be reached. Nodes without an
    edge to another do not occur. Up to `at_once` edges, which could be broadcast as well, are taken by one task; more go
    through rounds of stars."""
    edges = edges.select("a", "b").filter("a <> b")
    if small_enough(edges, at_once):
        return edges.coalesce(1).mapInArrow(_by_roots, "node long, label long")
    return _by_stars(edges)


def _by_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to (node, label), each node pointing to a smaller one of its component."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := above.setdefault(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
    yield pa.record_batch([pa.array(list(above), pa.int64()), pa.array([root(x) for x in list(above)], pa.int64())], names=["node", "label"])


def _by_stars(edges: DataFrame) -> DataFrame:
    """Each round is two aggregations and joins over the edges, kept in the shared folder; the number of rounds grows with
    the logarithm of the longest path."""
    rows = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    rows, seen = materialize(rows, "edges"), None
    while (now := _summary(rows)) != seen:
        seen = now
        both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        old, rows = rows, materialize(small, "edges")
        discard(old)
    roots = rows.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return rows.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def _summary(rows: DataFrame) -> tuple:
    return tuple(rows.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
