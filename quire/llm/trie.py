"""The prefix trie of many sequences, conversations for one, by Patricia construction.

A sequence is a path of steps; each step has a 16-byte key and a weight, so a path is the keys one after another and paths
in the order of their bytes are the trie from left to right. Equal paths are first made one, with their number and least id.
The sorted paths are dealt to tasks in ranges. A task walks its range with a stack of *points*: where paths branch or end,
and at the leaves. Between two points lies a compressed edge. What a point has of the paths below it (their number, least id,
leaves, and the weight of their nodes) is added up as points leave the stack; then an edge is expanded to its unary nodes,
whose sums are those of its lower end plus the suffix sums along the edge.

Two neighbouring ranges share the nodes above the longest common prefix of the paths where they meet. That length is found
first, from rows of the two paths alone; then a task knows which nodes it sees first and which it shares. All sums are such
that the parts of a shared node add up, so those nodes, one path to a range, are folded by a group-by, and the rest is whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.workspace import lookup, materialize

#: Bytes of a step's key.
KEY = 16
#: Ids of one sequence that are written as one piece of text.
PIECE = 2000
#: A point is hot when it has more than one in so many of all points as children, so there are fewer hot ones than this.
HOT_SHARE = 1000

_NODES = "least long, depth long, n_convs long, n_children long, n_leaves long, heavy long, light long, path_key binary, shared boolean, key binary, parent_key binary"


def step_key(*parts: Column) -> Column:
    """16 bytes of the SHA-256 of text columns, each told from the next by its length."""
    whole = F.concat_ws("", *[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts])
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * KEY))


def paths(df: DataFrame, id_col: str, order: list[str], key: Column, weight: Column) -> DataFrame:
    """Rows (id, steps): each id's steps (key, weight) by `order`, nulls first, ties by key and weight. Rows with a null
    id belong to no sequence. A sequence is one row, of 24 bytes and what `order` takes for each step."""
    step = F.struct(*order, key.alias("key"), F.coalesce(weight, F.lit(0)).alias("weight"))
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), step.alias("step"))
    grouped = rows.groupBy("id").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    return grouped.select("id", F.transform("steps", lambda s: F.struct(s["key"].alias("key"), s["weight"].alias("weight"))).alias("steps"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of rows (id long, steps array of (key binary of 16 bytes, weight long)).

    One row for each distinct sequence of first steps, the empty one included: conv_id (the least id that begins so), depth,
    parent_conv_id (its parent's conv_id; null for the root), n_convs (ids that begin so), n_children, n_leaves (childless
    nodes at or below it), saved (over the nodes at or below it, the weight of the last step times n_convs - 1) and
    ends_sha256 (of the ids that end here, ascending, in decimal, comma-joined). Ids are distinct and not null; an id without
    steps ends at the root. Null weights are 0. Without sequences there are no nodes.
    """
    joined = F.expr(f"unhex(array_join(transform(steps, s -> hex(s.key)), ''))")
    weights = F.transform("steps", lambda s: F.coalesce(s["weight"], F.lit(0)))
    rows = materialize(sequences.select("id", joined.alias("path"), weights.alias("weights"), F.unhex(F.sha2(joined, 256)).alias("path_key")), "paths")
    distinct = rows.groupBy("path_key").agg(F.first("path").alias("path"), F.first("weights").alias("weights"), F.min("id").alias("least"), F.count("*").alias("convs"))
    ranges = materialize(distinct.repartitionByRange(F.col("path")).withColumn("part", F.spark_partition_id()), "ranges")
    walked = materialize(_walk(ranges), "nodes")
    return _whole(walked, _ends(rows))


def _in_order(ranges: DataFrame) -> DataFrame:
    return ranges.repartition("part").sortWithinPartitions("part", "path")


def _meetings(ranges: DataFrame) -> DataFrame:
    """For each range (part): above, the length of the common prefix of its first path with the last of the range before
    it, and below, of its last with the first of the next; -1 at the ends. One narrow row to a range."""
    ends = ranges.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = materialize(ends, "range_ends")
    # parts without paths are missing, so neighbours are found by rank; rows here are ranges, not data
    at = {p: i for i, p in enumerate(sorted(r.part for r in order.select("part").collect()))}
    ranked = order.join(F.broadcast(order.sparkSession.createDataFrame(sorted(at.items()), "part int, rank long")), "part")
    following = ranked.select((F.col("rank") - 1).alias("rank"), F.col("first").alias("next"))

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_common(a, b) for a, b in zip(batch.column("last").to_pylist(), batch.column("next").to_pylist())]
            yield pa.record_batch([batch.column("rank"), pa.array(found, pa.int64())], names=["rank", "below"])

    below = ranked.select("rank", "last").join(following, "rank").mapInArrow(common, "rank long, below long")
    below = materialize(below, "meetings")
    above = below.select((F.col("rank") + 1).alias("rank"), F.col("below").alias("above"))
    joined = ranked.select("part", "rank").join(below, "rank", "left").join(above, "rank", "left")
    return joined.select("part", F.coalesce("above", F.lit(-1)).alias("above"), F.coalesce("below", F.lit(-1)).alias("below"))


def _common(a: bytes, b: bytes) -> int:
    """Steps that two paths have in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // KEY
    x, y = np.frombuffer(a[:n], np.uint8), np.frombuffer(b[:n], np.uint8)
    return int(np.argmax(x != y)) // KEY


class _Point:
    """A point on the stack, with what was seen below it so far: paths, least id, leaves, introduced children, and the
    weights of the nodes strictly below it, times their number of paths (heavy) and once for each node seen first (light)."""

    __slots__ = ("depth", "convs", "least", "leaves", "children", "heavy", "light", "end")

    def __init__(self, depth: int):
        self.depth, self.convs, self.least, self.leaves, self.children, self.heavy, self.light, self.end = depth, 0, None, 0, 0, 0, 0, None


class _Range:
    """The walk over one range of sorted paths. Nodes down to `above` on its first path were first seen in the range before."""

    def __init__(self, above: int, below: int):
        self.above, self.below = above, below
        self.stack, self.path, self.weights, self.same = [_Point(0)], b"", [], None
        self.out: list[tuple] = []

    def add(self, path: bytes, weights: list[int], least: int, convs: int, key: bytes) -> None:
        steps = len(weights)
        if self.same is None:
            common, self.same = self.above, steps
        else:
            common = _common(self.path, path)
            self._leaf(common)
            self._pop(common)
            self.same = min(self.same, common)
        self.path, self.weights = path, weights
        top = self.stack[-1]
        if steps > top.depth:
            top.children += top.depth + 1 > common
            self.stack.append(top := _Point(steps))
        top.end, top.convs = key, top.convs + convs
        top.least = least if top.least is None else min(top.least, least)

    def close(self) -> None:
        if self.same is not None:
            self._leaf(self.below)
            self._pop(-1)

    def _leaf(self, common: int) -> None:
        """The path just walked is a leaf unless the next one goes on from its end."""
        if common < len(self.weights):
            self.stack[-1].leaves += 1

    def _seen_before(self) -> int:
        """Depth down to which the nodes of the path just walked were first seen in the range before; -1 for none."""
        return min(self.same, self.above)

    def _pop(self, common: int) -> None:
        """Points below `common` leave the stack; where an edge is divided there a new point stands."""
        while self.stack[-1].depth > common:
            point = self.stack.pop()
            upper = max(common, self.stack[-1].depth) if self.stack else -1
            heavy, light = self._expand(point, upper, final=common < 0)
            if not self.stack:
                return
            if self.stack[-1].depth < upper:
                branch = _Point(upper)
                branch.children = int(upper + 1 > self._seen_before())
                self.stack.append(branch)
            top = self.stack[-1]
            top.convs, top.leaves, top.heavy, top.light = top.convs + point.convs, top.leaves + point.leaves, top.heavy + heavy, top.light + light
            top.least = point.least if top.least is None else min(top.least, point.least)

    def _expand(self, point: _Point, upper: int, final: bool) -> tuple[int, int]:
        """Rows of the nodes from a point up to the one below depth `upper`; the weights at and below the uppermost."""
        before = self._seen_before()
        shared = max(before, min(self.below, len(self.weights)) if final else -1)
        keys = self._keys({point.depth, upper} | set(range(max(0, upper), min(shared, point.depth) + 1)))
        heavy, light = point.heavy, point.light
        children, end = point.children, point.end
        for depth in range(point.depth, upper, -1):
            if depth:
                heavy += self.weights[depth - 1] * point.convs
                light += self.weights[depth - 1] * (depth > before)
            mine = depth <= shared
            parent = keys[depth - 1] if depth and (depth == upper + 1 or depth - 1 <= shared) else None
            self.out.append((point.least, depth, point.convs, children, point.leaves, heavy, light, end, mine, keys[depth] if mine or depth == point.depth and point.children else None, parent))
            children, end = int(depth > before), None
        return heavy, light

    def _keys(self, depths: set[int]) -> dict[int, bytes]:
        """A 16-byte hash of each of some prefixes of the path just walked."""
        out, state, at = {}, xxhash.xxh3_128(), 0
        for depth in sorted(d for d in depths if d >= 0):
            state.update(self.path[at : depth * KEY])
            at = depth * KEY
            out[depth] = state.digest()
        return out


def _walk(ranges: DataFrame) -> DataFrame:
    """Rows of nodes, those of shared ones in parts."""
    marked = ranges.join(F.broadcast(_meetings(ranges)), "part")
    names = [x.split()[0] for x in _NODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, walk = None, None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*walk.out)) or [()] * len(names)
            walk.out = []
            types = [pa.int64()] * 7 + [pa.binary(), pa.bool_(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for p, above, below, path, weights, least, convs, key in zip(*(batch.column(c).to_pylist() for c in ("part", "above", "below", "path", "weights", "least", "convs", "path_key"))):
                if p != part:
                    if walk:
                        walk.close()
                        yield rows()
                    part, walk = p, _Range(above, below)
                walk.add(path, weights, least, convs, key)
                if len(walk.out) > 20_000:
                    yield rows()
        if walk:
            walk.close()
            yield rows()

    return _in_order(marked).mapInArrow(run, _NODES)


def _whole(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes with the parts of shared ones folded, their parents' ids and what ends there."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "heavy", "light")]
    folded = nodes.filter("shared").groupBy("depth", "key", "parent_key").agg(F.min("least").alias("least"), F.max("path_key").alias("path_key"), *sums)
    both = materialize(nodes.filter("not shared").drop("shared").unionByName(folded), "whole")
    # one row to a point with children; those with many are few, and are joined by broadcast
    points = both.filter("key is not null and n_children > 0").select(F.col("depth").alias("above"), F.col("key").alias("parent_key"), F.col("least").alias("parent"), "n_children")
    total = points.agg(F.sum("n_children")).first()[0] or 0
    hot = points.filter(F.col("n_children") * HOT_SHARE > total).drop("n_children", "above")
    asking = both.filter("parent_key is not null")
    linked = lookup(asking, points.drop("n_children", "above"), "parent_key", hot=hot)
    known = both.filter("parent_key is null").withColumn("parent", F.when(F.col("depth") > 0, F.col("least")))
    every = linked.unionByName(known)
    ending = every.filter("path_key is not null")
    every = ending.join(ends, "path_key", "left").unionByName(every.filter("path_key is null").withColumn("ends_sha256", F.sha2(F.lit(""), 256)))
    return every.select(F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("heavy") - F.col("light")).alias("saved"), "ends_sha256")


def _ends(rows: DataFrame) -> DataFrame:
    """Rows (path_key, ends_sha256). Ids are put in order and written out range by range, so a path that very many ids
    have comes to its last task as few long texts, which are hashed one after another."""
    ordered = materialize(rows.select("path_key", "id"), "ids").repartitionByRange("path_key", "id").sortWithinPartitions("path_key", "id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, texts = [], [], []
        for batch in batches:
            key = None  # a piece ends with its batch
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k == key and len(texts[-1]) < PIECE:
                    texts[-1].append(str(i))
                else:
                    key = k
                    keys.append(k)
                    firsts.append(i)
                    texts.append([str(i)])
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array([",".join(t) for t in texts], pa.string())], names=["path_key", "first", "ids"])
            keys, firsts, texts = [], [], []

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, shas = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k == key:
                    state.update(b"," + text.encode())
                    continue
                if key is not None:
                    keys.append(key)
                    shas.append(state.hexdigest())
                key, state = k, hashlib.sha256(text.encode())
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], names=["path_key", "ends_sha256"])
        if key is not None:
            yield pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["path_key", "ends_sha256"])

    pieces = ordered.mapInArrow(write, "path_key binary, first long, ids string")
    return pieces.repartition("path_key").sortWithinPartitions("path_key", "first").select("path_key", "ids").mapInArrow(digest, "path_key binary, ends_sha256 string")


def conversation_paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (id, steps) of conversations: a step is the role and text of a turn, null being empty, and weighs the bytes of
    the text. Turns are in the order of turn_col, null first; those of one turn number by their keys; rows that repeat are
    turns that repeat. Rows with a null conversation id belong to none."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    return paths(turns, conv_col, [turn_col], step_key(role, text), F.octet_length(text).cast("long"))
