"""Exact deduplication through a cuckoo-filter index of text digests.

Each task holds an index: a filter of short fingerprints, four to a bucket, and beside each fingerprint its stored key
and what is known of it. A digest whose fingerprint is found is compared with the keys stored in the two buckets it may
be in. Digests can be deleted again; an insertion that finds no room doubles the filter and fills it from the
stored keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.workspace import lookup, materialize, small_enough

SLOTS = 4
#: Displacements tried before the filter is doubled.
KICKS = 200
#: Live digests that a task holds; beyond it, what it has is passed on and the index starts anew.
HELD = 200_000
#: A digest is hot when it has more than one in so many of all rows, so there are fewer hot ones than this.
HOT_SHARE = 1000


class CuckooIndex:
    """digest -> value, for digests of 16 bytes or more that are themselves evenly distributed."""

    def __init__(self, buckets: int = 256):
        self.live = 0
        self._size(buckets)

    def _size(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.marks = [0] * (buckets * SLOTS)
        self.keys: list = [None] * (buckets * SLOTS)
        self.values: list = [None] * (buckets * SLOTS)

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        one = int.from_bytes(key[:8], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def find(self, key: bytes) -> int:
        """The slot of a digest, or -1."""
        mark, one, two = self._place(key)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.marks[slot] == mark and self.keys[slot] == key:
                    return slot
        return -1

    def insert(self, key: bytes, value) -> None:
        """Add a digest that is not in the index."""
        mark, one, two = self._place(key)
        self.live += 1
        bucket = one
        for kick in range(KICKS):
            for b in (bucket, self._other(bucket, mark)):
                for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not self.marks[slot]:
                        self.marks[slot], self.keys[slot], self.values[slot] = mark, key, value
                        return
            bucket = self._other(bucket, mark)
            slot = bucket * SLOTS + kick % SLOTS
            self.marks[slot], mark = mark, self.marks[slot]
            self.keys[slot], key = key, self.keys[slot]
            self.values[slot], value = value, self.values[slot]
            bucket = self._other(bucket, mark)
        rest = [*self.items(), (key, value)]
        self._size(2 * (self.mask + 1))
        self.live = 0
        for k, v in rest:
            self.insert(k, v)

    def delete(self, slot: int) -> None:
        self.marks[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.live -= 1

    def items(self) -> Iterator[tuple[bytes, list]]:
        return ((k, v) for k, v in zip(self.keys, self.values) if k is not None)


def text_digest(text_col: str) -> Column:
    """The SHA-256 of a normalised text in hexadecimal: runs of ASCII white space become one space, null is empty."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's id and the digest of its text."""
    return df.select(F.col(id_col).alias("id"), F.unhex(text_digest(text_col)).alias("digest"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (digest, id, n) through one index: ids to the smallest, n summed; a digest whose n comes to 0 is deleted.
    Rows that share the first two bytes of a digest lie together, so the index can be passed on between those."""
    index, bucket, schema = CuckooIndex(), None, None

    def out() -> pa.RecordBatch:
        found = list(index.items())
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(([k for k, _ in found], [v[0] for _, v in found], [v[1] for _, v in found]), schema)], schema=schema)

    for batch in batches:
        schema = batch.schema
        for digest, i, n in zip(*(c.to_pylist() for c in batch.columns)):
            if index.live >= HELD and digest[:2] != bucket:
                yield out()
                index = CuckooIndex()
            bucket = digest[:2]
            slot = index.find(digest)
            if slot < 0:
                index.insert(digest, [i, n])
                continue
            value = index.values[slot]
            if i is not None and (value[0] is None or i < value[0]):
                value[0] = i
            value[1] += n
            if not value[1]:
                index.delete(slot)
    if schema is not None and index.live:
        yield out()


def groups(rows: DataFrame) -> DataFrame:
    """Rows of (id, digest) to groups: digest, keep_id, group_size. Each task first folds what it has read, so that a
    digest that many rows share reaches its final task once from each."""
    schema = f"digest binary, id {rows.schema['id'].dataType.simpleString()}, n long"
    partial = rows.select("digest", "id", F.lit(1).cast("long").alias("n")).mapInArrow(_fold, schema)
    return _dealt(partial).mapInArrow(_fold, schema).select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("digest").sortWithinPartitions(F.substring("digest", 1, 2), F.col("n") < 0)


def update_groups(known: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """Groups after insertion and deletion of rows of (id, digest). A digest whose last row is deleted leaves the index.

    `live` are the rows (id, digest) that are there after the deletion, and must be given with one. They are read for the
    digests alone whose smallest id was deleted, so that the next one comes forward."""
    if deleted is not None and live is None:
        raise ValueError("the rows that stay are needed with a deletion")
    schema = f"digest binary, id {known.schema['keep_id'].dataType.simpleString()}, n long"
    rows = known.select("digest", F.col("keep_id").alias("id"), F.col("group_size").alias("n"))
    for more, n in ((inserted, 1), (deleted, -1)):
        if more is not None:
            rows = rows.unionByName(more.select("digest", F.when(F.lit(n > 0), F.col("id")).alias("id"), F.lit(n).cast("long").alias("n")).mapInArrow(_fold, schema))
    found = _dealt(rows).mapInArrow(_fold, schema).filter("n > 0").select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    if deleted is None:
        return found
    gone = deleted.select("digest", F.col("id").alias("keep_id")).distinct()
    headless = materialize(found.join(gone, ["digest", "keep_id"], "left_semi").select("digest"), "headless")
    if small_enough(headless):
        headless = F.broadcast(headless)
    heads = live.join(headless, "digest", "left_semi").groupBy("digest").agg(F.min("id").alias("__head"), F.lit(True).alias("__moved"))
    return found.join(heads, "digest", "left").select("digest", F.when(F.col("__moved"), F.col("__head")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id_col, keep_id (the smallest id among rows of equal text), group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space is replaced by one space; null counts as empty.
    A null id is smaller than none: it is kept only where all ids of its text are null. Rows that share id and text
    are one document: all of them are marked alike. An empty table gives no rows.
    """
    rows = materialize(digests(df, id_col, text_col), "digests")
    found = materialize(groups(rows), "groups")
    total = found.agg(F.sum("group_size")).first()[0] or 0
    joined = lookup(rows, found, "digest", hot=found.filter(F.col("group_size") * HOT_SHARE > total))
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size", _same("id", "keep_id").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))
