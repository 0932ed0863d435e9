"""Shared storage for intermediate tables, and joins that hold under hot keys."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import new_folder

_libc = ctypes.CDLL(None)

#: Rows of a table of fixed narrow rows (100 bytes at most) that may be broadcast; beyond it a shuffle join is used.
BROADCAST_ROWS = 100_000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, its lineage is cut, and a lost
    executor loses nothing of it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """df in four parts for each core at most, without a shuffle. A part has whole partitions, one after the other in their
    order, so that many small ones are not a task, a worker and a file each."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table of `materialize`, after which nothing may read it."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `rows` rows; reads no more than that many and one."""
    return df.limit(rows + 1).count() <= rows


def lookup(df: DataFrame, table: DataFrame, key: str, how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Join df with a table of one row per key. `hot` are the table's rows for keys that many rows of df carry (at
    most BROADCAST_ROWS of them, which the caller proves): those rows of df are joined by broadcast and never
    shuffled; the others are shuffled by a key that no longer has a hot value."""
    if hot is None:
        return df.join(table, key, how)
    marks = F.broadcast(hot.select(key, F.lit(True).alias("__hot")))
    marked = df.join(marks, key, "left")
    by_broadcast = df.join(F.broadcast(hot), key, "inner")
    rest = marked.filter(F.col("__hot").isNull()).drop("__hot").join(table, key, how)
    return by_broadcast.unionByName(rest)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose `column` has about `limit` bytes, or one row that has more, so that what is made of
    a slice is small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes + 64) // limit
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Free memory goes back to the system: a worker lives on after its task, beside others and the JVM."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns replaced or added."""
    names = [n for n in batch.schema.names if n not in new]
    return pa.record_batch([batch.column(n) for n in names] + list(new.values()), names=names + list(new))


def schema_with(df: DataFrame, new: dict[str, str]) -> str:
    kept = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema if f.name not in new]
    return ", ".join(kept + [f"`{n}` {t}" for n, t in new.items()])
