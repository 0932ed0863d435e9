"""A stored index of vectors: cells around centroids, and in each cell short codes of what a vector differs from its centroid.

Build. Centroids and, for each of `sub_vectors` slices of the residual, a book of up to 256 code words are fitted to a
bounded sample. Every row is coded, in each of its `spill` nearest cells, so that neighbours on two sides of a border
are found from both. Codes are stored by cell, vectors beside them, all published as one generation; rows that come later
are coded with the stored model and added as further parts.

Search. A batch of queries is joined with codes by cell: each query goes to its nearest cells, of which alone the folders are
read. A cell with many rows is dealt in parts and one with many queries in blocks, so a group is bounded whatever is common.
Distances come from tables of (slice, code word) of a query in a cell. The best `refine` rows of each query are then compared by
their vectors. `exact_search` is the same without an index: all rows, in parts and blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.search import squared_l2
from quire.sources.publications import Publication, orphans

#: Vectors that the model is fitted to, at most, by a hash of their keys.
SAMPLE = 20_000
#: Below so many rows all vectors are compared, and no index is made.
LEAST_ROWS = 50_000
#: Rows of a cell, and queries of a cell, that one group holds, about.
PART, BLOCK = 20_000, 500
CODES = 256


@dataclass(frozen=True)
class Model:
    """centroids: cells x dimension; books: slices x code words x dimension / slices."""

    centroids: np.ndarray
    books: np.ndarray

    def nearest(self, x: np.ndarray, count: int) -> np.ndarray:
        """The nearest cells of each vector, nearest first, ties by number."""
        return np.argsort(_distances(x, self.centroids), axis=1, kind="stable")[:, :count]

    def encode(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = (x - self.centroids[cells]).reshape(len(x), len(self.books), -1)
        return np.stack([_distances(rest[:, j], book).argmin(1) for j, book in enumerate(self.books)], 1).astype(np.uint8)

    def table(self, query: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances of a query's slices to each code word of a cell."""
        rest = (query - self.centroids[cell]).reshape(len(self.books), 1, -1)
        return ((rest - self.books) ** 2).sum(2)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)


def _means(x: np.ndarray, count: int, rounds: int) -> np.ndarray:
    found = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(int)]
    for _ in range(rounds):
        of = _distances(x, found).argmin(1)
        sums = np.zeros_like(found)
        np.add.at(sums, of, x)
        n = np.bincount(of, minlength=len(found))[:, None]
        found = np.where(n > 0, sums / np.maximum(n, 1), found)
    return found


def fit(vectors: DataFrame, key: str, vector: str, cells: int, sub_vectors: int = 16, rounds: int = 10, seed: str = "cells") -> Model:
    """A model of at most SAMPLE vectors, taken by a hash of their keys. The dimension is a multiple of sub_vectors."""
    rows = vectors.filter(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(F.lit(seed), key)).limit(SAMPLE).toArrow()
    x = np.array(rows.column(0).to_pylist(), np.float64)
    if not len(x) or x.shape[1] % sub_vectors:
        raise ValueError(f"there must be vectors of a multiple of {sub_vectors} numbers")
    centroids = _means(x, cells, rounds)
    rest = (x - centroids[_distances(x, centroids).argmin(1)]).reshape(len(x), sub_vectors, -1)
    books = np.stack([_means(np.ascontiguousarray(rest[:, j]), min(CODES, len(x)), rounds) for j in range(sub_vectors)])
    return Model(centroids, books)


def cells_for(rows: int) -> int:
    """Cells of a table: four times the root of its rows, as far as the sample can fit them."""
    return max(1, min(int(4 * rows**0.5), SAMPLE // 32))


def indexed(rows: int) -> bool:
    """Whether a table is large enough for an index."""
    return rows >= LEAST_ROWS


def encoded(vectors: DataFrame, key: str, vector: str, model: Model, spill: int) -> DataFrame:
    """Rows (cell, key, code), `spill` of each vector; rows without a vector are not in the index."""
    count = min(spill, len(model.centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).to_pylist(), np.float64)
            near = model.nearest(x, count)
            for j in range(count):
                code = model.encode(x, near[:, j])
                yield pa.record_batch([pa.array(near[:, j], pa.int32()), batch.column(0), _bytes(code)], names=["cell", "key", "code"])

    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    return rows.mapInArrow(run, f"cell int, key {rows.schema['key'].dataType.simpleString()}, code binary")


def _bytes(code: np.ndarray) -> pa.Array:
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(code.shape[1]), len(code), [None, pa.py_buffer(np.ascontiguousarray(code).tobytes())])
    return flat.cast(pa.binary())


def build(at: Publication, vectors: DataFrame, key: str, vector: str, cells: int | None = None, sub_vectors: int = 16, spill: int = 3) -> int:
    """Fit, code and publish: `model`, `codes` by cell, and `vectors`. The new revision."""
    model = fit(vectors, key, vector, cells or cells_for(vectors.count()), sub_vectors)
    parts = [("cell", i, [float(v) for v in c]) for i, c in enumerate(model.centroids)]
    parts += [("book", j * CODES + i, [float(v) for v in w]) for j, book in enumerate(model.books) for i, w in enumerate(book)]
    parts += [("spill", spill, [])]
    rows = at.spark.createDataFrame(parts, "kind string, place long, numbers array<double>")
    return _publish(at, vectors, key, vector, model, spill, {"model": rows}, False)


def add(at: Publication, vectors: DataFrame, key: str, vector: str) -> int:
    """Code rows that are new with the stored model and add them as further parts."""
    model, spill = stored_model(at)
    return _publish(at, vectors, key, vector, model, spill, {}, True)


def _publish(at: Publication, vectors: DataFrame, key: str, vector: str, model: Model, spill: int, more: dict, append: bool) -> int:
    before = at.current()
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    codes = encoded(vectors, key, vector, model, spill).repartition("cell", F.pmod(F.xxhash64("key"), F.lit(4)))  # few files to a cell
    whole = {"codes without a vector": orphans("codes", "key", "vectors"), "vectors without a code": orphans("vectors", "key", "codes")}
    return at.publish({**more, "codes": codes, "vectors": rows}, whole, {"codes": "cell"}, expected=before["revision"] if before else 0, append=append)


def stored_model(at: Publication) -> tuple[Model, int]:
    """The model, and in how many cells a row is. Its size is that of the centroids and books alone."""
    rows = at.read("model").collect()
    kind = lambda k: [r.numbers for r in sorted((r for r in rows if r.kind == k), key=lambda r: r.place)]
    slices = len({r.place // CODES for r in rows if r.kind == "book"})
    books = np.array(kind("book"))
    return Model(np.array(kind("cell")), books.reshape(slices, -1, books.shape[1])), next(r.place for r in rows if r.kind == "spill")


def search(at: Publication, queries: DataFrame, query_key: str, vector: str, top: int = 10, probes: float = 0.25, refine: int = 100) -> DataFrame:
    """The nearest rows of each query by the index: (query, key, distance, rank). `probes` is the share of cells that a query
    looks into; of what the codes say is nearest, `refine` rows are compared by their vectors."""
    model, _ = stored_model(at)
    count = max(1, int(len(model.centroids) * probes))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = model.nearest(np.array(batch.column(1).to_pylist(), np.float64), count)
                yield pa.record_batch([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], names=["query", "vector", "cells"])

    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(query_key).alias("query"), F.col(vector).alias("vector"))
    types = {f.name: f.dataType.simpleString() for f in asked.schema}
    routed = asked.mapInArrow(route, f"query {types['query']}, vector {types['vector']}, cells array<int>").select("query", "vector", F.explode("cells").alias("cell"))
    wanted = sorted(r.cell for r in routed.select("cell").distinct().collect())  # at most one row to a cell
    codes = at.read("codes").filter(F.col("cell").isin(wanted))

    def near(cell: int, asked_for: pa.Table, rows: pa.Table) -> Iterator[tuple]:
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        keys = rows.column("key").to_numpy()
        for q, v in zip(asked_for.column("query").to_pylist(), asked_for.column("vector").to_pylist()):
            table = model.table(np.array(v, np.float64), cell)
            d = sum(table[j][code[:, j]] for j in range(code.shape[1]))
            yield q, *_best(keys, d, refine)

    found = _grid(routed, codes, "cell", near).groupBy("query", "key").agg(F.min("distance").alias("distance"))
    first = _ranked(found, refine).select("query", "key")
    both = first.join(at.read("vectors"), "key").join(asked.select("query", F.col("vector").alias("asked")), "query")
    return _ranked(both.select("query", "key", F.round(squared_l2(F.col("vector"), F.col("asked")), 6).alias("distance")), top)


def exact_search(vectors: DataFrame, key: str, queries: DataFrame, query_key: str, vector: str, top: int = 10) -> DataFrame:
    """The nearest rows of each query among all: (query, key, distance, rank)."""
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(query_key).alias("query"), F.col(vector).alias("vector"), F.lit(0).alias("cell"))
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("code"), F.lit(0).alias("cell"))

    def near(_: int, asked_for: pa.Table, rows: pa.Table) -> Iterator[tuple]:
        x = np.array(rows.column("code").to_pylist(), np.float64)
        keys = rows.column("key").to_numpy()
        for q, v in zip(asked_for.column("query").to_pylist(), asked_for.column("vector").to_pylist()):
            yield q, *_best(keys, ((x - np.array(v, np.float64)) ** 2).sum(1).round(6), top)

    return _ranked(_grid(asked, rows, "cell", near), top)


def exact_cosine(vectors: DataFrame, key: str, queries: DataFrame, query_key: str, vector: str, top: int = 10) -> DataFrame:
    """The rows of the greatest cosine of each query among all but its own: (query, key, score, rank). Scores have six places;
    of equal ones the least key comes first, rows that have none come last. Of each part and block no more than `top` rows of a
    query leave their task, so nothing of all pairs is sorted or sent."""
    asked = queries.filter(F.col(query_key).isNotNull()).select(F.col(query_key).alias("query"), F.col(vector).alias("vector"), F.lit(0).alias("cell"))
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("code"), F.lit(0).alias("cell"))

    def near(_: int, asked_for: pa.Table, rows: pa.Table) -> Iterator[tuple]:
        keys = rows.column("key").to_numpy()
        found, wanted = _by_dimension(rows.column("code")), _by_dimension(asked_for.column("vector"))
        names = asked_for.column("query").to_numpy()
        alone = np.setdiff1d(np.arange(len(names)), np.concatenate([at for at, _ in wanted.values()] or [[]]))
        for i in alone.tolist():  # no vector: no row has a score
            yield names[i].item(), *_greatest(keys[keys != names[i]], np.full((keys != names[i]).sum(), -np.inf), top)
        for dimension, (places, q) in wanted.items():
            at, x = found.get(dimension, (np.zeros(0, np.int64), np.zeros((0, dimension))))
            norms, q_norms = np.sqrt(_in_order(x * x)), np.sqrt(_in_order(q * q))
            for i in range(0, len(q), 64):
                with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                    about = (q[i : i + 64] @ x.T) / (q_norms[i : i + 64, None] * norms[None, :])
                about[(q_norms[i : i + 64, None] * norms[None, :]) == 0] = 0.0
                np.nan_to_num(about, copy=False, nan=np.inf, posinf=np.inf, neginf=-np.inf)
                for j, guess in enumerate(about):
                    name = names[places[i + j]]
                    guess[keys[at] == name] = -np.inf
                    # sums of another order differ by far less than the margin: what can be in the top is looked at again
                    best = np.flatnonzero(guess >= (np.partition(guess, -top)[-top] - 2e-6 if len(guess) > top else -np.inf))
                    best = best[keys[at[best]] != name]
                    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                        norm = q_norms[i + j] * norms[best]
                        s = np.where(norm == 0, 0.0, _in_order(x[best] * q[i + j]) / norm)
                    k, s = keys[at[best]], _six_places(s)
                    if len(k) < top:
                        rest = np.setdiff1d(np.arange(len(keys)), at)
                        rest = rest[keys[rest] != name]
                        k, s = np.concatenate((k, keys[rest])), np.concatenate((s, np.full(len(rest), -np.inf)))
                    yield name.item(), *_greatest(k, s, top)

    near_by = _grid(asked, rows, "cell", near).withColumnRenamed("distance", "score")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return near_by.withColumn("rank", rank).filter(F.col("rank") <= top)


def _by_dimension(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The places and the matrix of the vectors of each length; those that are null or have a null in them are left out."""
    lists = column.combine_chunks()
    if not len(lists):
        return {}
    flat, starts = lists.values.cast(pa.float64()), lists.offsets.to_numpy()
    numbers, holes = flat.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))))
    fine = lists.is_valid().to_numpy(zero_copy_only=False) & (holes[starts[1:]] == holes[starts[:-1]])
    sizes = np.diff(starts)
    out = {}
    for n in np.unique(sizes[fine]).tolist():
        at = np.flatnonzero(fine & (sizes == n))
        out[n] = at, numbers[starts[at][:, None] + np.arange(n)]
    return out


def _in_order(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added from left to right as columns of Spark are."""
    return np.add.accumulate(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _six_places(x: np.ndarray) -> np.ndarray:
    """Numbers rounded as by `round`: by their decimal digits, halves away from zero."""
    out = np.round(x, 6)
    with np.errstate(invalid="ignore"):
        y = np.abs(x) * 1e6
        half = np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6)
    for i in half.tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _greatest(keys: np.ndarray, s: np.ndarray, top: int) -> tuple[list, list]:
    """The keys of the greatest scores, ties by key; NaN is above all, and what has no score is null and last."""
    order = np.lexsort((keys, -np.nan_to_num(s, nan=np.inf, posinf=np.inf, neginf=-np.inf)))[:top]
    return keys[order].tolist(), [None if v == -np.inf else v for v in s[order].tolist()]


def _best(keys: np.ndarray, d: np.ndarray, count: int) -> tuple[list, list]:
    """The keys with the least distances, ties by key."""
    if len(d) > count:
        least = np.partition(d, count - 1)[count - 1]
        at = np.flatnonzero(d <= least)
        keys, d = keys[at], d[at]
    order = np.lexsort((keys, d))[:count]
    return keys[order].tolist(), d[order].tolist()


def _grid(queries: DataFrame, rows: DataFrame, cell: str, near) -> DataFrame:
    """(query, key, distance) of what `near` finds in each cell. A cell's rows are dealt in parts of about PART and its queries in
    blocks of about BLOCK; each part meets each block in a group of its own."""
    parts = rows.groupBy(cell).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    blocks = queries.groupBy(cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = F.broadcast(parts.join(blocks, cell))  # one narrow row to a cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n, by: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
    left = queries.join(sizes, cell).select(cell, "query", "vector", mine("blocks", "query").alias("block"), every("parts").alias("part"))
    right = rows.join(sizes, cell).select(cell, "key", "code", mine("parts", "key").alias("part"), every("blocks").alias("block"))
    types = (left.schema["query"].dataType.simpleString(), right.schema["key"].dataType.simpleString())

    def meet(group: tuple, asked: pa.Table, found: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if asked.num_rows and found.num_rows:
            for q, keys, d in near(group[0].as_py(), asked, found):
                out[0].extend([q] * len(keys))
                out[1].extend(keys)
                out[2].extend(d)
        return pa.table([pa.array(out[0], asked.schema.field("query").type), pa.array(out[1], found.schema.field("key").type), pa.array(out[2], pa.float64())], names=["query", "key", "distance"])

    by = (cell, "part", "block")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, f"query {types[0]}, key {types[1]}, distance double")


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each query by distance and key; of each task no more than those go further."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top)
