"""An approximate index of vectors by cells around centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quire.operators.search import knn

#: Vectors that the centroids are fitted to, at most.
SAMPLE = 20_000
#: Below so many rows a search compares all vectors.
LEAST_ROWS = 50_000


def centroids(vectors: DataFrame, key: str, vector: str, cells: int, rounds: int = 12, seed: str = "cells") -> np.ndarray:
    """Centroids by k-means on a sample of at most SAMPLE vectors by a hash of the key, so its size does not grow."""
    rows = vectors.select(vector).orderBy(F.xxhash64(F.lit(seed), key)).limit(SAMPLE).toPandas()[vector]
    x = np.array(rows.tolist(), np.float64)
    found = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        of = ((x**2).sum(1)[:, None] - 2 * x @ found.T + (found**2).sum(1)).argmin(1)
        found = np.array([x[of == c].mean(0) if (of == c).any() else found[c] for c in range(len(found))])
    return found


def assigned(vectors: DataFrame, vector: str, found: np.ndarray) -> DataFrame:
    """Every row with the number of its nearest centroid, `cell`, by which a table of them is partitioned."""

    @F.arrow_udf(IntegerType())
    def cell(rows: pa.Array) -> pa.Array:
        x = np.array(rows.to_pylist(), np.float64)
        return pa.array((((x**2).sum(1)[:, None] - 2 * x @ found.T + (found**2).sum(1)).argmin(1) if len(x) else np.zeros(0)).astype(np.int32))

    return vectors.withColumn("cell", cell(vector))


def search(cells: DataFrame, found: np.ndarray, query: list[float], top: int, key: str, vector: str = "embedding", probes: int = 8) -> DataFrame:
    """The nearest rows of the cells whose centroids are nearest, by exact distance. On a table partitioned by cell only these
    partitions are read."""
    near = np.argsort(((found - np.array(query)) ** 2).sum(1), kind="stable")[:probes]
    return knn(cells.filter(F.col("cell").isin([int(c) for c in near])), query, top, key, vector)


def indexed(rows: int) -> bool:
    """Whether a table is large enough for cells."""
    return rows >= LEAST_ROWS
