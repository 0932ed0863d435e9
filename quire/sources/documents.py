"""Single files that are put in place whole: a JSON document, and an archive of arrays."""

from __future__ import annotations

import io
import json
import uuid
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that may become one document; a larger one is written as a table.
MOST = 200_000


def put(spark: SparkSession, path: str, data: bytes, overwrite: bool = True) -> None:
    """Write a file beside its place and rename it there in one step. Without `overwrite` a file that is there is an error."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    final, staged = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = final.getFileSystem(conf)
    context = fs.FileContext.getFileContext(files.getUri(), conf)
    kind = getattr(fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1 if overwrite else 0)
    if overwrite:
        options[0] = kind.OVERWRITE
    out = files.create(staged, False)
    try:
        out.write(bytearray(data))
        out.close()
        context.rename(staged, final, options)
    except Exception:
        files.delete(staged, False)
        raise


def small(df: DataFrame) -> list:
    rows = df.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"over {MOST} rows make no document")
    return rows


def write_json(df: DataFrame, path: str, key: str | None = None) -> None:
    """The rows as one JSON document, an array or, with a key, an object by it; members without a value are left out, keys are
    in order. The old document stays until the new one is whole."""
    rows = [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in small(df)]
    body = {str(r.pop(key)): r for r in rows} if key else rows
    put(df.sparkSession, path, (json.dumps(body, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n").encode())


def write_npz(tables: dict[str, DataFrame], path: str) -> None:
    """One compressed archive with an array for each column of small tables, named `table_column`. Never over a file that is there."""
    arrays = {f"{name}_{c}": np.array([r[c] for r in rows]) for name, df in tables.items() if (rows := small(df)) is not None for c in df.columns}
    buffer = io.BytesIO()
    np.savez_compressed(buffer, **arrays)
    if zipfile.ZipFile(io.BytesIO(buffer.getvalue())).testzip():
        raise OSError("the archive is damaged")
    put(next(iter(tables.values())).sparkSession, path, buffer.getvalue(), overwrite=False)
