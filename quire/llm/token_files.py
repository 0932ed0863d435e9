"""Token ids in Arrow files of equal-length sequences.

A folder holds, for each part of the corpus in the order of ids, a token file and an index file, both in the Arrow IPC
file format (the stream format with a footer of batch offsets). A token file has two columns of fixed-size lists,
`ids` and `mask`; row r, place c holds id number r * length + c of the part, and the mask is false only after the
part's last id. A reader maps the file and takes any sequence, or any document through the index, without copying.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.pretoken import Remembered, encoded
from quire.llm.workspace import materialize, slices

LENGTH = 2048
#: Sequences in a batch.
BATCH = 64
#: Pre-tokens that a worker remembers the ids of, from task to task, about 30 bytes each.
REMEMBERED = 1_500_000

MANIFEST = "part int, n_documents long, n_ids long, n_sequences long, tokens string, index string"


class LibraryEncoder:
    """Ids by the tokenizers library. A byte-level tokenizer encodes each pre-token on its own, so the library gets
    the distinct pre-tokens of many texts that it has not had yet, and a text's ids are those of its pre-tokens in order. With `added`,
    the file's added tokens are found in a text first, as by the library; without, special ones are text like any other."""

    def __init__(self, spec: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = not added
        self.known = Remembered(REMEMBERED)
        tokens = (json.loads(spec).get("added_tokens") or []) if added else []
        self.added = {t["content"]: np.array([t["id"]], np.uint32) for t in tokens if t["content"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if tokens else None
        #: Tokens that take blanks beside them or ask for a word's edges are left to the library.
        self.by_library = any(t.get(flag) for t in tokens for flag in ("single_word", "lstrip", "rstrip"))

    def _ids(self, new: list[str]) -> list[bytes]:
        some = (new[i : i + 4096] for i in range(0, len(new), 4096))
        return [np.array(e.ids, "<u4").tobytes() for x in some for e in self.tokenizer.encode_batch_fast(x, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not self.cut:
            yield from self._encode(texts)
            return
        cut = [[t] if self.by_library else self.cut.split(t) for t in texts]  # every second piece is an added token
        found = self._encode([p for t, c in zip(texts, cut) for p in c[::2] if not self._left(t)])
        for text, pieces in zip(texts, cut):
            if self._left(text):
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                ids = [self.added[p] if i % 2 else next(found) for i, p in enumerate(pieces)]
                yield ids[0] if len(ids) == 1 else np.concatenate(ids)

    def _left(self, text: str) -> bool:
        return self.by_library and self.cut.search(text) is not None

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        return encoded(texts, self.known, self._ids)


@lru_cache(1)
def encoder_of(spec: str, added: bool) -> LibraryEncoder:
    """The encoder of this process: a worker's tasks have one, and what it remembers."""
    return LibraryEncoder(spec, added)


def _splits_by_itself(spec: dict) -> bool:
    """Whether the tokenizer is of the kind whose pre-tokens `pretoken` makes: byte-level, nothing else done to a text."""
    pre = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


class _Sequences:
    """Cuts a stream of ids into sequences and writes them in batches."""

    def __init__(self, out, width: np.dtype, length: int):
        self.width, self.length, self.held, self.n_held = width, length, [], 0
        self.n_ids = self.n_sequences = 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(width), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(out, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.width))
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BATCH * self.length:
            self._write(self.n_held // (BATCH * self.length) * BATCH)

    def _write(self, rows: int) -> None:
        flat = np.concatenate(self.held)
        for r in range(0, rows, BATCH):
            n = min(BATCH, rows - r)
            ids = flat[r * self.length : (r + n) * self.length]
            mask = np.ones(n * self.length, bool)
            mask[len(ids) :] = False
            ids = np.concatenate((ids, np.zeros(n * self.length - len(ids), self.width)))
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
            self.writer.write_batch(pa.record_batch(columns, schema=self.schema))
            self.n_sequences += n
        self.held, self.n_held = [flat[rows * self.length :]], max(0, len(flat) - rows * self.length)

    def close(self) -> None:
        if self.n_held:
            self._write(-(-self.n_held // self.length))
        self.writer.close()


def write_token_files(df: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, length: int = LENGTH, added: bool = False) -> DataFrame:
    """Encode every whole text, append end_id to each, and write the ids in the order of id_col to Arrow files in
    `folder` (any URI that pyarrow opens, shared by all executors). Returns the manifest, which is itself a table in
    the shared folder: a row for each part.

    A null or empty text has the end id alone. Rows of one id follow each other, ordered by a hash of the text; null ids
    come first. With `added`, the literal of an added token gives that token's id, as in a plain call of the library; without,
    special tokens are text like any other. An empty table gives an empty manifest. An attempt that is lost leaves files that no manifest names.
    """
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    if not _splits_by_itself(json.loads(spec)):
        raise ValueError("a byte-level tokenizer without normalizer is needed")
    encoder = spark.sparkContext.broadcast(spec)
    size = max([*json.loads(spec)["model"]["vocab"].values(), *[t["id"] for t in json.loads(spec).get("added_tokens") or []]]) + 1
    width = np.dtype("<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        codec, (files, at) = encoder_of(encoder.value, added), fs.FileSystem.from_uri(folder)
        files.create_dir(at, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
        rows = start = 0
        with files.open_output_stream(f"{at}/{name}.tokens.arrow") as out, files.open_output_stream(f"{at}/{name}.index.arrow") as index:
            sequences = _Sequences(out, width, length)
            schema = pa.schema([("id", first.schema.field("id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
            with pa.ipc.new_file(index, schema) as documents:
                for batch in slices(_with(first, batches), "text"):
                    n = []
                    for ids in codec.encode([t or "" for t in batch.column("text").to_pylist()]):
                        sequences.add(np.append(ids, np.uint32(end_id)))
                        n.append(len(ids) + 1)
                    ends = np.cumsum(n) + start
                    documents.write_batch(pa.record_batch([batch.column("id"), pa.array(ends - n), pa.array(n, pa.int64())], schema=schema))
                    rows, start = rows + len(n), int(ends[-1])
            sequences.close()
        names = [[part], [rows], [sequences.n_ids], [sequences.n_sequences], [f"{folder}/{name}.tokens.arrow"], [f"{folder}/{name}.index.arrow"]]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.record_batch([pa.array(x, k) for x, k in zip(names, kinds)], names=["part", "n_documents", "n_ids", "n_sequences", "tokens", "index"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    return materialize(ordered.mapInArrow(write, MANIFEST), "manifest")


def _with(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from (b for b in rest if b.num_rows)


class TokenFile:
    """Random access to a token file."""

    def __init__(self, uri: str):
        files, at = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(at) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(at)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def sequence(self, r: int) -> tuple[pa.Array, pa.Array]:
        """The ids and the mask of row r, as views of the file."""
        batch = self.reader.get_batch(r // BATCH)
        at = r % BATCH * self.length
        return tuple(batch.column(c).values.slice(at, self.length) for c in ("ids", "mask"))

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n of the part, a view unless they cross a batch."""
        size, out = BATCH * self.length, []
        while n > 0:
            flat = self.reader.get_batch(start // size).column("ids").values.to_numpy()
            out.append(flat[start % size : start % size + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, "<u4")


def read_token_files(manifest: DataFrame, id_type: str = "long", id_col: str = "doc_id") -> DataFrame:
    """Each document of the files a manifest names: its id, `start` (ids of all documents before it), `n_tokens`, and
    `ids`, packed as unsigned 32-bit little-endian integers."""
    parts = manifest.count()
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    work = manifest.withColumn("before", before).repartition(max(1, parts), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = TokenFile(row["tokens"])
                files, at = fs.FileSystem.from_uri(row["index"])
                with files.open_input_file(at) as f:
                    index = pa.ipc.open_file(f)
                    for i in range(index.num_record_batches):
                        some = index.get_batch(i)
                        for j in range(0, some.num_rows, 1000):
                            few = some.slice(j, 1000)
                            starts, n = few.column("start").to_numpy(), few.column("n_tokens")
                            ids = [tokens.ids(a, k).astype("<u4").tobytes() for a, k in zip(starts.tolist(), n.to_pylist())]
                            yield pa.record_batch([few.column("id"), pa.array(starts + row["before"]), n, pa.array(ids, pa.binary())], names=[id_col, "start", "n_tokens", "ids"])

    return work.mapInArrow(read, f"{id_col} {id_type}, start long, n_tokens long, ids binary")
