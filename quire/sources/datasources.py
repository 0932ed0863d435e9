"""Formats that Spark does not read itself, as Python data sources: packed arrays and members of npz archives by ranges
of rows, and growing files of JSON lines as a stream.

Partitions are planned from sizes alone, so a large file is read in parts by many tasks. Paths are those of any file
system that pyarrow opens (a shared mount, hdfs://, s3://); files of a folder are taken by name. Register with
`register(spark)`.
"""

from __future__ import annotations

import ast
import json
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of one partition, about, unless the option `partbytes` says otherwise.
PART_BYTES = 32 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files_of(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder that end so, by name."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.File and f.base_name.endswith(ending)]
    return sorted((f.path, f.size) for f in found)


class Rows(InputPartition):
    """Rows first to last of an array that begins at a byte of a file; `whole` where it can be read only as a whole."""

    def __init__(self, file: str, name: str, begin: int, dtype: str, width: int, first: int, last: int, whole: bool = False):
        super().__init__((file, name, first))
        self.file, self.name, self.begin, self.dtype, self.width, self.first, self.last, self.whole = file, name, begin, dtype, width, first, last, whole


def _ranges(file: str, name: str, begin: int, dtype: str, width: int, rows: int, part: int) -> list[Rows]:
    step = max(1, part // (np.dtype(dtype).itemsize * width))
    return [Rows(file, name, begin, dtype, width, a, min(a + step, rows)) for a in range(0, rows, step)]


class _Arrays(DataSourceReader):
    def __init__(self, options: dict, ending: str):
        self.path, self.options, self.ending = options["path"], options, ending
        self.part = int(options.get("partbytes", PART_BYTES))

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        size = np.dtype(partition.dtype).itemsize * partition.width
        with fs.open_input_file(partition.file) as f:
            if partition.whole:
                with zipfile.ZipFile(f) as z, z.open(partition.name) as m:
                    m.read(partition.begin)
                    data = m.read()
            else:
                f.seek(partition.begin + partition.first * size)
                data = f.read((partition.last - partition.first) * size)
        n = partition.last - partition.first
        if len(data) != n * size:
            raise ValueError(f"{partition.file}!{partition.name} ends early: {len(data)} of {n * size} bytes")
        x = np.frombuffer(data, partition.dtype).reshape(n, partition.width)
        for a in range(0, n, 10_000):
            part = x[a : a + 10_000]
            flat = pa.array(np.ascontiguousarray(part.astype(np.float64).ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * partition.width), flat)
            places = pa.array(np.arange(partition.first + a, partition.first + a + len(part), dtype=np.int64))
            yield pa.record_batch([pa.array([partition.file] * len(part)), pa.array([partition.name] * len(part)), places, lists], names=["file", "member", "place", "numbers"])


class PackedReader(_Arrays):
    def partitions(self) -> list[Rows]:
        dtype, width = self.options.get("dtype", "<f4"), int(self.options["width"])
        size, out = np.dtype(dtype).itemsize * width, []
        for file, length in files_of(self.path, self.options.get("ending", "")):
            if length % size:
                raise ValueError(f"{file} has {length} bytes, not a multiple of {size}")
            out += _ranges(file, "", 0, dtype, width, length // size, self.part)
        return out


class NpzReader(_Arrays):
    def partitions(self) -> list[Rows]:
        wanted, out = self.options.get("member"), []
        fs, _ = opened(self.path)
        for file, _ in files_of(self.path, ".npz"):
            with fs.open_input_file(file) as f:
                try:
                    names = zipfile.ZipFile(f).infolist()
                except zipfile.BadZipFile as e:
                    raise ValueError(f"{file} is no archive: {e}") from e
                for info in names:
                    if wanted in (None, info.filename.removesuffix(".npy")):
                        out += self._member(f, file, info)
        if not out and wanted:
            raise ValueError(f"no archive in {self.path} has a member {wanted} with rows")
        return out

    def _member(self, f, file: str, info: zipfile.ZipInfo) -> list[Rows]:
        try:
            with zipfile.ZipFile(f) as z, z.open(info) as m:
                if m.read(6) != b"\x93NUMPY":
                    raise ValueError("no array")
                major = m.read(2)[0]
                length = struct.unpack("<H" if major == 1 else "<I", m.read(2 if major == 1 else 4))[0]
                header = ast.literal_eval(m.read(length).decode("latin1"))
        except (ValueError, SyntaxError, zipfile.BadZipFile, struct.error) as e:
            raise ValueError(f"{file}!{info.filename} is damaged: {e}") from e
        shape, dtype = header["shape"], header["descr"]
        if header["fortran_order"] or not 1 <= len(shape) <= 2 or not isinstance(dtype, str) or np.dtype(dtype).kind not in "iuf":
            raise ValueError(f"{file}!{info.filename} is no table of numbers: {dtype} {shape}")
        rows, width = shape[0], shape[1] if len(shape) == 2 else 1
        prefix = 6 + 2 + (2 if major == 1 else 4) + length
        if info.compress_type != zipfile.ZIP_STORED:
            return [Rows(file, info.filename, prefix, dtype, width, 0, rows, True)] if rows else []
        f.seek(info.header_offset + 26)
        name, extra = struct.unpack("<HH", f.read(4))
        return _ranges(file, info.filename, info.header_offset + 30 + name + extra + prefix, dtype, width, rows, self.part)


class PackedArrays(DataSource):
    """Rows of `width` numbers of a type without anything between them. Options: path, width, dtype (<f4), ending."""

    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> str:
        return "file string, member string, place long, numbers array<double>"

    def reader(self, schema) -> DataSourceReader:
        return PackedReader(self.options, "")


class NpzArrays(DataSource):
    """Members of npz archives, one or all. Options: path, member. A stored member is read by ranges, a compressed one whole."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "file string, member string, place long, numbers array<double>"

    def reader(self, schema) -> DataSourceReader:
        return NpzReader(self.options, ".npz")


class Lines(InputPartition):
    def __init__(self, file: str, begin: int, end: int):
        super().__init__((file, begin))
        self.file, self.begin, self.end = file, begin, end


class JsonLinesStream(DataSourceStreamReader):
    """Offsets are how far each file was read, to the end of a whole line: the same offsets give the same rows again."""

    def __init__(self, options: dict):
        self.path, self.ending = options["path"], options.get("ending", ".jsonl")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, _ = opened(self.path)
        return {file: end for file, size in files_of(self.path, self.ending) if (end := self._whole(fs, file, size))}

    def _whole(self, fs, file: str, size: int, step: int = 1 << 16) -> int:
        """The end of the last whole line."""
        with fs.open_input_file(file) as f:
            end = size
            while end:
                begin = max(0, end - step)
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        return [Lines(file, start.get(file, 0), last) for file, last in sorted(end.items()) if last > start.get(file, 0)]

    def read(self, partition: Lines) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        at = partition.begin
        with fs.open_input_stream(partition.file) if not at else fs.open_input_file(partition.file) as f:
            if at:
                f.seek(at)
            rest = b""
            while at < partition.end:
                block = f.read(min(1 << 20, partition.end - at))
                if not block:
                    raise ValueError(f"{partition.file} became shorter than {partition.end}")
                at += len(block)
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    if line.strip():
                        yield partition.file, *_event(line)

    def commit(self, end: dict) -> None:
        pass


def _event(line: bytes) -> tuple[str | None, str, str | None]:
    """(kind, body, problem): the member `type` of an object; what is no object is a problem, not an error."""
    text = line.decode("utf-8", "replace").rstrip("\r")
    try:
        found = json.loads(text)
    except ValueError:
        return None, text, "no json"
    if not isinstance(found, dict):
        return None, text, "no object"
    kind = found.get("type")
    return (kind if isinstance(kind, str) else None), text, None


class JsonLines(DataSource):
    """A stream of the lines of files that grow. Options: path, ending (.jsonl)."""

    @classmethod
    def name(cls) -> str:
        return "jsonlines"

    def schema(self) -> str:
        return "file string, kind string, body string, problem string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return JsonLinesStream(self.options)


def register(spark: SparkSession) -> None:
    for source in (PackedArrays, NpzArrays, JsonLines):
        spark.dataSource.register(source)
