"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a whole pre-token that is in the vocabulary gets its id by one
probe, checked against the entry's bytes. Tier two, for the misses, merges the bytes of the pre-token, which are linked
to their neighbours, in the order of ranks taken from a heap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.pretoken import Remembered, encoded
from quire.llm.workspace import give_back, schema_with, slices, with_columns

#: Pre-tokens that a worker remembers the ids of, about 30 bytes each.
REMEMBERED = 500_000
#: Bytes of texts that are encoded before their ids leave the worker, about.
SLICE = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _hash(token: bytes) -> int:
    return xxhash.xxh3_64_intdigest(token)


def _slot(h: np.ndarray, shift: np.ndarray | np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + shift * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(29)
    return x % np.uint64(n)


class PerfectHash:
    """Hash and displace: each bucket of keys has a displacement that puts its keys on slots no other key has; as many
    slots as keys. A bucket of one key points at its slot directly."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 4)
        hashes = np.fromiter(map(_hash, keys), np.uint64, n)
        by = (hashes >> np.uint64(20)) % np.uint64(self.buckets)
        order = np.argsort(by, kind="stable")
        cuts = np.searchsorted(by[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)
        self.order = np.full(n, -1, np.int64)
        free = np.ones(n, bool)
        tries = np.arange(1, 65, dtype=np.uint64)
        for b in np.argsort(-np.diff(cuts), kind="stable"):
            keys_of = order[cuts[b] : cuts[b + 1]]
            if len(keys_of) < 2:
                break
            first = np.uint64(0)
            while True:
                slots = _slot(hashes[keys_of][None, :], (tries + first)[:, None], n).astype(np.int64)
                ok = free[slots].all(1)
                apart = np.sort(slots, 1)
                ok &= (apart[:, 1:] != apart[:, :-1]).all(1)
                if ok.any():
                    break
                first += np.uint64(64)
            k = int(np.argmax(ok))
            self.shift[b] = int(tries[k] + first)
            free[slots[k]] = False
            self.order[slots[k]] = keys_of
        rest = np.flatnonzero(free)
        single = [b for b in range(self.buckets) if cuts[b + 1] - cuts[b] == 1]
        for slot, b in zip(rest.tolist(), single):
            self.shift[b] = -slot - 1
            self.order[slot] = order[cuts[b]]

    def slots(self, keys: list[bytes]) -> np.ndarray:
        h = np.fromiter(map(_hash, keys), np.uint64, len(keys))
        shift = self.shift[((h >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -shift - 1, _slot(h, np.abs(shift).astype(np.uint64), self.n).astype(np.int64))


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """The ids of a pre-token: the lowest-ranked pair of neighbours is merged, the leftmost of equals first.

    Parts are linked: end[i] is where the part that begins at i ends, begin[e] is where the part that ends at e begins.
    A heap entry packs a rank, where its pair begins and where it ends; pairs[b] is the rank of two bytes or -1.
    """
    n = len(piece)
    end = list(range(1, n + 1))
    begin = list(range(-1, n))
    width = n.bit_length()
    mask, wide = (1 << width) - 1, 2 * width
    heap = [r << wide | i << width | i + 2 for i, (a, b) in enumerate(zip(piece, piece[1:])) if (r := pairs[a << 8 | b]) >= 0]
    heapq.heapify(heap)
    pop, push, rank = heapq.heappop, heapq.heappush, ranks.get
    while heap:
        x = pop(heap)
        i, stop = x >> width & mask, x & mask
        middle = end[i]
        if middle >= stop or begin[middle] != i or end[middle] != stop:
            continue
        end[i], begin[stop] = stop, i
        if stop < n and (r := rank(piece[i : end[stop]])) is not None:
            push(heap, r << wide | i << width | end[stop])
        if i and (r := rank(piece[begin[i] : stop])) is not None:
            push(heap, r << wide | begin[i] << width | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """The vocabulary as executors get it: of fixed size, whatever the corpus."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack single bytes: {missing[:5]}")
        self.ranks = ranks
        self.tokens = list(ranks)
        self.ids = [i.to_bytes(4, "little") for i in ranks.values()]
        self.pairs = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.hash = PerfectHash(self.tokens)
        self.known = Remembered(REMEMBERED)
        self.by_id: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.by_id[i] = token

    def __len__(self) -> int:
        return len(self.tokens)

    def _ids(self, new: list[str]) -> list[bytes]:
        unique = [t.encode() for t in new]
        entry = self.hash.order[self.hash.slots(unique)].tolist()
        return [self.ids[e] if self.tokens[e] == token else np.array(merge(token, self.ranks, self.pairs), "<u4").tobytes() for token, e in zip(unique, entry)]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        return encoded(texts, self.known, self._ids)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids.tolist()))


class ByteBPE:
    """Encoding and decoding of whole columns.

        bpe = ByteBPE(spark, path_of_a_rank_file)
        encoded = bpe.encode(df)               # adds token_ids
        texts = bpe.decode(encoded)            # adds decoded
        both = bpe.round_trip(df)              # adds both, in one pass

    Ids are packed: unsigned 32-bit little-endian integers in a binary column, four bytes an id (`unpacked` makes an
    array of them). A null or empty text gives no ids; texts of any length are encoded whole. An id without an entry
    decodes to nothing; ids of null decode to null. Decoded columns hold bytes. A column that already has the
    name of a new one is replaced; all others are carried along.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.codec = spark.sparkContext.broadcast(Codec(read_ranks(path)))

    def encode(self, df: DataFrame, text: str = "text", ids: str = "token_ids") -> DataFrame:
        return self._map(df, text, {ids: lambda codec, texts, _: codec.encode([t or "" for t in texts])})

    def decode(self, df: DataFrame, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
        return self._map(df, ids, {decoded: lambda codec, packed, _: (None if x is None else codec.decode(np.frombuffer(x, "<u4")) for x in packed)})

    def round_trip(self, df: DataFrame, text: str = "text", ids: str = "token_ids", decoded: str = "decoded", keep_text: bool = True) -> DataFrame:
        """Both columns; without keep_text, the texts do not come back from the workers."""
        return self._map(df, text, {ids: lambda codec, texts, _: codec.encode([t or "" for t in texts]), decoded: lambda codec, _, found: map(codec.decode, found)}, keep_text)

    def _map(self, df: DataFrame, column: str, steps: dict, keep: bool = True) -> DataFrame:
        broadcast = self.codec
        kept = df if keep else df.drop(column)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()  # what the worker's last task had is gone by now
            codec = broadcast.value
            for batch in slices(batches, column, SLICE):
                given, found, new = batch.column(column).to_pylist(), None, {}
                for name, step in steps.items():
                    found = list(step(codec, given, found))
                    new[name] = pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in found], pa.binary())
                yield with_columns(batch if keep else batch.drop_columns([column]), new)

        return df.mapInArrow(run, schema_with(kept, dict.fromkeys(steps, "binary")))


def n_tokens(ids: str | Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def unpacked(ids: str | Column) -> Column:
    """Packed ids as an array of integers."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    places = F.when(F.octet_length(ids) > 0, F.sequence(F.lit(0), (F.octet_length(ids) / 4 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    def number(i: Column) -> Column:
        digits = F.hex(ids.substr(i * 4 + 1, F.lit(4)))
        return F.conv(F.concat(*[F.substr(digits, F.lit(at), F.lit(2)) for at in (7, 5, 3, 1)]), 16, 10).cast("long")

    return F.when(ids.isNotNull(), F.transform(places, number))
