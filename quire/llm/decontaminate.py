"""Benchmark decontamination: words of training texts that repeat a window of a test item.

A window is n consecutive words of an item, or all of an item that has fewer. The windows of the test set, far smaller than the
corpus, become a hash set that every task gets: a bitmap of hash digits in front of a sorted array of hashes, and
beside each hash the window itself, with which every hit is verified. A set of more than BLOCK windows is taken in blocks
of about that many; each block meets all texts, and what the blocks found of a text is joined.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.workspace import materialize, schema_with, slices, with_columns

N = 10
#: Windows of one block at most, about; a window of ten words with its item takes some 150 bytes.
BLOCK = 500_000
#: Bytes of a text that are looked at once.
PIECE = 4 << 20
#: Bytes of windows of one block at most, about.
BLOCK_BYTES = 64 << 20

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BLANK = 0x20
#: Words are runs of digits, letters and bytes of characters beyond ASCII; A-Z become a-z, all else a blank.
_WORD, _GAP = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else _BLANK for b in range(256))


class Words:
    """The words of several texts: `data` has each word in lower case and a blank after it, `begin` where each word begins
    there, `end` where it ends, `upto` for each text the number of words up to its end. `source` has where each byte of
    data comes from in the joined texts, which begin at `starts` there."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer((b" ".join(texts) + b" ").translate(_NORMAL), np.uint8)
        inside = raw != _BLANK
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        self.source = np.flatnonzero(keep)
        packed = raw[self.source]
        self.data = packed.tobytes()
        self.end = np.flatnonzero(packed == _BLANK)
        self.begin = np.concatenate((np.zeros(1, np.int64), self.end[:-1] + 1))[: len(self.end)]
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.starts = np.cumsum(lens) - lens
        self.upto = np.searchsorted(self.source[self.begin], self.starts + lens)
        self._packed = packed

    def left(self) -> np.ndarray:
        """For each word how many words its text has from there on."""
        return np.repeat(self.upto, np.diff(self.upto, prepend=0)) - np.arange(len(self.begin))

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """What `hashes` needs: running sums of the bytes by powers of a number, and the powers of its inverse."""
        up, down = _powers(1 << max(16, int(len(self._packed)).bit_length()))
        v = _mix(self._packed.astype(np.uint64) + _U(1))
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(v * up[: len(v)]))), down

    def hashes(self, k: int, at: np.ndarray, totals: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """A 64-bit hash of the k words from each of the words `at`."""
        total, down = totals
        a, b = self.begin[at], self.end[at + k - 1]
        return _mix((total[b] - total[a]) * down[a] + _U(k))

    def window(self, at: int, k: int) -> bytes:
        return self.data[self.begin[at] : self.end[at + k - 1]]


_held: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _held:
        _held.clear()
        with np.errstate(over="ignore"):
            _held[n] = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64)))) for x in (_STEP, pow(_STEP, -1, 1 << 64)))
    return _held[n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class WindowSet:
    """A hash set of windows with the items that have each: rows (window, number of words, item)."""

    def __init__(self, windows: list[bytes], sizes: list[int], items: list):
        by_window: dict[bytes, list] = {}
        lengths: dict[bytes, int] = {}
        for w, k, i in zip(windows, sizes, items):
            by_window.setdefault(w, []).append(i)
            lengths[w] = k
        self.texts = list(by_window)
        self.items = [tuple(by_window[w]) for w in self.texts]
        k = np.array([lengths[w] for w in self.texts], np.int64)
        self.lengths = sorted(set(k.tolist()))
        found = Words(self.texts)
        at = found.upto - k  # each window is one text of k words
        keys = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            totals = found.totals()
            for size in self.lengths:
                keys[k == size] = found.hashes(size, at[k == size], totals)
        order = np.argsort(keys, kind="stable")
        self.keys, self.of = keys[order], order
        self.bits = _U(64 - max(10, int(len(keys)).bit_length() + 4))
        self.bitmap = np.zeros(1 << (64 - int(self.bits)), bool)
        self.bitmap[self.keys >> self.bits] = True

    def hits(self, words: Words) -> Iterator[tuple[int, int, tuple]]:
        """(first word, number of words, items) of every window that occurs in the texts."""
        if not len(words.begin) or not len(self.keys):
            return
        left = words.left()
        with np.errstate(over="ignore"):
            totals = words.totals()
            for k in self.lengths:
                at = np.flatnonzero(left >= k)
                h = words.hashes(k, at, totals)
                seen = self.bitmap[h >> self.bits]
                at, h = at[seen], h[seen]
                first, last = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
                likely = last > first
                for w, a, b in zip(at[likely].tolist(), first[likely].tolist(), last[likely].tolist()):
                    window = words.window(w, k)
                    for j in self.of[a:b].tolist():
                        if self.texts[j] == window:
                            yield w, k, self.items[j]


def windows_of_items(items: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = N) -> DataFrame:
    """Rows (window, k, item): the distinct windows of each item, their words joined by a blank. An item without words,
    or with null text, has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            words = Words([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            first, windows, sizes, rows = 0, [], [], []
            for row, upto in enumerate(words.upto.tolist()):
                k = min(n, upto - first)
                found = {words.window(i, k) for i in range(first, upto - k + 1)} if k else ()
                windows += found
                sizes += [k] * len(found)
                rows += [row] * len(found)
                first = upto
            yield pa.record_batch([pa.array(windows, pa.binary()), pa.array(sizes, pa.int32()), batch.column("item").take(pa.array(rows, pa.int64()))], names=["window", "k", "item"])

    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"window binary, k int, item {rows.schema['item'].dataType.simpleString()}").distinct()


def _scan(docs: DataFrame, text_col: str, index: Broadcast, new: dict[str, str]) -> DataFrame:
    """Rows of docs with n_words, runs of words hit and the items that hit, sorted."""
    of_items = docs.sparkSession.createDataFrame([], f"items {new['items']}").schema["items"].dataType
    item_list = to_arrow_type(of_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in slices(batches, text_col):
            texts = [t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            counts, hits = _hits_of_long(found, texts[0]) if len(texts) == 1 and len(texts[0]) > PIECE else _hits_of(found, texts)
            spans: dict[int, list] = {}
            items: dict[int, set] = {}
            for row, begin, k, who in hits:
                spans.setdefault(row, []).append((begin, begin + k))
                items.setdefault(row, set()).update(i for i in who if i is not None)
            runs = [[{"start": a, "stop": b} for a, b in joined(spans.get(i, ()))] for i in range(batch.num_rows)]
            named = [sorted(items.get(i, ())) for i in range(batch.num_rows)]
            yield with_columns(batch, {"n_words": pa.array(counts, pa.int64()), "runs": pa.array(runs, _RUNS), "items": pa.array(named, item_list)})

    return docs.mapInArrow(run, schema_with(docs, new))


def _hits_of(found: WindowSet, texts: list[bytes]) -> tuple[list[int], list[tuple]]:
    """The number of words of each text, and (text, first word, number of words, items) of each hit."""
    words = Words(texts)
    first = np.concatenate(([0], words.upto[:-1]))
    rows = ((int(np.searchsorted(words.upto, w, "right")), w, k, who) for w, k, who in found.hits(words))
    return (words.upto - first).tolist(), [(row, w - int(first[row]), k, who) for row, w, k, who in rows]


def _hits_of_long(found: WindowSet, text: bytes) -> tuple[list[int], list[tuple]]:
    """The same of one long text, a piece at a time, each read on for as many words as a window may reach beyond it."""
    at, count, hits = 0, 0, []
    reach = max(found.lengths, default=1) - 1
    while at < len(text):
        stop = _GAP.search(text, at + PIECE)
        stop = stop.start() if stop else len(text)
        more = stop
        for _ in range(reach):
            word = _WORD.search(text, more)
            if not word:
                break
            more = word.end()
        own = len(Words([text[at:stop]]).begin)
        hits += [(0, count + w, k, who) for w, k, who in found.hits(Words([text[at:more]])) if w < own]
        count, at = count + own, stop
    return [count], hits


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def joined(spans) -> list[tuple[int, int]]:
    """Spans [start, stop) in any order as disjoint ones, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N) -> DataFrame:
    """Rows of docs with n_words, runs (disjoint runs [start, stop) of words that lie in a window of an item) and
    items (the distinct ids of items with a window in the text, sorted), in place of columns of these names.

    A-Z are lower-cased and words are runs of digits, letters and characters beyond ASCII. A null text has no words. Items that
    share a window all occur where it does; an item id that repeats is one item with all windows of its rows; a null one
    marks words but is not listed. Rows of docs that repeat are alike. Either table may be empty.
    """
    spark = docs.sparkSession
    windows = materialize(windows_of_items(benchmark, item_col, item_text_col, n), "windows")
    size = windows.agg(F.count("*"), F.sum(F.octet_length("window"))).first()
    blocks = max(1, math.ceil(size[0] / BLOCK), math.ceil((size[1] or 0) / BLOCK_BYTES))
    new = {"n_words": "long", "runs": "array<struct<start:long,stop:long>>", "items": f"array<{windows.schema['item'].dataType.simpleString()}>"}

    def block(b: int) -> Broadcast:  # collected on the driver: the bounded windows of one block of the test set
        mine = windows if blocks == 1 else windows.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == b)
        rows = mine.toArrow()
        return spark.sparkContext.broadcast(WindowSet(*(rows.column(c).to_pylist() for c in ("window", "k", "item"))))

    if blocks == 1:
        return _scan(docs, text_col, block(0), new)
    # a row is told by its id and text; what each block finds is kept only of rows that have something
    keyed = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__place"), F.col(text_col).alias("__text"))
    parts = [_scan(keyed, "__text", block(b), new).filter("size(runs) > 0").select("__id", "__place", "runs", "items").distinct() for b in range(blocks)]
    found = reduce(DataFrame.unionByName, [materialize(p, "leaks") for p in parts])
    whole = found.groupBy("__id", "__place").agg(_union(F.array_sort(F.flatten(F.collect_list("runs")))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    empty = spark.sparkContext.broadcast(WindowSet([], [], []))
    counted = _scan(docs, text_col, empty, new).drop("runs", "items").withColumn("__at", F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__at") == F.col("__place"))
    out = counted.join(whole, same, "left")
    filled = [F.coalesce(c, F.array().cast(new[c])).alias(c) for c in ("runs", "items")]
    return out.select(*counted.drop("__at").columns, *filled)


def _union(runs: Column) -> Column:
    """Sorted runs as disjoint ones."""

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        rest = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(x["start"] <= last["stop"], F.concat(rest, F.array(wider))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(runs, F.array().cast("array<struct<start:bigint,stop:bigint>>"), add)


def n_hit(runs: str = "runs") -> Column:
    """The number of words in runs."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda total, x: total + x["stop"] - x["start"])


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the words of the runs and what stands between them. The white space before a run stays."""
    words, out, at = Words([text]), [], 0
    for a, b in runs:
        begin, end = int(words.source[words.begin[a]]), int(words.source[words.end[b - 1]])
        out.append(text[at:begin])
        at = end
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", most_percent: int = 0, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without what leaked: with remove = "spans" all rows, whose words in `runs` are cut from the
    text; with "documents" the rows of which at most `most_percent` of the words lie in such runs, as they are.
    n_words, runs and items of `find_leaks`, whose rules for nulls and repeats hold, are added."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is spans or documents, not {remove}")
    found = find_leaks(docs, benchmark, id_col, text_col, **options)
    if remove == "documents":
        return found.filter(100 * n_hit() <= most_percent * F.col("n_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            runs = batch.column("runs").to_pylist()
            clean = [cut(t, [(r["start"], r["stop"]) for r in rs]) if rs else t for t, rs in zip(texts, runs)]
            yield with_columns(batch, {text_col: pa.array(clean, pa.binary()).cast(pa.string())}).select(found_columns)

    found_columns = found.columns
    return found.mapInArrow(run, found.schema)
