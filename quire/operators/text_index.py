"""A stored full-text index with positions, published in generations.

Documents are dealt into segments of about SEGMENT by a hash of their key. A row of `postings` is a block: what one word has in one
segment, that is keys, lengths and positions of at most that many documents, however common the word is. Blocks lie in
folders by a hash of the word, sorted by word and segment, so a query opens the folders of its words alone. Beside its lists a
block has their number, the most occurrences and the least length. These bound what any document of the block can score, and
a search first reads the bounds, scores the most promising segments, and then only those that can still reach its top.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.postings import words
from quire.operators.search import K1, B, _ranked
from quire.sources.publications import Publication
from quire.sources.writers import Conflict

#: Documents of one segment, about.
SEGMENT = 1000
#: Segments that a task writes, about: each task has a file in each folder that its words go to.
TASK = 64
#: Segments that are scored before the bound of the others is known.
FIRST = 16
#: Segments whose numbers may stand in a filter; more are joined.
LISTED = 10_000
#: What words are; an index that was made with another rule is not read.
RULE = "lower-cased runs of letters and digits of 40 characters at most"


def build(at: Publication, docs: DataFrame, key: str, text: str, buckets: int = 64, expected: int | None = None) -> int:
    """Index all documents and publish. A null text has no words and counts as a document; keys are distinct. `expected` is
    the revision of the publication that the caller saw when reading the documents: if another holds now, nothing is published."""
    return _write(at, docs, key, text, buckets, 0, expected, False)


def add(at: Publication, docs: DataFrame, key: str, text: str) -> int:
    """Index documents that are new, as further parts with segments of their own."""
    known = _settings(at)
    return _write(at, docs, key, text, known["buckets"], known["segments"], at.current()["revision"], True)


def _write(at: Publication, docs: DataFrame, key: str, text: str, buckets: int, first: int, expected: int | None, append: bool) -> int:
    count = docs.count()
    segments = max(1, -(-count // SEGMENT))
    texts = docs.select(F.col(key).alias("key"), (F.pmod(F.xxhash64(key), F.lit(segments)) + first).cast("int").alias("segment"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = texts.schema["key"].dataType.simpleString()
    # texts are dealt, which are shorter than their postings; a segment's blocks are then made and written where it lies
    tasks = min(segments, max(2 * at.spark.sparkContext.defaultParallelism, -(-segments // TASK)))
    placed = texts.repartition(tasks, "segment").sortWithinPartitions("segment", "key").select("segment", "key", words(F.col("text")).alias("words"))
    blocks = placed.mapInArrow(_blocks, f"token string, segment int, docs int, most int, shortest int, keys array<{kind}>, lengths array<int>, tf array<int>, positions array<array<int>>")
    blocks = blocks.select(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("bucket"), "*")
    ordered = blocks.sortWithinPartitions("bucket", "token", "segment")
    sizes = texts.select("segment", F.size(words(F.col("text"))).alias("words")).groupBy("segment").agg(F.count("*").alias("docs"), F.sum("words").alias("words"))
    settings = at.spark.createDataFrame([(RULE, buckets, segments)], "rule string, buckets int, segments int").coalesce(1)
    lost = {"segments that miss documents": lambda tables: tables["segments"].agg(F.sum("docs").alias("n")).filter(F.lit(not append) & (F.coalesce("n", F.lit(0)) != count))}
    return at.publish({"postings": ordered, "segments": sizes, "settings": settings}, lost, {"postings": "bucket"}, expected=expected, append=append)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (segment, key, words), sorted by the first two, to the blocks of each segment. One segment is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        segments = batch.column("segment").to_numpy()
        cuts = np.flatnonzero(segments[1:] != segments[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if a == b:
                continue
            if held and held[-1].column("segment")[0].as_py() != segments[a]:
                yield from _blocks_of(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield from _blocks_of(held)


def _blocks_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each word of a segment: its documents in order, and in each the places where it stands."""
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    lengths = pc.list_value_length(rows.column("words")).to_numpy(zero_copy_only=False).astype(np.int32)
    coded = rows.column("words").flatten().dictionary_encode()
    if not len(coded):
        return
    word = coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    place = np.arange(len(word)) - np.repeat(np.cumsum(lengths, dtype=np.int64) - lengths, lengths)
    order = np.argsort(word, kind="stable")  # words stand by document and place already
    word, doc, place = word[order], doc[order], place[order].astype(np.int32)
    new = np.concatenate(([True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])))
    runs = np.flatnonzero(new)  # a word in a document
    tf = np.diff(np.append(runs, len(word))).astype(np.int32)
    word, doc = word[runs], doc[runs]
    starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    ends = np.append(starts[1:], len(word))
    key, length = rows.column("key").take(pa.array(doc)), lengths[doc]
    offsets = pa.array(np.append(starts, len(word)).astype(np.int32))
    lists = lambda values: pa.ListArray.from_arrays(offsets, values)
    places = pa.ListArray.from_arrays(pa.array(np.append(runs, len(place)).astype(np.int32)), pa.array(place))
    numbers = [np.full(len(starts), rows.column("segment")[0].as_py()), ends - starts, np.maximum.reduceat(tf, starts), np.minimum.reduceat(length, starts)]
    out = pa.record_batch(
        [coded.dictionary.take(pa.array(word[starts])), *[pa.array(n, pa.int32()) for n in numbers], lists(key), lists(pa.array(length)), lists(pa.array(tf)), lists(places)],
        names=["token", "segment", "docs", "most", "shortest", "keys", "lengths", "tf", "positions"],
    )
    yield from (out.slice(i, 2000) for i in range(0, out.num_rows, 2000))


def _settings(at: Publication) -> dict:
    rows = at.read("settings").collect()  # one row for each part of the publication
    if any(r.rule != RULE for r in rows):
        raise Conflict(f"the index at {at.path} has words by another rule: {rows[0].rule}")
    return {"buckets": rows[0].buckets, "segments": sum(r.segments for r in rows)}


class Reader:
    """The index as it was when the reader was made."""

    def __init__(self, at: Publication):
        self.settings = _settings(at)
        self.postings = at.read("postings")
        size = at.read("segments").agg(F.sum("docs"), F.sum("words")).first()
        self.docs, self.mean = size[0] or 0, (size[1] or 0) / size[0] if size[0] else 0.0

    def blocks(self, tokens: list[str]) -> DataFrame:
        """The blocks of some words. The folders to open follow from the words, before anything is read."""
        buckets = [F.pmod(F.xxhash64(F.lit(t)), F.lit(self.settings["buckets"])).cast("int") for t in tokens]
        return self.postings.filter(F.col("bucket").isin(buckets) & F.col("token").isin(tokens))

    def frequencies(self, tokens: list[str]) -> dict[str, int]:
        return {r.token: r.df for r in self.blocks(tokens).groupBy("token").agg(F.sum("docs").alias("df")).collect()}

    def _part(self, idf: Column, tf: Column, length: Column) -> Column:
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(self.mean or 1.0)))

    def _idf(self, df: dict[str, int]) -> Column:
        one = lambda n: F.log(F.lit(1 + (self.docs - n + 0.5) / (n + 0.5)))
        return F.element_at(F.create_map(*[x for t, n in df.items() for x in (F.lit(t), one(n))]), F.col("token"))

    def search(self, tokens: list[str], top: int) -> DataFrame:
        """The documents with the best BM25 of any of the words: (key, score, rank), ties by key."""
        tokens = list(dict.fromkeys(tokens))
        df = self.frequencies(tokens) if tokens else {}
        if not df:
            return self.postings.select(F.element_at("keys", 1).alias("key"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        idf = self._idf(df)
        bounds = self.blocks(tokens).groupBy("segment").agg(F.sum(self._part(idf, F.col("most"), F.col("shortest"))).alias("bound"))
        first = [r.segment for r in bounds.orderBy(F.desc("bound"), "segment").limit(FIRST).collect()]
        scores = [r.score for r in self._scored(self.blocks(tokens).filter(F.col("segment").isin(first)), idf).orderBy(F.desc("score")).limit(top).collect()]
        least = scores[-1] - 1e-6 if len(scores) == top else 0.0
        wanted = bounds.filter(F.col("bound") >= least).select("segment")
        listed = [r.segment for r in wanted.limit(LISTED + 1).collect()]
        blocks = self.blocks(tokens)
        blocks = blocks.filter(F.col("segment").isin(listed)) if len(listed) <= LISTED else blocks.join(wanted, "segment", "left_semi")
        return _top(self._scored(blocks, idf), top)

    def _scored(self, blocks: DataFrame, idf: Column) -> DataFrame:
        rows = blocks.select("token", F.explode(F.arrays_zip("keys", "tf", "lengths")).alias("x")).select("token", "x.*")
        return rows.groupBy(F.col("keys").alias("key")).agg(F.round(F.sum(self._part(idf, F.col("tf"), F.col("lengths"))), 6).alias("score"))

    def phrase(self, tokens: list[str]) -> DataFrame:
        """The documents in which the words stand one after another: (key, tf, length). Only segments that have them all
        are read with their positions."""
        distinct = list(dict.fromkeys(tokens))
        blocks = self.blocks(distinct)
        full = blocks.groupBy("segment").agg(F.count_distinct("token").alias("n")).filter(F.col("n") == len(distinct)).select("segment")
        listed = [r.segment for r in full.limit(LISTED + 1).collect()]
        blocks = blocks.filter(F.col("segment").isin(listed)) if len(listed) <= LISTED else blocks.join(full, "segment", "left_semi")
        rows = blocks.select("token", F.explode(F.arrays_zip("keys", "lengths", "positions")).alias("x")).select("token", "x.*")
        offsets = F.element_at(F.create_map(*[x for t in distinct for x in (F.lit(t), F.array(*[F.lit(i) for i, w in enumerate(tokens) if w == t]))]), F.col("token"))
        begins = rows.select("keys", "lengths", F.explode(F.flatten(F.transform(offsets, lambda o: F.transform("positions", lambda p: p - o)))).alias("begin"))
        whole = begins.groupBy("keys", "lengths", "begin").count().filter(F.col("count") == len(tokens))
        return whole.groupBy(F.col("keys").alias("key"), F.col("lengths").alias("length")).agg(F.count("*").alias("tf"))

    def phrase_search(self, tokens: list[str], top: int) -> DataFrame:
        """The best BM25 of a phrase as if it were one word: (key, score, rank)."""
        found = self.phrase(tokens)
        df = found.count()
        score = self._part(F.log(F.lit(1 + (self.docs - df + 0.5) / (df + 0.5))), F.col("tf"), F.col("length"))
        return _top(found.select("key", F.round(score, 6).alias("score")), top)


def _top(scored: DataFrame, top: int) -> DataFrame:
    return _ranked(scored.orderBy(F.desc("score"), "key").limit(top), F.desc("score"), F.col("key"))
