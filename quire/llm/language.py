"""Language identification by the nearest of several centroids per language.

A text becomes a normalised TF-IDF vector of hashed character n-grams. The labelled texts of each language are clustered
by cosine into a few centroids. A text gets the language of the centroid with the largest cosine; it is rejected
where that cosine is far below what labelled texts of about its length reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.workspace import materialize, slices

#: Buckets that n-grams are hashed into.
BUCKETS = 1 << 12
#: Lengths of n-grams, in characters.
ORDERS = (1, 2, 3)
CENTROIDS = 4
#: Labelled texts of each language that the classifier is fitted on, at most; chosen by a hash.
PER_LABEL = 1000
#: Languages at most; the model on each executor has CENTROIDS * BUCKETS * 4 bytes for each.
MAX_LABELS = 500
#: A text is rejected below this part of the least cosine that labelled texts of its length have.
REJECT_BELOW = 0.6
UNDETERMINED = "und"
#: Characters that are made into n-grams at once.
PIECE = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for m in regex.finditer(r"[\p{L}\p{M}]+", "".join(map(chr, range(0x110000)))):
        table[m.start() : m.end()] = True
    return table


def has_letter(column: str) -> Column:
    return F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False))


def ngram_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the lower-cased text, whose runs of other than letters are one blank."""
    out = np.zeros(BUCKETS, np.int64)
    low = text.lower()
    for at in range(0, len(low), PIECE):
        piece = low[max(0, at - max(ORDERS) + 1) : at + PIECE] if at else low[:PIECE]
        cps = np.frombuffer(f" {piece} ".encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[cps]
        keep = letter | np.concatenate(([True], letter[:-1]))
        c = np.where(letter, cps, 32)[keep].astype(np.uint64)
        with np.errstate(over="ignore"):
            h = np.zeros(len(c), np.uint64)
            for n in range(1, max(ORDERS) + 1):
                if len(c) < n:
                    break
                h = (h[: len(c) - n + 1] + c[n - 1 :]) * _STEP
                h ^= h >> np.uint64(31)
                if n in ORDERS:
                    out += np.bincount((h >> np.uint64(40)) % np.uint64(BUCKETS), minlength=BUCKETS)
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (np.log1p(counts) * idf).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)


def _length_class(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts.sum(-1), 1))).astype(int)


class Centroids:
    """labels, the centroids and their labels, idf, and for each class of lengths the least cosine accepted."""

    def __init__(self, labels: list[str], centroids: np.ndarray, of: np.ndarray, idf: np.ndarray, least: np.ndarray):
        self.labels, self.centroids, self.of, self.idf, self.least = labels, centroids, of, idf, least

    def __len__(self) -> int:
        return len(self.labels)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        counts = np.stack([ngram_counts(t) for t in texts])
        cosine = _weighted(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        score = cosine[np.arange(len(texts)), best]
        rejected = score < self.least[np.minimum(_length_class(counts), len(self.least) - 1)]
        return [(self.labels[self.of[b]], float(min(max(s, 0.0), 1.0)), bool(r)) for b, s, r in zip(best, score, rejected)]


def fit(df: DataFrame, text: str, label: str, sample_key: list[str]) -> Centroids | None:
    """Learn from rows with a label and a letter in their text; sample_key are columns whose hash chooses the sample of
    PER_LABEL rows per label. None where there are no such rows."""
    rows = df.filter(F.col(label).isNotNull() & has_letter(text)).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.xxhash64(*sample_key).alias("key"))
    totals = rows.groupBy("label").count().limit(MAX_LABELS + 1).collect()
    if not totals:
        return None
    if len(totals) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} languages")
    rates = df.sparkSession.createDataFrame([(r["label"], min(1.0, 2.0 * PER_LABEL / r["count"])) for r in totals], "label string, rate double")
    likely = rows.join(F.broadcast(rates), "label").filter(F.pmod("key", F.lit(1 << 20)) < F.col("rate") * (1 << 20))
    first = Window.partitionBy("label").orderBy("key", "text")
    sample = likely.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= PER_LABEL).select("label", "key", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts = [ngram_counts(t) for t in batch.column("text").to_pylist()]
            at = [np.flatnonzero(c) for c in counts]
            columns = [batch.column("label"), batch.column("key"), pa.array([a.astype("<i4").tobytes() for a in at]), pa.array([c[a].astype("<i4").tobytes() for a, c in zip(at, counts)])]
            yield pa.record_batch(columns, names=["label", "key", "at", "n"])

    vectors = materialize(sample.mapInArrow(count, "label string, key long, at binary, n binary"), "ngrams")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for a in batch.column(0).to_pylist():
                df[np.frombuffer(a, "<i4")] += 1
            df[BUCKETS] += batch.num_rows
        yield pa.record_batch([pa.array(np.arange(BUCKETS + 1)), pa.array(df)], names=["bucket", "df"])

    found = vectors.select("at").mapInArrow(present, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).orderBy("bucket")
    df_all = np.array([r.df for r in found.collect()])
    idf = np.log((1 + df_all[-1]) / (1 + df_all[:-1])) + 1

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        x = _weighted(_dense(rows["at"], rows["n"]), idf)
        centers = _spherical_kmeans(x, CENTROIDS)
        return pd.DataFrame({"label": rows["label"].iloc[0], "centroid": [c.astype("<f4").tobytes() for c in centers]})

    centers = vectors.groupBy("label").applyInPandas(cluster, "label string, centroid binary").orderBy("label", "centroid").collect()
    labels = sorted({r.label for r in centers})
    centroids = np.stack([np.frombuffer(r.centroid, "<f4") for r in centers])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                counts = _dense(some.column(0).to_pylist(), some.column(1).to_pylist())
                yield pa.record_batch([pa.array(_length_class(counts)), pa.array((_weighted(counts, idf) @ centroids.T).max(1).astype(float))], names=["length", "cosine"])

    low = vectors.select("at", "n").mapInArrow(nearest, "length long, cosine double").groupBy("length").agg(F.min("cosine").alias("low")).collect()
    least = np.full(64, np.inf)
    for r in low:
        least[r.length] = r.low * REJECT_BELOW
    least = np.minimum.accumulate(least[::-1])[::-1]  # a longer text is not accepted less easily than a shorter one is
    known = np.isfinite(least)
    least[~known] = least[known][-1]
    return Centroids(labels, centroids, np.array([labels.index(r.label) for r in centers]), idf, least)


def _dense(at, n) -> np.ndarray:
    out = np.zeros((len(at), BUCKETS), np.int32)
    for row, a, k in zip(out, at, n):
        row[np.frombuffer(a, "<i4")] = np.frombuffer(k, "<i4")
    return out


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k unit centroids; each new one starts at the vector farthest from those before."""
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    centers = x[chosen]
    for _ in range(rounds):
        of = (x @ centers.T).argmax(1)
        sums = np.stack([x[of == c].sum(0) if (of == c).any() else centers[c] for c in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers


def identify(df: DataFrame, model: Centroids | None, text: str = "text") -> DataFrame:
    """Add lang_pred, score and rejected to every row, in place of columns of these names.

    A null text, or one without a letter, is `und`, with score 0, and rejected; so is all where nothing was learned. A text
    of any length is read whole.
    """
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "rejected")]
    if model is None:
        return df.select(*kept, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for part in slices([pa.record_batch([texts], names=["text"])], "text", 1 << 20):
                for i in range(0, part.num_rows, 256):
                    given = part.column(0).slice(i, 256).to_pylist()
                    some = [(j, t) for j, t in enumerate(given) if t is not None]
                    found = [(UNDETERMINED, 0.0, True)] * len(given)
                    for (j, _), p in zip(some, shared.value.predict([t for _, t in some]) if some else []):
                        found[j] = p
                    out += found
            yield pa.StructArray.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))], ["lang_pred", "score", "rejected"])

    found = df.select(*kept, F.when(has_letter(text), F.col(text)).alias("__text")).withColumn("__p", predict("__text"))
    return found.select(*kept, "__p.lang_pred", "__p.score", "__p.rejected")


def held_out(id_col: str) -> Column:
    """Whether a row is kept from learning: the CRC-32 of its id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0
