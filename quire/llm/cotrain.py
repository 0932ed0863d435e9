"""A quality classifier by co-training on two views of a document.

One classifier sees the text, the other its metadata. Each round, each of them scores all unlabelled documents and labels
those it is most sure of for the other. In the end both are calibrated on labelled rows that no round has used, and every document is
scored by the sum of their calibrated log-odds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.workspace import gathered, materialize, slices

#: Labelled rows that the classifiers are fitted on, at most; chosen by a hash.
MAX_LABELLED = 20_000
ROUNDS = 5
#: Pseudo-labels of each class that a classifier gives in a round, as a part of the labelled rows, and the least confidence.
SHARE = 0.05
CONFIDENT = 0.9
#: Held-out log loss that a round may cost a view.
TOLERANCE = 1e-3
#: Documents with a smaller score are not kept.
KEEP_FROM = 0.5
#: Buckets for the words of a text, and for values of the metadata.
WORD_BUCKETS, VALUE_BUCKETS = 256, 32
NUMBER_STEPS = 48
TEXT_FEATURES = 12 + WORD_BUCKETS
#: Rows that a fit holds as 64-bit numbers at a time.
BLOCK = 1024
_SIGNS = "#*$%&|<>"


def text_features(text: str | None) -> np.ndarray:
    """Shares of kinds of characters, words and lines, and hashed words in logarithm and norm 1."""
    text = text or ""
    out = np.zeros(TEXT_FEATURES, np.float32)
    words = text.split()
    if not words:
        return out
    n, chars = len(words), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    stems = [w.strip(_SIGNS + ".,;:!?\"'") for w in words]
    out[:12] = (
        np.log1p(n) / 10,
        sum(map(text.count, _SIGNS)) / n,
        (text.count("!") + text.count("?")) / n,
        sum(w.isupper() for w in words) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(set(stems)) / n,
        len("".join(words)) / n / 10,
        sum(map(text.count, "0123456789")) / chars * 10,
        sum(x.rstrip()[-1] in ".!?\"'”’»)" for x in lines) / len(lines),
        1 - len(set(lines)) / len(lines),
        words.count("|") / n,
        sum(not s for s in stems) / n,
    )
    counts = np.zeros(WORD_BUCKETS)
    for s in stems:
        counts[xxhash.xxh3_64_intdigest(s.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS] += 1
    counts = np.log1p(counts)
    out[12:] = counts / max(1e-9, np.sqrt((counts * counts).sum()))
    return out


def _hashed(values: list, salt: str) -> np.ndarray:
    out = np.zeros((len(values), VALUE_BUCKETS), np.float32)
    out[np.arange(len(values)), [xxhash.xxh3_64_intdigest(f"{salt}={v}".encode("utf-8", "surrogatepass")) % VALUE_BUCKETS for v in values]] = 1
    return out


def _stepped(x: np.ndarray) -> np.ndarray:
    """One column for each half of an octave, so that a view can tell the middle of a range from both ends."""
    out = np.zeros((len(x), NUMBER_STEPS), np.float32)
    out[np.arange(len(x)), np.minimum(2 * np.log2(1 + np.abs(x)), NUMBER_STEPS - 1).astype(int)] = 1
    return out


def metadata_features(columns: dict[str, pa.Array], texts: list) -> np.ndarray:
    """Numbers in steps, and whether they are missing; all else by hash, alone and with the value before it; and of the page's
    layout, not its words, the steps of its lines for each 10 000 characters, of the mean line and of bytes for 1000 characters."""
    parts, before = [], None
    for name, column in columns.items():
        values = column.to_pylist()
        if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
            x = np.array([0.0 if v is None else float(v) for v in values])
            parts += [_stepped(x), np.array([[float(v is None)] for v in values], np.float32)]
        else:
            parts.append(_hashed(values, name))
            if before is not None:
                parts.append(_hashed(list(zip(before, values)), f"{name} with"))
            before = values
    shape = np.array([(len(t), t.count("\n") + 1, len(t.encode("utf-8", "surrogatepass"))) for t in (t or "" for t in texts)], np.float64).reshape(-1, 3)
    chars = np.maximum(shape[:, 0], 1)
    parts += [_stepped(shape[:, 1] / chars * 10_000), _stepped(chars / shape[:, 1]), _stepped(np.maximum(shape[:, 2] / chars - 1, 0) * 1000)]
    return np.concatenate(parts, 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a penalised logistic regression, by Newton's method; the last is the constant. Sums are taken over blocks of
    rows, so that beside x little is held."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        gradient, curve = ridge * w, np.diag(ridge)
        for at in range(0, len(x), BLOCK):
            rows = np.concatenate((x[at : at + BLOCK].astype(np.float64), np.ones((len(x[at : at + BLOCK]), 1))), 1)
            p, u = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30))), weight[at : at + BLOCK]
            gradient += rows.T @ (u * (p - y[at : at + BLOCK]))
            curve += (rows * (u * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ rows
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) @ w[:-1] + w[-1]


class Views:
    """Weights of both views with their calibration (a factor and a constant each), and the log-odds of the classes. `rounds`
    tells of each round how many labels of 0 and 1 each view got from the other, the part of held-out rows that the view that
    gave them is right about where it is as sure, the held-out loss after it, and whether it was accepted."""

    def __init__(self, text: np.ndarray, metadata: np.ndarray, calibrated: list[tuple[float, float]], prior: float, rounds: list[dict] | None = None):
        self.text, self.metadata, self.calibrated, self.prior, self.rounds = text, metadata, calibrated, prior, rounds or []

    def score(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Columns: the score of both views, of the text, of the metadata."""
        (a, b), (c, d) = self.calibrated
        text, metadata = a * _odds(x, self.text) + b, c * _odds(m, self.metadata) + d
        both = text + metadata - self.prior
        return 1 / (1 + np.exp(-np.clip(np.stack((both, text, metadata), 1), -30, 30)))


def _sureness(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """How sure a view is of label 1."""
    return 1 / (1 + np.exp(-np.clip(_odds(x, w), -30, 30)))


#: From the weights of each view, and how many rows to take of labels 0 and 1, to the rows that each view got labels for
#: from the other: their features in it, and the labels. A row is given to a view once.
Choose = Callable[[dict[str, np.ndarray], tuple[int, int]], dict[str, tuple[np.ndarray, np.ndarray]]]
_OTHER = {"x": "m", "m": "x"}


def choose_from(pool: dict[str, np.ndarray]) -> Choose:
    """The choice from a pool in memory."""
    free = {v: np.ones(len(pool[v]), bool) for v in pool}

    def choose(weights: dict[str, np.ndarray], most: tuple[int, int]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for view, other in _OTHER.items():
            p = _sureness(pool[view], weights[view])
            rows = []
            for sure, n in zip((1 - p, p), most):
                best = np.argsort(-np.where(free[other], sure, -1), kind="stable")[:n]
                rows.append(best[free[other][best] & (sure[best] >= CONFIDENT)])
            free[other][np.concatenate(rows)] = False
            out[other] = pool[other][np.concatenate(rows)], np.repeat((0.0, 1.0), [len(r) for r in rows])
        return out

    return choose


def co_train(x: np.ndarray, m: np.ndarray, y: np.ndarray, pool_x: np.ndarray, pool_m: np.ndarray, rounds: int = ROUNDS) -> Views:
    """Labelled rows (views x, m and labels y) and a pool without labels to a classifier of both views."""
    return co_train_by(x, m, y, choose_from({"x": pool_x, "m": pool_m}), rounds if len(pool_x) else 0)


def co_train_by(x: np.ndarray, m: np.ndarray, y: np.ndarray, choose: Choose, rounds: int = ROUNDS) -> Views:
    """Labelled rows (views x, m and labels y), and a choice from a pool without labels, to a classifier of both views.
    Every fifth labelled row is for calibration alone."""
    hold = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    seen = {"x": x[~hold], "m": m[~hold]}
    base = y[~hold]
    pseudo = {v: (seen[v][:0], base[:0]) for v in seen}
    most = tuple(max(1, int(SHARE * (base == label).sum())) for label in (0.0, 1.0))

    def fitted(view: str) -> np.ndarray:
        rows, labels = pseudo[view]
        return fit_logistic(np.concatenate((seen[view], rows)), np.concatenate((base, labels)), np.concatenate((np.ones(len(base)), np.full(len(labels), 0.5))))

    test = hold if hold.any() else np.ones(len(y), bool)
    full = {"x": x, "m": m}
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    prior = float(np.log(rate / (1 - rate)))

    def calibrated(weights: dict[str, np.ndarray]) -> list[tuple[float, float]]:
        lines = [fit_logistic(_odds(full[v][test], weights[v])[:, None], y[test], np.ones(test.sum()), penalty=1e-2) for v in ("x", "m")]
        return [(max(0.0, float(line[0])), float(line[1])) for line in lines]

    weights, report = {v: fitted(v) for v in seen}, []
    best = _losses(weights, full, y, test)
    for _ in range(rounds):
        before = pseudo
        got = choose(weights, most)
        pseudo = {v: (np.concatenate((pseudo[v][0], got[v][0])), np.concatenate((pseudo[v][1], got[v][1]))) if v in got else pseudo[v] for v in pseudo}
        new = {v: fitted(v) for v in seen}
        loss = _losses(new, full, y, test)
        # a view keeps what it was given unless that makes it worse on rows that nothing was fitted on
        kept = {v: v in got and loss[v] <= best[v] + TOLERANCE for v in seen}
        right = {v: _right(_sureness(full[v][test], weights[v]), y[test]) for v in seen}
        report.append({v: {"given": [int((got[v][1] == c).sum()) if v in got else 0 for c in (0, 1)], "giver_right": right[_OTHER[v]], "loss": loss[v], "accepted": kept[v]} for v in seen})
        pseudo = {v: pseudo[v] if kept[v] else before[v] for v in pseudo}
        weights = {v: new[v] if kept[v] else weights[v] for v in seen}
        best = {v: min(best[v], loss[v]) if kept[v] else best[v] for v in seen}
    return Views(weights["x"], weights["m"], calibrated(weights), prior, report)


def _losses(weights: dict[str, np.ndarray], full: dict[str, np.ndarray], y: np.ndarray, test: np.ndarray) -> dict[str, float]:
    """The mean log loss of each view on the rows of `test`."""
    odds = {v: np.clip(_odds(full[v][test], w), -30, 30) for v, w in weights.items()}
    return {v: float(np.logaddexp(0, np.where(y[test] > 0, -o, o)).mean()) for v, o in odds.items()}


def _right(p: np.ndarray, y: np.ndarray) -> float | None:
    """The part of rows that are told rightly among those that are told with confidence; None without any."""
    sure = np.maximum(p, 1 - p) >= CONFIDENT
    return float(((p > 0.5) == (y > 0.5))[sure].mean()) if sure.any() else None


def _features(df: DataFrame, text: str, metadata: tuple[str, ...], carried: str) -> DataFrame:
    """(carried columns, x, m) with the features of both views packed as 32-bit floats."""
    names = [c.split()[0] for c in carried.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            x = [text_features(t).tobytes() for t in batch.column("__text").to_pylist()]
            m = metadata_features({c: batch.column(c) for c in metadata}, batch.column("__text").to_pylist())
            rest = [batch.column(c) for c in names]
            yield pa.record_batch([*rest, pa.array(x), pa.array([r.astype("<f4").tobytes() for r in m])], names=[*names, "x", "m"])

    return df.mapInArrow(run, f"{carried}, x binary, m binary")


def _best(weights: dict[str, np.ndarray], taken: dict[str, np.ndarray], most: tuple[int, int]):
    """A function for mapInArrow over rows (key, row, x, m) to (other, label, sure, key, row): those of a task that each
    view is most sure of and that the other has not got."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {(v, label): np.zeros(0, [("sure", "f8"), ("key", "i8"), ("row", "i8")]) for v in _OTHER for label in (0, 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            key, row = batch.column("key").to_numpy(), batch.column("row").to_numpy()
            for view, other in _OTHER.items():
                p = _sureness(_matrix(batch.column(view).to_pylist()), weights[view])
                free = ~np.isin(row, taken[other])
                for label, sure in ((0, 1 - p), (1, p)):
                    at = np.flatnonzero(free & (sure >= CONFIDENT))
                    new = np.empty(len(at), best[view, label].dtype)
                    new["sure"], new["key"], new["row"] = sure[at], key[at], row[at]
                    both = np.concatenate((best[view, label], new))
                    best[view, label] = both[np.lexsort((both["row"], both["key"], -both["sure"]))[: most[label]]]
        for (view, label), rows in best.items():
            given = [pa.array([_OTHER[view]] * len(rows), pa.string()), pa.array(np.full(len(rows), label, np.int32))]
            yield pa.record_batch([*given, *[pa.array(np.ascontiguousarray(rows[c])) for c in ("sure", "key", "row")]], names=["other", "label", "sure", "key", "row"])

    return run


def choose_by_spark(pool: DataFrame) -> Choose:
    """The choice from all rows (key, row, x, m) of a table, of which `row` tells apart rows and `key` decides between rows
    of which a view is equally sure. Only what is chosen comes to the driver."""
    taken = {v: np.zeros(0, np.int64) for v in _OTHER}

    def choose(weights: dict[str, np.ndarray], most: tuple[int, int]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        found = pool.mapInArrow(_best(weights, taken, most), "other string, label int, sure double, key long, row long")
        rank = F.row_number().over(Window.partitionBy("other", "label").orderBy(F.desc("sure"), "key", "row"))
        found = found.withColumn("__rank", rank).filter(F.col("__rank") <= max(most)).filter(F.col("__rank") <= F.when(F.col("label") == 1, most[1]).otherwise(most[0]))
        chosen = materialize(gathered(found.select("other", "label", "key", "row")), "chosen")
        features = F.when(F.col("other") == "x", F.col("x")).otherwise(F.col("m")).alias("features")
        got = pool.drop("key").join(F.broadcast(chosen), "row").select("other", "label", "key", "row", features).collect()
        got.sort(key=lambda r: (r.label, r.key, r.row))
        out = {}
        for v in _OTHER:
            of = [r for r in got if r.other == v]
            if of:
                taken[v] = np.concatenate((taken[v], [r.row for r in of]))
                out[v] = _matrix([r.features for r in of]), np.array([float(r.label) for r in of])
        return out

    return choose


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), -1)


def _brought(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows (label, x, m) of a bounded table as arrays in the order of a hash, brought to the driver a partition at a
    time: only the arrays are ever held whole."""
    parts, keys, rows = [], [], labelled.toLocalIterator()
    while some := list(islice(rows, BLOCK)):
        parts.append((_matrix([r.x for r in some]), _matrix([r.m for r in some]), np.array([r.label for r in some])))
        keys += [xxhash.xxh3_64_intdigest(r.x + r.m) for r in some]
    if not parts:
        return np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0)
    order = np.argsort(np.array(keys, np.uint64), kind="stable")
    out = []
    for i in range(3):
        out.append(np.concatenate([part[i] for part in parts])[order])
        parts = [part[:i] + (None,) + part[i + 1 :] for part in parts]
    return tuple(out)


def _sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """At most `most` rows, those with the smallest hash; the same ones each time."""
    n = df.count()
    if n > 2 * most:
        df = df.filter(F.pmod(key, F.lit(1 << 30)) < int((1 << 30) * 2.0 * most / n))
    return df.orderBy(key).limit(most)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", text: str = "text", metadata: tuple[str, ...] = ("source", "lang", "n_chars")) -> Views | None:
    """Fit on the rows of df that `labels` (id_col, label of 0 or 1) names, and on all others as the pool. None where there are
    not both classes. Rows without a label value are no labelled rows; of several labels of an id the smallest counts, of
    several rows of a labelled id the one whose text has the smallest hash, so MAX_LABELLED bounds rows."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).cast("double").alias("label"))
    rows = df.select(id_col, F.col(text).alias("__text"), *metadata, F.xxhash64(F.col(id_col), F.lit("quality")).alias("__order"))
    chosen = _sample(known.withColumn("__order", F.xxhash64(F.col(id_col), F.lit("quality"))), F.col("__order"), MAX_LABELLED).select(id_col, "label")
    labelled = rows.join(F.broadcast(chosen), id_col)
    one = F.min_by(F.struct("__text", *metadata, "label"), F.struct(F.xxhash64("__text"), F.xxhash64(*metadata))).alias("one")
    labelled = labelled.groupBy(id_col).agg(one).select("one.*")
    x, m, y = _brought(materialize(_features(gathered(labelled), text, metadata, "label double"), "labelled"))
    if not len(y) or y.min() == y.max():
        return None
    pool = rows.join(F.broadcast(chosen.select(id_col)), id_col, "left_anti").withColumns({"key": F.col("__order"), "row": F.monotonically_increasing_id()})
    pool = materialize(_features(pool.select("__text", *metadata, "key", "row"), text, metadata, "key long, row long"), "pool")
    return co_train_by(x, m, y, choose_by_spark(pool))


def score(df: DataFrame, model: Views | None, text: str = "text", metadata: tuple[str, ...] = ("source", "lang", "n_chars")) -> DataFrame:
    """Add score, score_text, score_metadata (0 to 1) and kept to every row, in place of columns of these names.

    Without a model every score is null and every row kept. A null text counts as empty, null metadata as a value of
    its own; whole texts are read, whatever their length.
    """
    new = ("score", "score_text", "score_metadata", "kept")
    columns = [c for c in df.columns if c not in new]
    if model is None:
        return df.select(*columns, *[F.lit(None).cast("double").alias(c) for c in new[:3]], F.lit(True).alias("kept"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,score_text:double,score_metadata:double>")
    def scored(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for given in batches:
            out = []
            for part in slices([pa.record_batch(list(given), names=["__text", *metadata])], "__text"):
                x = np.stack([text_features(t) for t in part.column(0).to_pylist()])
                m = metadata_features({c: part.column(c) for c in metadata}, part.column(0).to_pylist())
                out.append(shared.value.score(x, m))
            found = np.concatenate(out) if out else np.zeros((0, 3))
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(3)], list(new[:3]))

    found = df.select(*columns, scored(text, *metadata).alias("__s"))
    return found.select(*columns, *[f"__s.{c}" for c in new[:3]], (F.col("__s.score") >= KEEP_FROM).alias("kept"))
