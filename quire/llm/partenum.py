"""N-gram Jaccard self-join of whole texts by PartEnum signatures.

A text's set has its distinct shingles. Two sets of sizes s <= b that reach the threshold t differ in at most
k(s) = floor((1 - t) * floor(s / t)) features, and b <= s / t. Sizes fall into bands; for each band the feature domain is
cut into partitions by a hash, and a set's signature for a partition is a hash of its features there. One feature that
differs spoils one partition, so of any k + 1 partitions that are not empty in the smaller set, one at least is the
same in both sets: each set takes its first k + 1 + slack partitions that have features, in one order for all, which is
the enumeration of PartEnum with single partitions as subsets. A set also takes part in the next band if a set that
it may match lies there.

The slack is what makes frequent passages harmless. Two sets that match share at least 1 + slack signatures, by the
slack of the smaller. A signature that many sets have is *crowded*; a set with at most as many crowded signatures as the
slack of the smallest set that it may match shares an uncrowded one with all it matches, so its crowded ones need no look.
Sets with more are those that consist of shared text, near copies above all. They are held against one pivot for each
crowded signature; the crowds that this leaves in several components are signed anew by single shingles, without those
that many of the crowds' sets have. What shares no rare shingle and can link all the same has few rare ones: such sets
are held against pivots until each was one, and only pairs whose numbers of rare and frequent shingles and sketches (the
parity of 512 cells) allow a link leave the join, in the first of the signatures that they share, and in few of the others.

A candidate pair first has its *prints* compared: a set's features fall into about as many cells as it has features, and
the print has four bits of a sum for each cell. A cell that differs holds a feature that differs, so a pair with more such
cells than its sizes allow cannot link; that is exact, and spares the texts of most pairs that only share a passage.
Every link that decides is verified on whole sets, with exact integer arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.workspace import BROADCAST_ROWS, discard, gathered, lookup, materialize, schema_with, slices, small_enough, with_columns

WORDS = 5
PERCENT = 80
#: Sets that share an uncrowded signature at most.
CROWD = 8
#: Words and sets that a worker remembers; then it forgets all.
REMEMBERED = 60_000
#: Of sets in divided crowds, those that share a rare shingle at most.
RARE = 16
SKETCH = [f"s{i}" for i in range(8)]
HOT_SHARE = 1000
#: Signatures of a set before one of them, in which pairs are looked for that have met.
BEFORE = 16
#: Sets that one task compares with a pivot, about.
MEMBERS = 500
#: Pairs, or rows of some 300 bytes, that may be broadcast.
FEW_PAIRS = 20_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: dict, n: int = WORDS) -> np.ndarray:
    """The sorted hashes of a text's distinct n-word shingles; of all its words as one where it has fewer."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    many = min(n, len(h))
    out = np.full(len(h) - many + 1, many, np.uint64)
    for i in range(many):
        out = (out + h[i : i + len(out)]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
    out = np.sort(mix(out))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def class_of(features: np.ndarray) -> int:
    """One number for equal sets, as a signed 64-bit integer."""
    return xxhash.xxh3_64_intdigest(features.tobytes()) - (1 << 63)


def print_of(features: np.ndarray) -> bytes:
    """For each of 2 ** k cells, k from 3, the sum of what its features give to it, modulo 16; two cells to a byte."""
    bits = max(3, len(features).bit_length() - 1)
    cells = np.bincount((features & _U((1 << bits) - 1)).astype(np.int64), (features >> _U(40)) % _U(15) + _U(1), 1 << bits).astype(np.int64)
    return ((cells[::2] & 15) | (cells[1::2] & 15) << 4).astype(np.uint8).tobytes()


def sketch_of(features: np.ndarray) -> np.ndarray:
    """Eight 64-bit integers: whether each of 512 cells has an odd number of features. Cells that differ hold a feature
    that differs."""
    odd = np.bincount(((features >> _U(20)) & _U(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def cells_apart(x: bytes, y: bytes) -> int:
    """Cells in which two prints differ, after the longer one is folded to the length of the other."""
    a, b = (np.frombuffer(p, np.uint8) for p in ((x, y) if len(x) <= len(y) else (y, x)))
    low, high = b & 15, b >> 4
    while len(low) > len(a):
        half = len(low) // 2
        low, high = low[:half] + low[half:], high[:half] + high[half:]
    return int(((low & 15) != (a & 15)).sum() + ((high & 15) != (a >> 4)).sum())


def most_differences(size: int, percent: int = PERCENT) -> int:
    """Features in one but not both of two sets that link, of which the smaller has `size`."""
    return size * 100 // percent * (100 - percent) // 100


def slack(size: int) -> int:
    return 2 + size // 25


def bands(percent: int = PERCENT) -> list[int]:
    """Where the bands of sizes begin: at the least size that can link with a different set, then half more each time."""
    first = next(s for s in range(1, 1000) if most_differences(s, percent))
    out = [first]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 3 // 2 + 1)
    return out


def signatures(features: np.ndarray, begins: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """A set's signatures in its own band and, if a set it may link with can lie there, in the next."""
    size = len(features)
    band = int(np.searchsorted(begins, size, "right")) - 1
    if band < 0:
        return np.zeros(0, np.uint64)
    need = min(size, most_differences(size, percent) + 1 + slack(size))
    reach = size * 100 // percent
    out = []
    for b in (band, band + 1)[: 1 + (reach >= begins[band + 1])]:
        out += _in_band(features, b, int(begins[b]), need, percent)
    return np.concatenate(out)


def _in_band(features: np.ndarray, band: int, least: int, need: int, percent: int) -> list[np.ndarray]:
    """Level by level: coarse partitions, finer ones, single features; a set that has too few partitions with features
    on one level gives them all and goes on to the next, so a pair shares signatures on a level that suffices for one."""
    out = []
    share = 1.5 * (100 - percent) / percent + 0.105
    for level, parts in enumerate((int(share * least) + 4, 2 * least, 0)):
        if parts and least < 16:
            continue
        salt = _U((band * 8 + level + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1)
        h = mix(features ^ salt)
        if parts:
            of = h % _U(parts)
            of = of.astype(np.uint16) if parts <= 1 << 16 else of  # sorted by digits
            order = np.argsort(of, kind="stable")
            of, h = of[order], mix(h[order] + salt)
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            found = mix(np.add.reduceat(h, first) + of[first].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + salt)
        else:
            found = np.sort(h)
        out.append(found[:need])
        if len(found) >= need:
            break
    return out


def _sets(n: int, make):
    """A function for mapInArrow that gives (the first column's value, features) of each text to `make`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        with np.errstate(over="ignore"):
            yield from make((i, shingles(t, words, n)) for batch in slices(batches, "text") for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))

    return run


def document_classes(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """Rows (id, place, text) to (id, place, class, n_shingles, print, s0 ... s7); class and print are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text"):
                found = [shingles(t, words, n) for t in batch.column("text").to_pylist()]
                new = {
                    "class": pa.array([class_of(x) if len(x) else None for x in found], pa.int64()),
                    "n_shingles": pa.array([len(x) for x in found], pa.int64()),
                    "print": pa.array([print_of(x) if len(x) else None for x in found], pa.binary()),
                }
                sketches = np.array([sketch_of(x) for x in found])
                new |= {s: pa.array(np.ascontiguousarray(sketches[:, i])) for i, s in enumerate(SKETCH)}
                yield with_columns(batch.drop_columns(["text"]), new)

    return docs.mapInArrow(run, schema_with(docs.drop("text"), {"class": "long", "n_shingles": "long", "print": "binary"} | dict.fromkeys(SKETCH, "long")))


def signature_rows(rows: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows (id, text) to (sig, class); equal sets of one task are taken once."""
    begins = np.array(bands(percent))

    def make(sets) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        sigs, classes, held = [], [], 0
        for _, x in sets:
            c = class_of(x) if len(x) else None
            if c is None or c in done:
                continue
            if len(done) >= REMEMBERED:
                done.clear()
            done.add(c)
            s = signatures(x, begins, percent)
            sigs.append(s)
            classes.append(np.full(len(s), c, np.int64))
            held += len(s)
            if held >= 100_000:
                yield _pair_batch(np.concatenate(sigs).view(np.int64), np.concatenate(classes), "sig", "class")
                sigs, classes, held = [], [], 0
        if held:
            yield _pair_batch(np.concatenate(sigs).view(np.int64), np.concatenate(classes), "sig", "class")

    return rows.mapInArrow(_sets(n, make), "sig long, class long")


def _pair_batch(x: np.ndarray, y: np.ndarray, *names: str) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x), pa.array(y)], names=list(names))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, class) in the order of both to candidates: (false, a, b) for sets that share an uncrowded signature,
    (true, sig, class) for the members of a crowded one. Of a group no more than CROWD members are ever held."""
    sig, cls, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def close(sig: np.ndarray, cls: np.ndarray, last: bool):
        nonlocal crowded
        fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1]))) if len(sig) else np.zeros(0, bool)
        sig, cls = sig[fresh], cls[fresh]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(sig)))
        big = size > CROWD
        if len(sig) and crowded is not None and sig[0] == crowded:
            big[0] = True
        keep = 0
        whole = np.ones(len(size), bool)
        if not last and len(size) and not big[-1]:
            keep, whole[-1] = int(size[-1]), False
        if len(size) and big[-1]:
            crowded = sig[-1]
        rows = np.repeat(big & whole, size)
        pairs = []
        for g in range(2, CROWD + 1):
            at = first[(size == g) & whole & ~big]
            if len(at):
                members = cls[at[:, None] + np.arange(g)]
                i, j = np.triu_indices(g, 1)
                pairs.append(np.stack((members[:, i].ravel(), members[:, j].ravel()), 1))
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        kinds = np.concatenate((np.zeros(len(pairs), bool), np.ones(int(rows.sum()), bool)))
        out = pa.record_batch([pa.array(kinds), pa.array(np.concatenate((pairs[:, 0], sig[rows]))), pa.array(np.concatenate((pairs[:, 1], cls[rows])))], names=["crowded", "x", "y"])
        return out, sig[len(sig) - keep :], cls[len(cls) - keep :]

    for batch in batches:
        sig = np.concatenate((sig, batch.column(0).to_numpy()))
        cls = np.concatenate((cls, batch.column(1).to_numpy()))
        if len(sig) >= 100_000:
            out, sig, cls = close(sig, cls, False)
            yield out
    yield close(sig, cls, True)[0]


def _few(df: DataFrame) -> DataFrame:
    """A stored table of narrow rows, to be broadcast if it is small."""
    return F.broadcast(df) if small_enough(df) else df


def _texts_of(docs: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """The texts, (class, text), of classes given as (class, id, place); `few` if these may be broadcast."""
    wanted = wanted.select("class", F.col("id").alias("__id"), F.col("place").alias("__place"))
    if few:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, (F.col("place") == F.col("__place")) & F.col("id").eqNullSafe(F.col("__id"))).select("class", "text")


def _compare(percent: int, n: int):
    """A function for mapInArrow over rows (pivot, part, class, text) in that order, a pivot's own row first: the links
    (a, b) of each pivot with its members. One set is held beside the one it is compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pivot, features = _Words(), None, np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text"):
                a, b = [], []
                for p, c, text in zip(*(batch.column(x).to_pylist() for x in ("pivot", "class", "text"))):
                    found = shingles(text, words, n)
                    if c == p:
                        pivot, features = p, found
                    elif p == pivot and _link(features, found, percent):
                        a.append(p)
                        b.append(c)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """For every row: id_col, n_shingles (the size of its set) and component_id (the smallest id that links reach).

    A-Z are lower-cased, words are runs of other than ASCII white space. A text of fewer than n words has all of them
    as its one feature; one without words, or null, has none and links with nothing. Equal sets are linked and
    are handled as one. Rows that repeat are equal sets; a null id counts as larger than any other. Sets are held by 64-bit hashes.
    """
    found = _components_of_rows(df, id_col, text_col, n, percent)
    return found.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("lowest", "id").alias("component_id"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of df without near copies: of each component one row stays, that of the smallest id; where several rows
    of it have that id, one of the text with the smallest hash, once.

    A row is told by id and text, so of two rows with one id and different texts each has its own fate. A null id comes
    after all others. Rows without words, or with null text, are near nothing and all stay. Other columns, of any name, are
    kept; an empty table gives no rows.
    """
    found = _components_of_rows(df, id_col, text_col, n, percent).groupBy("label", "id", "place").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "place", "copies")).alias("one")
    kept = found.filter("label is not null").groupBy("label").agg(first).select("one.id", "one.place", "one.copies")
    kept = kept.unionByName(found.filter("label is null").select("id", "place", F.lit(1).cast("long").alias("copies")))
    kept = _stored(kept.select(F.col("id").alias("__id"), F.col("place").alias("__place"), F.col("copies").alias("__copies")), "kept")
    placed = df.withColumn("__at", F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__at") == F.col("__place"))
    once = placed.join(kept.filter("__copies = 1"), same, "left_semi")
    repeated = placed.join(kept.filter("__copies > 1"), same, "left_semi").dropDuplicates([id_col, "__at"])
    return once.unionByName(repeated).drop("__at")


def _components_of_rows(df: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """For every row: id, place (a hash of its text), n_shingles, label (one number for a component, null for a row
    without words) and lowest (the component's smallest id, null if it has none)."""
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("place"), F.col(text_col).alias("text"))
    rows = materialize(document_classes(docs, n), "classes")
    one = F.min(F.struct("place", "id"))  # the row whose text stands for the class
    groups = rows.filter("class is not null").groupBy("class").agg(F.min("id").alias("least"), one.alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("print").alias("print"), *[F.first(s).alias(s) for s in SKETCH], F.count("*").alias("members"))
    classes = _stored(groups.select("class", "least", "one.id", "one.place", "n_shingles", "print", *SKETCH, "members"), "class_groups")
    rows = rows.select("id", "place", "class", "n_shingles")

    dealt = signature_rows(docs.select("id", "text"), n, percent).repartition("sig").sortWithinPartitions("sig", "class")
    met = materialize(gathered(dealt).mapInArrow(_meet, "crowded boolean, x long, y long"), "candidates")
    pairs = met.filter("not crowded").select(F.col("x").alias("a"), F.col("y").alias("b"))
    crowded = met.filter("crowded").select(F.col("x").alias("sig"), F.col("y").alias("class"))

    # sets with more crowded signatures than the slack of the smallest set that they may link with
    often = crowded.groupBy("class").agg(F.count("*").alias("n")).join(classes.select("class", "n_shingles"), "class")
    often = often.filter(f"n > 2 + floor(ceil({percent} * n_shingles / 100) / 25)").select("class")
    open_rows = _stored(crowded.join(often, "class"), "crowded")

    # first round: each set against the smallest that it shares an uncrowded signature or a crowd with
    pivots = open_rows.groupBy("sig").agg(F.min("class").alias("a"))
    first = open_rows.join(pivots, "sig").filter("a <> class").select("a", F.col("class").alias("b"))
    pairs = _plausible(pairs.unionByName(first).distinct(), classes, percent)
    first = pairs.groupBy("b").agg(F.min("a").alias("a"))
    links = _verify(docs, classes, _stored(first.select("a", "b"), "first"), n, percent)
    labels = _stored(components(links), "labels")

    # second: all other pairs that share an uncrowded signature, or a rare shingle in crowds that are not yet one component
    open_rows = _renew(_divided(open_rows, labels), "crowded", open_rows)
    rest = _apart(pairs, labels)
    if not (done := open_rows.isEmpty()):
        alike, rare = _by_rare_shingles(docs, classes, open_rows, n, percent)
        rest = rest.unionByName(_plausible(alike, classes, percent)).distinct()
        info = classes.select("class", "n_shingles", *SKETCH).join(_few(rare), "class")
        members = open_rows.select("sig", "class").join(info.filter(f"{percent} * rare <= {100 - percent} * (n_shingles - rare)"), "class")
        open_rows = _renew(_with_earlier(members), "crowded", open_rows)
    labels = _contracted(docs, classes, _stored(rest, "rest"), labels, n, percent)

    # then what is made of frequent shingles: a crowd that is still in several components is held against some of its
    # members as pivots, which then leave it, and against many more of them each time
    count = 16
    while not done:
        open_rows = _renew(_divided(open_rows, labels), "crowded", open_rows)
        chosen = _stored(_pivots(open_rows, count, percent), "pivots")
        if chosen.isEmpty():
            break
        near = open_rows.join(F.broadcast(chosen) if small_enough(chosen, FEW_PAIRS) else chosen, "sig").filter(_near_by_shape(percent)).filter("not arrays_overlap(earlier, a.earlier)")
        edges = near.select(F.least("a.class", "class").alias("a"), F.greatest("a.class", "class").alias("b")).distinct()
        labels = _contracted(docs, classes, _plausible(edges, classes, percent), labels, n, percent)
        # a crowd of which all were pivots is through
        left = open_rows.filter(f"size > {count}").drop("label", "size")
        done = left.isEmpty()
        if not done:
            open_rows = _renew(left.join(chosen.select("sig", F.col("a.class").alias("class")), ["sig", "class"], "left_anti"), "crowded", open_rows)
        discard(chosen)
        count *= 64

    classes = classes.select("class", "least", "members")
    small = classes.join(labels, classes["class"] == labels["node"]).select("class", "least", "label")
    lowest = small.groupBy("label").agg(F.min("least").alias("lowest"))
    small = small.join(lowest, "label").select("class", "label", "lowest")
    table = classes.join(small, "class", "left").select("class", F.coalesce("label", "class").alias("label"), F.coalesce("lowest", "least").alias("lowest"), "members")
    total = classes.agg(F.sum("members")).first()[0] or 0
    hot = table.filter(F.col("members") * HOT_SHARE > total)
    return lookup(rows, table.drop("members"), "class", hot=hot.drop("members")).select("id", "place", "n_shingles", "label", "lowest")


def _stored(df: DataFrame, name: str) -> DataFrame:
    return materialize(gathered(df), name)


def _renew(df: DataFrame, name: str, old: DataFrame) -> DataFrame:
    """df as a table, which takes the place of the one that it was made of."""
    new = _stored(df, name)
    discard(old)
    return new


def _divided(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (sig, class, ...) whose signature still has several components, with their labels and its number of rows."""
    labelled = rows.join(_few(labels).withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    mixed = labelled.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).filter("low <> high")
    return labelled.join(mixed.select("sig", "size"), "sig")


def _by_rare_shingles(docs: DataFrame, classes: DataFrame, open_rows: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The finest partition, without the shingles that over RARE of the open sets have: pairs (a, b) of different
    components that share a rare shingle and may link, and rows (class, rare) with the number of a set's rare ones.

    Of two sets with r and q rare ones, c of them in both, and f and g others, r + q - 2c + |f - g| features differ at
    least. Two sets without a common rare shingle (c = 0) are left to the frequent ones."""
    members = _stored(open_rows.select("class", "label").distinct().join(classes.select("class", "id", "place", "n_shingles"), "class"), "open")
    found = materialize(_texts_of(docs, members, small_enough(members)).mapInArrow(_features(n), "class long, feature long"), "features")
    common = found.groupBy("feature").agg(F.count("*").alias("sets")).filter(f"sets <= {RARE}").select("feature")
    mine = found.join(common, "feature").join(_few(members.select("class", "label", "n_shingles")), "class")
    mine = _renew(mine, "rare", found)
    rare = members.select("class").join(mine.groupBy("class").agg(F.count("*").alias("rare")), "class", "left").select("class", F.coalesce("rare", F.lit(0)).alias("rare"))
    rare = _stored(rare, "rare_counts")
    x, y = (mine.select("feature", F.col("class").alias(c), F.col("label").alias(f"l_{c}"), F.col("n_shingles").alias(f"n_{c}")) for c in "ab")
    met = x.join(y, "feature").filter(f"a < b and l_a <> l_b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    met = met.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("c"))
    for c in "ab":
        met = met.join(_few(rare.select(F.col("class").alias(c), F.col("rare").alias(f"r_{c}"))), c)
    differ = "r_a + r_b - 2 * c + abs(n_a - r_a - n_b + r_b)"
    return met.filter(f"({differ}) * {100 + percent} <= (n_a + n_b) * {100 - percent}").select("a", "b"), rare


def _features(n: int):
    """A function for mapInArrow: rows (class, text) to one (class, feature) for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text", 1 << 18):
                found = [shingles(t, words, n) for t in batch.column("text").to_pylist()]
                classes = np.repeat(batch.column("class").to_numpy(), [len(x) for x in found])
                yield _pair_batch(classes, np.concatenate(found).view(np.int64), "class", "feature")

    return run


def _with_earlier(rows: DataFrame) -> DataFrame:
    """The rows (sig, class, ...) with the last BEFORE signatures of the class that are smaller, as `earlier`. Near copies share
    most of their signatures. Two sets that have one of them in common meet there, or in one before that, so they need
    not meet here: in the smallest that both have nothing is left out. These lists stay as they are from round to round."""
    order = Window.partitionBy("class").orderBy("sig").rowsBetween(-BEFORE, -1)
    return rows.withColumn("earlier", F.collect_list("sig").over(order))


def _pivots(rows: DataFrame, count: int, percent: int) -> DataFrame:
    """`count` members of each signature, the smallest in each of as many slices, of those that can be the one with the
    fewer rare shingles of a pair (an eighth of its own at 80 per cent); all such ones where its `size` is no more."""
    light = rows.filter(f"2 * {percent} * rare <= {100 - percent} * n_shingles")
    of = F.pmod(F.xxhash64("class"), F.lit(count))
    if "size" in rows.columns:
        of = F.when(F.col("size") <= count, F.col("class")).otherwise(of)
    best = light.groupBy("sig", of.alias("slice")).agg(F.min(F.struct("class", "label", "n_shingles", "rare", *SKETCH, "earlier")).alias("a"))
    return best.select("sig", "a")


def _near_by_shape(percent: int) -> str:
    """Whether a set and pivot `a` of different components can link, by rare and other shingles and by their sketches."""
    apart = " + ".join(f"bit_count({s} ^ a.{s})" for s in SKETCH)
    differ = "rare + a.rare + abs(n_shingles - rare - a.n_shingles + a.rare)"
    return f"a.label <> label and a.class <> class and greatest({differ}, {apart}) * {100 + percent} <= (n_shingles + a.n_shingles) * {100 - percent}"


def _contracted(docs: DataFrame, classes: DataFrame, pairs: DataFrame, labels: DataFrame, n: int, percent: int) -> DataFrame:
    """Labels after those of stored pairs that link. Only components that a link joins are looked at again."""
    if pairs.isEmpty():
        return labels
    links = _verify(docs, classes, pairs, n, percent)
    discard(pairs)
    joined = _stored(_labelled(links, labels).filter("l_a <> l_b").select(F.col("l_a").alias("a"), F.col("l_b").alias("b")).distinct(), "joined")
    if joined.isEmpty():
        return labels
    new = _stored(components(joined), "moved")
    moved = labels.join(_few(new), labels["label"] == new["node"], "left").select(labels["node"], F.coalesce(new["label"], labels["label"]).alias("label"))
    return _renew(moved.unionByName(new.join(_few(labels).select("node"), "node", "left_anti")), "labels", labels)


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) with l_a and l_b, the components of both; a class without a label is one by itself."""
    labels = _few(labels)
    for c in "ab":
        pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}")), c, "left").withColumn(f"l_{c}", F.coalesce(f"l_{c}", c))
    return pairs


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes, sketches and prints allow a link."""
    pairs = _stored(pairs, "met")

    def shape(c: str, *more: Column) -> DataFrame:
        return classes.select(F.col("class").alias(c), F.col("n_shingles").alias(f"n_{c}"), *[F.col(s).alias(f"{s}_{c}") for s in SKETCH], *more)

    apart = " + ".join(f"bit_count({s}_a ^ {s}_b)" for s in SKETCH)
    sized = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and ({apart}) * {100 + percent} <= (n_a + n_b) * {100 - percent}"
    if small_enough(pairs, FEW_PAIRS):  # the classes need not be shuffled
        x = F.broadcast(pairs).join(shape("a", F.col("print").alias("x")), "a")
        y = F.broadcast(pairs).join(shape("b", F.col("print").alias("y")), "b")
        both = x.join(y, ["a", "b"]).filter(sized)
    else:
        near = _stored(pairs.join(shape("a"), "a").join(shape("b"), "b").filter(sized).select("a", "b", "n_a", "n_b"), "near")
        few = _few(near)
        prints = classes.select(F.col("class").alias("c"), "print")
        x = few.join(prints, F.col("a") == F.col("c")).select("a", "b", "n_a", "n_b", F.col("print").alias("x"))
        y = few.join(prints, F.col("b") == F.col("c")).select("a", "b", F.col("print").alias("y"))
        both = x.join(y, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (np.add(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) * (100 - percent) // (100 + percent)).tolist()
            near = [cells_apart(p, q) <= d for p, q, d in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), most)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return materialize(gathered(both.select("a", "b", "n_a", "n_b", "x", "y")).mapInArrow(run, "a long, b long"), "pairs")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of different components. Those that were compared and did not link are among them, again."""
    return _labelled(pairs, labels).filter("l_a <> l_b").select("a", "b")


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold.

    The text of b goes to its pivot a, that of a once to each part of the group that is made for it; a pivot
    with many members has its group in parts of about MEMBERS. Only texts are moved, which shrink well in a shuffle.
    """
    few = small_enough(pairs, BROADCAST_ROWS // 2)  # of stored pairs, of which two deliveries each are made at most
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(F.broadcast(sizes) if few else sizes, "a").select(F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("class"))
    own = sizes.select(F.col("a").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("class"))
    deliveries = _stored(members.unionByName(own), "deliveries")
    named = deliveries.select("class").distinct()
    wanted = classes.select("class", "id", "place").join(F.broadcast(named) if few else named, "class")
    texts = _texts_of(docs, wanted, few or small_enough(wanted))
    sent = texts.join(F.broadcast(deliveries) if few else _few(deliveries), "class")
    grouped = sent.repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.col("class") != F.col("pivot"))
    return materialize(gathered(grouped.select("pivot", "class", "text")).mapInArrow(_compare(percent, n), "a long, b long"), "links")
