"""Several readings of one page: labels for its segments, missing columns and repeated tiles, corrections and additions.

Pages are rows and are worked on where they lie; what is compared across pages or terms goes through joins and windows.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import sequential
from quire.sources.shared import spread

FAR = 1 << 28
#: Hashes of terms that tasks are sent at most; eight bytes each.
LISTED = 2_000_000
_STEP = 0x9E3779B97F4A7C15


def _sweep(r: np.ndarray, h: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Row by row the edit distances of the first i of r and the first j of h for j from i - most to i + most; FAR
    outside. Cells further from the diagonal belong to no alignment with at most `most` operations."""
    width = 2 * most + 1
    shift = np.arange(width)
    row = np.where((shift >= most) & (shift - most <= len(h)), shift - most, FAR)
    yield row
    padded = np.concatenate((np.full(most + 1, -1, np.int64), h.astype(np.int64), np.full(most + 1, -1, np.int64)))
    for i in range(1, len(r) + 1):
        j = i - most + shift
        letters = padded[np.clip(j - 1 + most + 1, 0, len(padded) - 1)]
        new = np.minimum(row + (letters != int(r[i - 1])), np.append(row[1:], FAR) + 1)
        new = np.where(j == 0, i, np.where((j < 0) | (j > len(h)), FAR, new))
        new = np.minimum.accumulate(new - shift) + shift  # insertions, from the left
        row = np.where((j < 0) | (j > len(h)), FAR, np.minimum(new, FAR))
        yield row


def boundary_places(reference: str, hypothesis: str, places: list[int], most: int) -> tuple[int, list[tuple[int, int]]] | None:
    """The edit distance and, for each place of the hypothesis, the least and the greatest place of the reference where any
    optimal alignment of the two crosses it; None if the distance is over `most`.

    A cell is on an optimal alignment if the distance before it and the one after it add up to the whole."""
    n, m = len(reference), len(hypothesis)
    if abs(n - m) > most:
        return None
    r, h = (np.array([ord(c) for c in x], np.int64) for x in (reference, hypothesis))
    at = np.array(places, np.int64)

    def columns(r: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
        out = np.full((n + 1, len(at)), FAR, np.int64)
        for i, row in enumerate(_sweep(r, h, most)):
            k = at - i + most
            inside = (k >= 0) & (k <= 2 * most)
            out[i, inside] = row[k[inside]]
        return out, int(row[m - n + most])

    before, distance = columns(r, h, at)
    if distance > most:
        return None
    after, _ = columns(r[::-1], h[::-1], m - at)
    on = before + after[::-1] == distance
    return distance, [(int(np.flatnonzero(c)[0]), int(np.flatnonzero(c)[-1])) for c in on.T]


def segment_labels(pages: DataFrame, key: str, reference: str, segments: str, page_rate: float = 0.15, segment_rate: float = 0.15, shortest: int = 5, longest: int = 100, gap: int = 0) -> DataFrame:
    """(key, page_reason, page_rate, segment, label, rate, reasons): the part of a reference text that belongs to each segment
    of a page's reading. Texts are normalised before. A page without text is `empty_page_text`, one whose error rate is
    over page_rate `page_rate_exceeded`; neither has labels. Where optimal alignments put a boundary at places more
    than `gap` apart both neighbours are `ambiguous_boundary`. A segment without reasons is accepted."""
    kind = pa.list_(pa.struct([("segment", pa.int32()), ("label", pa.string()), ("rate", pa.float64()), ("reasons", pa.list_(pa.string()))]))
    fields = pa.struct([("page_reason", pa.string()), ("page_rate", pa.float64()), ("found", kind)])

    def one(text: str, parts: list[str]) -> dict:
        whole = "".join(parts)
        if not text or not whole:
            return {"page_reason": "empty_page_text", "page_rate": None, "found": [{"segment": None}]}
        bounds = np.cumsum([0, *map(len, parts)]).tolist()
        places = boundary_places(text, whole, bounds, math.floor(page_rate * len(text)))
        if places is None:
            return {"page_reason": "page_rate_exceeded", "page_rate": None, "found": [{"segment": None}]}
        distance, spans = places
        cuts = [0, *((a + b) // 2 for a, b in spans[1:-1]), len(text)]
        unsure = {i for i, (a, b) in enumerate(spans) if 0 < i < len(parts) and b - a > gap}
        out = []
        for i, part in enumerate(parts):
            label = text[cuts[i] : cuts[i + 1]]
            rate = _distance(label, part) / len(label) if label else None
            reasons = [name for name, c in (("ambiguous_boundary", {i, i + 1} & unsure), ("label_length", not shortest <= len(label) <= longest), ("segment_rate_exceeded", rate is None or rate > segment_rate)) if c]
            out.append({"segment": i, "label": label, "rate": rate, "reasons": reasons})
        return {"page_reason": None, "page_rate": distance / len(text), "found": out}

    @F.arrow_udf("struct<page_reason:string,page_rate:double,found:array<struct<segment:int,label:string,rate:double,reasons:array<string>>>>")
    def aligned(texts: pa.Array, parts: pa.Array) -> pa.Array:
        return pa.array([one(t or "", [p or "" for p in ps or []]) for t, ps in zip(texts.to_pylist(), parts.to_pylist())], fields)

    return pages.select(key, aligned(reference, segments).alias("a")).select(key, "a.page_reason", "a.page_rate", F.inline("a.found"))


def _distance(a: str, b: str) -> int:
    return len(sequential.edit_operations(a, b)) if a and b else max(len(a), len(b))


def missing_columns(columns: DataFrame, page: str, left: str, right: str, chars: str, ratio: float, header_chars: int, most: int = 3) -> DataFrame:
    """Columns that a page should have and has not: (page, gap_index, missing_index, missing_count, center, width, gap_ratio).

    Columns are ordered from right to left. Gaps between centers are held against the median of the positive ones; a gap of
    `ratio` medians or more has one column less than it has medians, half to even, from 1 to `most`, evenly spread. The first gap does
    not count where the rightmost column has header_chars or fewer characters, for that may be a header. Pages of fewer than
    four columns or three positive gaps have none."""
    by = Window.partitionBy(page).orderBy(F.desc("center"), F.col(left))
    c = columns.select(page, ((F.col(left) + F.col(right)) / 2).cast("double").alias("center"), (F.col(right) - F.col(left)).cast("double").alias("w"), F.col(chars).alias("n"), left)
    c = c.select(page, "center", "w", "n", (F.row_number().over(by) - 1).alias("gap_index"), (F.col("center") - F.lead("center").over(by)).alias("gap"))
    sums = c.groupBy(page).agg(F.count("*").alias("k"), F.count_if(F.col("gap") > 0).alias("p"), F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("median"), F.median("w").alias("width"))
    j = c.join(sums.filter("k >= 4 and p >= 3"), page).withColumn("gap_ratio", F.col("gap") / F.col("median"))
    wide = j.filter((F.col("gap") > 0) & (F.col("gap_ratio") >= ratio) & ~((F.col("gap_index") == 0) & (F.col("n") <= header_chars)))
    count = F.least(F.lit(most), F.greatest(F.lit(1), F.bround("gap_ratio", 0).cast("int") - 1))
    wide = wide.withColumn("missing_count", count).withColumn("missing_index", F.explode(F.sequence(F.lit(0), F.col("missing_count") - 1)))
    center = F.col("center") - F.col("gap") / (F.col("missing_count") + 1) * (F.col("missing_index") + 1)
    return wide.select(page, "gap_index", "missing_index", "missing_count", center.alias("center"), "width", "gap_ratio")


def tile_clusters(tiles: DataFrame, book: str, x: str, y: str, pages: str, sampled: str, stride: int = 32, share: float = 0.2, fewest: int = 3, least: int = 2) -> DataFrame:
    """(book, cluster, x, y, common): tiles that repeat on the same pages and touch each other.

    Tiles are taken in the order of the number of pages they repeat on, most first, then by place. One joins the first open
    cluster that it has enough pages in common with (`fewest`, and `share` of the sampled ones) and of which it touches a
    tile; the cluster's pages become the common ones. Else it opens one. Clusters of fewer than `least` tiles go. Tiles of a
    book are as many as places on a page, and come in order; a grid of places finds the clusters that a tile touches."""
    ordered = tiles.select(F.col(book).alias("book"), F.col(x).alias("x"), F.col(y).alias("y"), F.array_sort(F.array_distinct(pages)).alias("pages"), F.col(sampled).alias("sampled"))

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        found = sorted(rows.to_pylist(), key=lambda t: (-len(t["pages"]), t["y"], t["x"]))
        members: list[list[dict]] = []
        common: list[set] = []
        cells: dict[tuple, set[int]] = {}
        for t in found:
            needed = max(fewest, math.ceil(t["sampled"] * share))
            cell = (t["x"] // stride, t["y"] // stride)
            near = sorted(set().union(*(cells.get((cell[0] + a, cell[1] + b), ()) for a in (-1, 0, 1) for b in (-1, 0, 1))))
            for i in near:
                shared = common[i] & set(t["pages"])
                if len(shared) >= needed and any((m["x"], m["y"]) != (t["x"], t["y"]) and abs(m["x"] - t["x"]) <= stride and abs(m["y"] - t["y"]) <= stride for m in members[i]):
                    members[i].append(t)
                    common[i] = shared
                    break
            else:
                i = len(members)
                members.append([t])
                common.append(set(t["pages"]))
            cells.setdefault(cell, set()).add(i)
        kept = [(m, c) for m, c in zip(members, common) if len(m) >= least and c]
        out = [{"book": t["book"], "cluster": k, "x": t["x"], "y": t["y"], "common": len(c)} for k, (m, c) in enumerate(kept) for t in m]
        return pa.Table.from_pylist(out, pa.schema([rows.schema.field("book"), ("cluster", pa.int32()), rows.schema.field("x"), rows.schema.field("y"), ("common", pa.int32())]))

    types = {f.name: f.dataType.simpleString() for f in ordered.schema}
    got = ordered.groupBy("book").applyInArrow(run, f"book {types['book']}, cluster int, x {types['x']}, y {types['y']}, common int")
    return got.withColumnRenamed("book", book).withColumnRenamed("x", x).withColumnRenamed("y", y)


def one_letter_variants(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """(key, start, variant, term): places of texts that differ from a term of two characters at least in exactly one.

    A term is known by each of its deletion neighbours: its length, a place, and itself without the character there. Windows of
    texts in these lengths are known by theirs, so both meet by equality of a hash, and are then compared; terms are never
    held against texts as such. Lengths are few and are sent to the tasks, and so are up to LISTED hashes of terms, so that
    only what may match is dealt out; with more terms all windows are."""
    spark = texts.sparkSession
    long = terms.select(F.col(term).alias("term")).filter(F.length("term") >= 2).distinct()
    lengths = sorted(r[0] for r in long.select(F.length("term")).distinct().collect())

    def of_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found = np.concatenate([m for _, m in _neighbours(t, len(t))])
                yield pa.record_batch([pa.array([t] * len(found)), pa.array(found.view(np.int64))], names=["term", "mask"])

    of_terms = long.mapInArrow(of_term, "term string, mask long")
    masks = of_terms.select("mask").distinct().limit(LISTED + 1).toArrow().column(0).to_numpy()
    known = spark.sparkContext.broadcast(np.sort(masks)) if 0 < len(masks) <= LISTED else None

    def of_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if known is not None:
            # most hashes are told apart by their last bits
            table, marked = known.value, np.zeros(1 << 20, bool)
            marked[table & 0xFFFFF] = True
        for batch in batches:
            for row, t in enumerate(batch.column(1).to_pylist()):
                for n in lengths:
                    for starts, found in _neighbours(t, n):
                        found = found.view(np.int64)
                        if known is not None:
                            some = np.flatnonzero(marked[found & 0xFFFFF])
                            starts, found = starts[some], found[some]
                            hit = table[np.minimum(np.searchsorted(table, found), len(table) - 1)] == found
                            starts, found = starts[hit], found[hit]
                        if len(found):
                            same = batch.column(0).slice(row, 1).take(pa.array(np.zeros(len(found), np.int32)))
                            yield pa.record_batch([same, pa.array(found), pa.array(starts.astype(np.int32))], names=["k", "mask", "start"])

    kind = texts.schema[key].dataType.simpleString()
    of_texts = spread(texts.filter(F.col(text).isNotNull()).select(key, text), key).mapInArrow(of_text, f"k {kind}, mask long, start int")
    met = of_texts.join(of_terms.hint("merge"), "mask").select("k", "start", "term").distinct()
    whole = met.join(texts.select(F.col(key).alias("k"), F.col(text).alias("t")).hint("merge"), "k").withColumn("variant", F.substr("t", F.col("start") + 1, F.length("term")))
    apart = F.size(F.filter(F.zip_with(F.split("variant", ""), F.split("term", ""), lambda a, b: a != b), lambda d: d))
    return whole.filter(apart == 1).select(F.col("k").alias(key), "start", "variant", "term")


def _neighbours(text: str, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each place p in a window of n characters: where windows of the text begin, and a hash of each without its p-th."""
    count = len(text) - n + 1
    if count < 1:
        return
    with np.errstate(over="ignore"):
        step, back = np.uint64(_STEP), np.uint64(pow(_STEP, -1, 1 << 64))
        v = _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1))
        up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(v), step))))
        down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(count - 1, back))))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v * up[: len(v)])))
        whole = (total[n : n + count] - total[:count]) * down
        starts = np.arange(count)
        for p in range(n):
            yield starts, _mix(whole - v[p : p + count] * up[p] + np.uint64(n * 65_537 + p))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def supported_corrections(pages: DataFrame, key: str, consensus: str, readings: str, terms: DataFrame, term: str) -> tuple[DataFrame, DataFrame]:
    """(proposals, texts). A variant of a term in a consensus text is corrected where a reading, aligned to the consensus, has
    the term at the very place. proposals: (key, start, variant, term, exact, same, result), result being `applied`,
    `overlapping` where supported ones overlap, so that none of them is taken, `unsupported` where no reading has the term
    there though one has it somewhere and two have the variant, else `dropped`. texts: (key, corrected) of all pages.
    Only pages with a variant are aligned."""
    found = one_letter_variants(pages, key, consensus, terms, term)
    grouped = found.groupBy(key).agg(F.collect_list(F.struct("start", "variant", "term")).alias("__f"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("variant", pa.string()), ("term", pa.string()), ("exact", pa.int32()), ("same", pa.int32()), ("seen", pa.bool_())]))

    @F.arrow_udf("array<struct<start:int,variant:string,term:string,exact:int,same:int,seen:boolean>>")
    def support(texts: pa.Array, others: pa.Array, variants: pa.Array) -> pa.Array:
        out = []
        for t, rs, vs in zip(texts.to_pylist(), others.to_pylist(), variants.to_pylist()):
            rs = [r or "" for r in rs or []]
            aligned = [_aligned(t, r) for r in rs]
            rows = []
            for v in vs:
                windows = [a[v["start"] : v["start"] + len(v["term"])] for a in aligned]
                rows.append(v | {"exact": sum(w == list(v["term"]) for w in windows), "same": sum(w == list(v["variant"]) for w in windows), "seen": any(v["term"] in r for r in rs)})
            out.append(rows)
        return pa.array(out, kind)

    rows = spread(pages.select(key, consensus, readings), key).join(grouped.hint("merge"), key).select(key, F.inline(support(consensus, readings, "__f")))
    order = [F.col("start"), F.col("term")]
    # supported ones are held against each other alone; all in one pass, so that pages are aligned once
    ends = rows.withColumns({"end": F.col("start") + F.length("term"), "__b": F.col("exact") > 0})
    by = Window.partitionBy(key, "__b")
    before = F.max("end").over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("start").over(by.orderBy(*order).rowsBetween(1, Window.unboundedFollowing))
    clash = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    result = F.when(F.col("__b") & clash, "overlapping").when(F.col("__b"), "applied").when(F.col("seen") & (F.col("same") >= 2), "unsupported").otherwise("dropped")
    proposals = ends.withColumn("result", result).drop("end", "__b", "seen")
    taken = proposals.filter("result = 'applied'").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "term"))).alias("__a"))
    t = F.col(consensus)
    put = F.aggregate("__a", t, lambda s, a: F.concat(F.substr(s, F.lit(1), a["start"]), a["term"], F.substr(s, a["start"] + F.length(a["term"]) + 1, F.length(s))))
    return proposals, pages.join(taken, key, "left").select(key, F.coalesce(put, t).alias("corrected"))


def _aligned(pivot: str, other: str) -> list[str | None]:
    """For each character of the pivot the one that an alignment puts there; None where the other lacks it."""
    out: list[str | None] = list(pivot)
    for kind, place, _, found in sequential.edit_operations(pivot, other) if pivot != other else ():
        if kind != "insertion":
            out[place] = found if kind == "substitution" else None
    return out


def adjudicated(df: DataFrame, primary: str, external: str, primary_ok: Column, external_ok: Column, similar: float = 0.85, complete: float = 1.02) -> DataFrame:
    """df with chosen (`primary` or `external`), passed and flag, from two independent readings: the one that is there; neither
    where they disagree, by a matching-blocks ratio below `similar`, or one has no text; the external one where it has
    `complete` times the text; else the primary one, as consensus. Only rows whose lengths allow the ratio are compared."""
    a, b = F.length(F.coalesce(primary, F.lit(""))), F.length(F.coalesce(external, F.lit("")))
    both = primary_ok & external_ok & (a > 0) & (b > 0)
    could = both & (2 * F.least(a, b) >= similar * (a + b))
    ratio = F.when(could, sequential.similarity(F.when(could, F.col(primary)), F.when(could, F.col(external))))
    j = df.withColumn("__r", F.coalesce(ratio, F.lit(0.0)))
    # the names of flags are fixed values
    flag = (
        F.when(~external_ok & primary_ok, "external_crosscheck_unavailable")
        .when(~external_ok, "no_reading")
        .when(~primary_ok, "external_ocr_recovered_primary")
        .when(F.col("__r") < similar, "cross_engine_disagreement")
        .when(b / a >= complete, "external_ocr_more_complete")
        .otherwise("cross_engine_consensus")
    )
    j = j.withColumn("flag", flag)
    chosen = F.when(F.col("flag").isin("external_ocr_recovered_primary", "external_ocr_more_complete", "no_reading"), "external").otherwise("primary")
    return j.withColumns({"chosen": chosen, "passed": ~F.col("flag").isin("cross_engine_disagreement", "no_reading")}).drop("__r")


def insertions(primary: str, alternative: str, shortest: int, longest: int, anchor: int) -> list[tuple[int, str]]:
    """What the other reading has between two runs of `anchor` characters or more in which both agree: (place, text)."""
    steps = difflib.SequenceMatcher(None, primary, alternative, autojunk=False).get_opcodes()
    held = [tag == "equal" and b - a >= anchor for tag, a, b, _, _ in steps]
    return [
        (a, alternative[c:d])
        for k, (tag, a, _, c, d) in enumerate(steps)
        if tag == "insert" and shortest <= d - c <= longest and 0 < k < len(steps) - 1 and held[k - 1] and held[k + 1] and any(x.isalnum() for x in alternative[c:d])
    ]


@F.udtf(returnType="place int, added string", useArrow=True)
class InsertionProposals:
    """Table function: (place, added) for each anchored insertion of an alternative reading."""

    def eval(self, primary: str, alternative: str, shortest: int, longest: int, anchor: int):
        if primary is not None and alternative is not None:
            yield from insertions(primary, alternative, shortest, longest, anchor)


#: A group of pages in a fact line. Fixed value.
PAGE_GROUP = r"\[\s*page\s+\d+(?:\s*[,、/&・]\s*(?:page\s+)?\d+)*\s*\]"


def fact_lines(value: Column) -> Column:
    """The items of a fact sheet: array of (text, pages, problem). An item begins with a bullet and goes on to the next one; its
    pages are those of all its groups, each once; problem is `no page` or `no text`, else null. All in built-in functions."""
    lines = F.filter(F.transform(F.split(value, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    bullet = r"(?U)^[-*・]\s*"
    start = F.array().cast("array<string>")

    def add(items: Column, line: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(line, bullet, ""), r"(?U)\s+$", "")
        size = F.size(items)
        longer = F.concat(F.slice(items, 1, F.greatest(size - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(items, F.lit(-1)), line)))
        return F.when(line.rlike(bullet) | (size == 0), F.concat(items, F.array(F.when(line.rlike(bullet), text).otherwise(line)))).otherwise(longer)

    def item(x: Column) -> Column:
        groups = F.regexp_extract_all(x, F.lit("(?i)" + PAGE_GROUP), F.lit(0))
        pages = F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.regexp_extract_all(g, F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("long")))))
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "(?i)" + PAGE_GROUP, ""), r"(?U)\s+", " "), r"^[ \-・*\t]+|[ \-・*\t]+$", "")
        problem = F.when(F.size(pages) == 0, "no page").when(bare == "", "no text")
        return F.struct(bare.alias("text"), pages.alias("pages"), problem.alias("problem"))

    return F.transform(F.aggregate(F.coalesce(lines, start), start, add), item)


def fact_records(sheets: DataFrame, key: str, value: str, pages: str) -> DataFrame:
    """(key, place, text, pages, problem) of each item of a sheet; a page that is not among the allowed `pages` (an array) is
    `invented page`; a sheet without items is one row, `no facts`."""
    rows = sheets.select(key, F.col(pages).alias("__allowed"), F.posexplode_outer(fact_lines(F.col(value))).alias("place", "x"))
    extra = F.size(F.array_except("x.pages", "__allowed")) > 0
    problem = F.when(F.col("x").isNull(), "no facts").when(F.col("x.problem").isNotNull(), F.col("x.problem")).when(extra, "invented page")
    return rows.select(key, "place", "x.text", "x.pages", problem.alias("problem"))
