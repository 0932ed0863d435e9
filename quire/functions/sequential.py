"""Text functions whose steps depend on each other: chunking, alignment, consensus. They run in Arrow batches, a row at a
time in a task."""

from __future__ import annotations

import bisect
import difflib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quire.sources.shared import spread

#: Fixed values.
SENTENCE_ENDS = "。」!?"


def chunk_places(text: str, size: int = 800, overlap: int = 50, look_back: int = 100) -> list[tuple[int, str]]:
    """(where it begins, part) for parts of at most `size` characters, cut after the last sentence end among their last
    `look_back`, each beginning `overlap` before the end of the one before; trimmed, without empty ones."""
    out, at = [], 0
    while at < len(text):
        stop = min(len(text), at + size)
        if stop < len(text):
            low = max(at + size - look_back, at + 1)
            found = max(text.rfind(c, low, stop) for c in SENTENCE_ENDS)
            stop = found + 1 if found >= low else stop
        part = text[at:stop].strip()
        if part:
            out.append((at, part))
        if stop >= len(text):
            break
        at = max(stop - overlap, at + 1)
    return out


def chunks(text: str, size: int = 800, overlap: int = 50, look_back: int = 100) -> list[str]:
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    return [part for _, part in chunk_places(text, size, overlap, look_back)]


def book_chunks(pages: list[tuple[int, str]], size: int = 1200, overlap: int = 120, least: int = 30) -> list[tuple[int, int, str]]:
    """(page, chunk_idx, text) over the joined pages (page, text) of a book that have `least` characters: a chunk belongs to
    the page it begins on."""
    pages = [(p, t) for p, t in pages if len(t or "") >= least]
    begins = np.cumsum([0, *[len(t) for _, t in pages]])[: len(pages)]
    parts = chunk_places("".join(t for _, t in pages), size, overlap, max(size // 10, 50))
    return [(pages[int(np.searchsorted(begins, at, "right")) - 1][0], i, part) for i, (at, part) in enumerate(parts)]


def chunked_books(df: DataFrame, book: str, page: str, text: str, size: int = 1200, overlap: int = 120, least: int = 30) -> DataFrame:
    """(book, page, chunk_idx, text) of books across their pages. A book is one row while it is cut: it must fit in a task."""

    @F.arrow_udf("array<struct<page:long,chunk_idx:int,text:string>>")
    def cut(books: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("page", pa.int64()), ("chunk_idx", pa.int32()), ("text", pa.string())]))
        return pa.array([[dict(zip(("page", "chunk_idx", "text"), c)) for c in book_chunks([(x["p"], x["t"]) for x in pages], size, overlap, least)] for pages in books.to_pylist()], kind)

    lists = df.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(F.col(page).cast("long").alias("p"), F.col(text).alias("t")))).alias("__pages"))
    return lists.select(book, F.inline(cut("__pages"))).select(book, F.col("page").alias(page), "chunk_idx", F.col("text").alias(text))


def chunked(df: DataFrame, key: str, text: str, size: int = 800, overlap: int = 50) -> DataFrame:
    """(key, chunk_idx, text) of every text; null texts have no chunks."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([chunks(t or "", size, overlap) for t in texts.to_pylist()], pa.list_(pa.string()))

    return df.select(key, F.posexplode(cut(text)).alias("chunk_idx", "text"))


def _rows(r: np.ndarray, h: np.ndarray, above: np.ndarray, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of the table of distances under `above`, each with its directions: 1 substitution or match, 2 deletion,
    3 insertion, in this order of preference."""
    steps = np.arange(len(h) + 1, dtype=np.int32)
    for i, c in enumerate(r, first):
        sub, drop = above[:-1] + (h != c), above[1:] + 1
        row = np.concatenate(([i], np.minimum(sub, drop))).astype(np.int32)
        row = np.minimum.accumulate(row - steps) + steps
        way = np.full(len(row), 3, np.uint8)
        way[1:][row[1:] == drop] = 2
        way[1:][row[1:] == sub] = 1
        way[0] = 2
        yield row, way
        above = row


def edit_operations(reference: str, hypothesis: str) -> list[tuple[str, int, str, str]]:
    """(operation, place in the reference, its character, the other) on a shortest path; of equal ones a substitution is
    taken before a deletion, a deletion before an insertion, from the end.

    Texts that are alike are aligned by how far each number of edits reaches on each diagonal of the table of distances, which
    is exact and takes time by the square of the edits; others by the table itself."""
    found = _by_reach(reference, hypothesis, math.isqrt(REACH * min(len(reference), len(hypothesis))) + 8)
    return _by_table(reference, hypothesis) if found is None else found


#: Edits up to the root of so many times the shorter text's length are looked for without the table.
REACH = 16


def _by_reach(reference: str, hypothesis: str, most: int) -> list[tuple[str, int, str, str]] | None:
    """The same operations as by the table, or None where there are more than `most`. Distances do not fall along a diagonal,
    so that a cell's distance is at most e where e edits reach as far on its diagonal; a path needs only such comparisons."""
    n, m = len(reference), len(hypothesis)
    if abs(n - m) > most:
        return None
    r, h = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in (reference, hypothesis))
    apart: dict[int, list[int]] = {}

    def differing(k: int) -> list[int]:
        """Places of the reference that differ on the diagonal k (place in the hypothesis less place in the reference)."""
        if k not in apart:
            low, high = max(0, -k), min(n, m - k)
            apart[k] = (np.flatnonzero(r[low:high] != h[low + k : high + k]) + low).tolist()
        return apart[k]

    def slide(k: int, i: int) -> int:
        last = min(n, m - k)
        if i >= last or reference[i] != hypothesis[i + k]:
            return i
        places = differing(k)
        at = bisect.bisect_left(places, i)
        return places[at] if at < len(places) else last

    goal = m - n
    if not goal:  # differing places are as many substitutions: no path needs more
        most = min(most, len(differing(0)))
    reach = [{0: slide(0, 0)}]
    while reach[-1].get(goal, -1) < n:
        e = len(reach)
        if e > most:
            return None
        before, now = reach[-1], {}
        # farther off, the edits that are left do not lead to the end
        for k in range(max(-e, -n, goal - most + e), min(e, m, goal + most - e) + 1):
            # a substitution, a deletion from the diagonal above, an insertion from the one below
            i = max(before.get(k, -2) + 1, before.get(k + 1, -2) + 1, before.get(k - 1, -2))
            i = min(i, n, m - k)
            if i >= max(0, -k):
                now[k] = slide(k, i)
        reach.append(now)
    out, i, j, e = [], n, m, len(reach) - 1
    while i or j:
        k = j - i
        if i and j and reference[i - 1] == hypothesis[j - 1]:
            places = differing(k)
            at = bisect.bisect_left(places, i)
            i = places[at - 1] + 1 if at else max(0, -k)
            j = i + k
            continue
        below = reach[e - 1] if e else {}
        if not i:
            way = 3
        elif not j:
            way = 2
        elif below.get(k, -1) >= i - 1:
            way = 1
        else:
            way = 2 if below.get(k + 1, -1) >= i - 1 else 3
        e -= 1
        if way == 1:
            i, j = i - 1, j - 1
            out.append(("substitution", i, reference[i], hypothesis[j]))
        elif way == 2:
            i -= 1
            out.append(("deletion", i, reference[i], ""))
        else:
            j -= 1
            out.append(("insertion", i, "", hypothesis[j]))
    return out[::-1]


def _by_table(reference: str, hypothesis: str) -> list[tuple[str, int, str, str]]:
    """Operations by the whole table of distances.

    Every so many rows of distances are kept, and the directions of the rows between two of them are made again when the
    path reaches them: memory grows with the longer text times the root of the shorter."""
    n, m = len(reference), len(hypothesis)
    r, h = np.array([ord(c) for c in reference], np.uint32), np.array([ord(c) for c in hypothesis], np.uint32)
    block = max(16, math.isqrt(n))
    kept = [np.arange(m + 1, dtype=np.int32)]
    for i, (row, _) in enumerate(_rows(r, h, kept[0], 1), 1):
        if i % block == 0:
            kept.append(row)
    out, i, j, begin, ways = [], n, m, n + 1, []
    while i or j:
        if not i:
            way = 3
        else:
            if i <= begin:
                begin = (i - 1) // block * block
                ways = [w for _, w in _rows(r[begin:i], h, kept[begin // block], begin + 1)]
            way = ways[i - begin - 1][j]
        if way == 1:
            i, j = i - 1, j - 1
            if reference[i] != hypothesis[j]:
                out.append(("substitution", i, reference[i], hypothesis[j]))
        elif way == 2:
            i -= 1
            out.append(("deletion", i, reference[i], ""))
        else:
            j -= 1
            out.append(("insertion", i, "", hypothesis[j]))
    return out[::-1]


def operations(df: DataFrame, key: str, reference: str, hypothesis: str) -> DataFrame:
    """(key, operation, place, expected, found) for each difference."""

    @F.arrow_udf("array<struct<operation:string,place:int,expected:string,found:string>>")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("operation", pa.string()), ("place", pa.int32()), ("expected", pa.string()), ("found", pa.string())]))
        return pa.array([[dict(zip(("operation", "place", "expected", "found"), o)) for o in edit_operations(x or "", y or "")] for x, y in zip(a.to_pylist(), b.to_pylist())], kind)

    return df.select(key, F.inline(of(reference, hypothesis)))


def matched_places(reference: str, hypothesis: str) -> set[int]:
    """Places of the reference that an alignment finds again as they are."""
    missed = {place for kind, place, _, _ in edit_operations(reference, hypothesis) if kind != "insertion"}
    return set(range(len(reference))) - missed


def vote(readings: list[str], pivot: int, support: int = 2, delete_support: int = 3, gap_support: int = 2, found: dict | None = None) -> str:
    """Readings of one text, character by character against the pivot. A gap takes what most propose, the longest and then
    the last of equals, with enough support; a character that enough readings lack goes; a unique majority takes a place,
    else the pivot's character stays. `found` has alignments that are known, by the two texts."""
    base = readings[pivot]
    columns: list[Counter] = [Counter() for _ in base]
    gaps: list[Counter] = [Counter() for _ in range(len(base) + 1)]
    for other in readings:
        seen: dict[int, str] = {}
        inserted: dict[int, str] = {}
        known = (found or {}).get((base, other))
        for kind, place, _, new in (known if known is not None else edit_operations(base, other)) if other != base else ():
            if kind == "insertion":
                inserted[place] = inserted.get(place, "") + new
            else:
                seen[place] = new
        for p, c in enumerate(base):
            columns[p][seen.get(p, c)] += 1
        for p, text in inserted.items():
            gaps[p][text] += 1
    out = []
    for p in range(len(base) + 1):
        ready = [(n, len(text), text) for text, n in gaps[p].items() if n >= gap_support]
        if ready:
            out.append(max(ready)[2])
        if p == len(base) or columns[p].pop("", 0) >= delete_support:
            continue
        best = max(columns[p].values(), default=0)
        chosen = [c for c, n in columns[p].items() if n == best]
        out.append(chosen[0] if best >= support and len(chosen) == 1 else base[p])
    return "".join(out)


def similarity_ratio(a: str, b: str, autojunk: bool = False) -> float:
    """The matching-blocks ratio of two strings."""
    return difflib.SequenceMatcher(None, a, b, autojunk=autojunk).ratio()


@F.arrow_udf(DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else similarity_ratio(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def medoid_place(readings: list[str | None], found: dict[tuple[str, str], list]) -> int:
    """The place of the reading with the least sum of normalised edit distances to the others, the first of equals; a null is
    none apart from any. Alignments are kept in `found`."""
    total = [0.0] * len(readings)
    for j, y in enumerate(readings):
        for i, x in enumerate(readings[:j]):
            if x is not None and y is not None and x != y:
                if (x, y) not in found:
                    found[x, y] = edit_operations(x, y)
                d = len(found[x, y]) / max(len(x), len(y))
                total[i], total[j] = total[i] + d, total[j] + d
    return min(range(len(readings)), key=lambda i: (round(total[i], 9), i))


def consensus(df: DataFrame, group: str, index: str, text: str, support: int = 2) -> DataFrame:
    """(group, text): the vote of each group's readings on its medoid. A group's readings are one row while they vote, and
    what aligns them for the medoid serves the vote. Groups are dealt over all partitions: they are small and take long."""

    def one(readings: list[str | None]) -> str:
        found: dict[tuple[str, str], list] = {}
        pivot = medoid_place(readings, found)
        return vote([r or "" for r in readings], pivot, support, found=found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(group), pa.array(map(one, batch.column("readings").to_pylist()), pa.string())], names=[group, text])

    kind = df.schema[group].dataType.simpleString()
    lists = spread(df.select(group, index, text), group).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t")))).alias("l"))
    return lists.select(group, F.transform("l", lambda x: x["t"]).alias("readings")).mapInArrow(run, f"{group} {kind}, {text} string")


def segments(lengths: list[int], most: int, extra: int = 32) -> list[int]:
    """A block number for each item: each counts `extra` besides its length, and a new block begins where the sum would exceed
    `most`."""
    out, block, total, begun = [], 0, 0, False
    for n in lengths:
        if begun and total + n + extra > most:
            block, total = block + 1, 0
        total, begun = total + n + extra, True
        out.append(block)
    return out


def balanced(sizes: list[int], workers: int) -> list[int]:
    """A worker for each item: the longest first, to the least loaded, the lower number of equals."""
    load, out = [0] * workers, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        w = min(range(workers), key=lambda w: (load[w], w))
        out[i] = w
        load[w] += sizes[i]
    return out


def richest(pages: list[tuple[int, int]], budget: int, bins: int = 12) -> list[int]:
    """Of (page, length) all pages if they fit in a budget of characters with their headers; else the first and last (an error if
    these do not fit), the longest of each temporal bin, then by length, as long as they fit; in order of pages."""
    pages = sorted(pages)
    header = [len(f"[page {page}]\n") for page, _ in pages]
    if not pages or sum(header) + sum(n for _, n in pages) + 2 * (len(pages) - 1) <= budget:
        return [page for page, _ in pages]
    cost = [h + n + 2 for h, (_, n) in zip(header, pages)]
    chosen = {0, len(pages) - 1}
    used = sum(cost[k] for k in chosen)
    if used > budget:
        raise ValueError("the first and the last page exceed the budget")
    count = min(max(1, bins), len(pages))
    of_bins = [max(range(b * len(pages) // count, (b + 1) * len(pages) // count), key=lambda k: pages[k][1]) for b in range(count)]
    rest = sorted(set(range(len(pages))) - set(of_bins), key=lambda k: (-pages[k][1], pages[k][0]))
    for k in [*of_bins, *rest]:
        if k not in chosen and used + cost[k] <= budget:
            chosen.add(k)
            used += cost[k]
    return [pages[k][0] for k in sorted(chosen)]
