"""Splitting whole texts into pre-tokens, many characters at a time.

The spans are those of the public pattern of the byte-level vocabularies:
contractions, then runs of letters, of numbers or of other signs with at most one space before them, then white space
of which the last character goes to what follows. Each rule becomes an operation on arrays of character classes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex

LETTER, NUMBER, SPACE, OTHER, EDGE = range(5)
#: Characters that are handled at once; a longer text is cut only where a pre-token must begin.
CHUNK = 1 << 18
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(1)
def char_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, everything):
            table[m.start() : m.end()] = kind
    return table


def pieces(text: str, limit: int = CHUNK) -> Iterator[str]:
    """The text in parts of about `limit` characters, each of which can be split on its own."""
    at = 0
    while len(text) - at > limit:
        cut = _SAFE_CUT.search(text, at + limit)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Spans:
    """Pre-tokens of several texts: `codes` has a number for each pre-token in order, `hashes` the hash of each number,
    `ends` for each text the count of pre-tokens up to its end."""

    def __init__(self, texts: list[str]):
        self.joined = "\0".join(texts) + "\0"
        cps = np.frombuffer(self.joined.encode("utf-32-le"), "<u4")
        kinds = char_classes()[cps]
        edges = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        kinds[edges] = EDGE
        begins = _begins(cps, kinds)
        at = np.flatnonzero(begins)
        upto = np.append(at[1:], len(cps))
        real = kinds[at] != EDGE
        self.ends = np.searchsorted(at[real], edges)
        at, upto = at[real], upto[real]
        self.codes, self.hashes = pd.factorize(_span_hashes(cps, at, upto))
        first = np.zeros(len(self.hashes), np.int64)
        first[self.codes[::-1]] = np.arange(len(self.codes))[::-1]
        self.at, self.upto = at[first], upto[first]

    def of(self, numbers: np.ndarray) -> list[str]:
        """The pre-tokens of some numbers."""
        return [self.joined[a:b] for a, b in zip(self.at[numbers].tolist(), self.upto[numbers].tolist())]


class Remembered:
    """Ids of at most `limit` pre-tokens by their hashes, in sorted arrays: a large table and one of the latest, which is
    added to it now and then. When the large one is full it goes, and the latest stay. Those of over LONGEST characters are not kept."""

    LONGEST = 64

    def __init__(self, limit: int):
        self.limit = limit
        self.tables = [_Table(), _Table()]

    def ids(self, spans: Spans, make: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each number of spans, one after the other, and how many each has; `make` gives the packed ids of unknown ones."""
        left, order, found = np.arange(len(spans.hashes)), [], []
        for table in self.tables:
            at = table.find(spans.hashes[left])
            order.append(left[at >= 0])
            found.append(table.take(at[at >= 0]))
            left = left[at < 0]
        made = make(spans.of(left)) if len(left) else []
        n = np.fromiter(map(len, made), np.int64, len(made)) >> 2
        order.append(left)
        found.append((np.frombuffer(b"".join(made), "<u4"), n))
        self._keep(spans, left, *found[-1])
        place = np.empty(len(spans.hashes), np.int64)
        place[np.concatenate(order)] = np.arange(len(place))
        return repeated(np.concatenate([ids for ids, _ in found]), np.concatenate([n for _, n in found]), place)

    def _keep(self, spans: Spans, numbers: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        short = spans.upto[numbers] - spans.at[numbers] <= self.LONGEST
        large, latest = self.tables
        latest = latest.with_more(spans.hashes[numbers[short]], ids[np.repeat(short, n)], n[short])
        if len(latest.hashes) > self.limit // 8:
            large, latest = (latest if len(large.hashes) + len(latest.hashes) > self.limit else large.with_more(latest.hashes, *latest.take(slice(None)))), _Table()
        self.tables = [large, latest]


class _Table:
    """Sorted hashes; the ids of each are n of `flat` from `begin`."""

    def __init__(self, hashes=np.zeros(0, np.uint64), begin=np.zeros(0, np.int64), n=np.zeros(0, np.int32), flat=np.zeros(0, "<u4")):
        self.hashes, self.begin, self.n, self.flat = hashes, begin, n, flat

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def take(self, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[at].astype(np.int64)
        return self.flat[_places(self.begin[at], n)], n

    def with_more(self, hashes: np.ndarray, ids: np.ndarray, n: np.ndarray) -> _Table:
        hashes = np.concatenate((self.hashes, hashes))
        begin = np.concatenate((self.begin, np.cumsum(n) - n + len(self.flat)))
        order = np.argsort(hashes, kind="stable")
        return _Table(hashes[order], begin[order], np.concatenate((self.n, n.astype(np.int32)))[order], np.concatenate((self.flat, ids)))


def _begins(cps: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    before = np.concatenate(([EDGE], kinds[:-1]))
    begins = kinds != before
    # the last white space before something else stands alone, or, if it is a blank, belongs to what follows
    follows = np.flatnonzero((before == SPACE) & (kinds != SPACE) & (kinds != EDGE))
    begins[follows - 1] = True
    begins[follows[cps[follows - 1] == 0x20]] = False
    # contractions: a quote that begins a pre-token, with certain small letters after it
    quotes = np.flatnonzero((cps[:-1] == 0x27) & begins[:-1] & (kinds[1:] == LETTER))
    if len(quotes):
        one = cps[quotes + 1]
        two = cps[np.minimum(quotes + 2, len(cps) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for cut, length in ((quotes[short], 2), (quotes[long], 3)):
            begins[cut + 1] = False
            after = cut + length
            begins[after[kinds[after] == LETTER]] = True
    return begins


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64)))) for x in (base, inverse))


def _span_hashes(cps: np.ndarray, at: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, all by one running sum."""
    up, down = _powers(1 << max(19, int(len(cps)).bit_length()))
    with np.errstate(over="ignore"):
        v = (cps.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(31)
        v *= np.uint64(0xC2B2AE3D27D4EB4F)
        v ^= v >> np.uint64(29)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v * up[: len(cps)])))
        h = (total[upto] - total[at]) * down[at]
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xFF51AFD7ED558CCD)


def in_chunks(texts: list[str]) -> Iterator[tuple[list[str], list[bool]]]:
    """Parts of texts, about CHUNK characters at a time, with whether each part is the last of its text."""
    parts, last, size = [], [], 0
    for text in texts:
        cut = list(pieces(text))
        for i, part in enumerate(cut):
            parts.append(part)
            last.append(i == len(cut) - 1)
            size += len(part)
            if size >= CHUNK:
                yield parts, last
                parts, last, size = [], [], 0
    if parts:
        yield parts, last


def _places(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n places from each begin on."""
    ends = np.cumsum(n)
    return np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def repeated(flat: np.ndarray, n: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Item i has n[i] ids, one item after the other in flat: the ids of the items of `codes` in that order, and how many each has."""
    many = n[codes]
    return flat[_places((np.cumsum(n) - n)[codes], many)], many


def encoded(texts: list[str], known: Remembered, make: Callable[[list[str]], list[bytes]]) -> Iterator[np.ndarray]:
    """The ids of each text; `make` gives the packed ids of pre-tokens that are not known."""
    held: list[np.ndarray] = []
    for parts, last in in_chunks(texts):
        spans = Spans(parts)
        ids, n = repeated(*known.ids(spans, make), spans.codes)
        upto = np.concatenate(([0], np.cumsum(n)))[spans.ends]
        for a, b, whole in zip(np.concatenate(([0], upto[:-1])).tolist(), upto.tolist(), last):
            held.append(ids[a:b])
            if whole:
                yield held[0] if len(held) == 1 else np.concatenate(held)
                held = []
