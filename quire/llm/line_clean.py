"""Quality rules that look at lines first.

Each line with a word is held against rules of punctuation, navigation and boilerplate. Lines that fail are
removed, and a document that loses too much of its text with them is rejected, as is one that fails the base rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quire.llm.workspace import schema_with, slices, with_columns

MIN_WORDS = 50
#: Per cent of the words that may lie in repeated windows of three words.
MAX_REPEAT = 50
#: Per cent of the characters of words that may go with removed lines.
MAX_LOST = 50
SYMBOLS = "#*$%&|<>"
#: A longer line is no notice, whatever phrase is in it.
NOTICE_WORDS = 25
REMEMBERED = 150_000

#: What a line of prose may end with.
TERMINAL = re.compile(r"""[.!?;:…。！？]["'”’»)\]]*[\x20\x09-\x0D]*\Z""")
#: Signs that part the entries of a menu.
SEPARATORS = frozenset("| · • » › > → /".encode().split())
#: Notices and page furniture that are not a document's own text.
BOILERPLATE = re.compile(
    r"all rights reserved|licen[sc]ed under|released under|terms of (?:use|service)|privacy policy|cookie policy|"
    r"(?:uses?|accept|enable) cookies|enable javascript|click here|subscribe to|sign up for|log ?in to|powered by|lorem ipsum"
)

COLUMNS = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "base_failed": "boolean",
    "kept": "boolean",
    "lost_chars": "long",
    "n_lines_removed": "long",
    "clean_text": "string",
}


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _chars(words: list[bytes]) -> int:
    return len(b"".join(words).decode())


def line_fails(line: str, words: list[bytes]) -> bool:
    """Whether a line with these words breaks a rule."""
    n = len(words)
    if not TERMINAL.search(line):  # punctuation: it ends like no sentence
        return True
    if 2 * sum(map(line.count, SYMBOLS)) > n:  # punctuation: signs rather than words
        return True
    if 4 * sum(w in SEPARATORS for w in words) >= n:  # navigation: a menu
        return True
    if n >= 5 and line == line.upper() and line != line.lower():  # boilerplate: a banner in capitals
        return True
    if n >= 4 and 2 * sum(a == b for a, b in zip(words, words[1:])) > n:  # boilerplate: one word over and over
        return True
    return n <= NOTICE_WORDS and bool(BOILERPLATE.search(line.lower()))


def repeated_words(words: list[bytes], known: dict) -> int:
    """Words inside windows of three words that occur twice or more in the text."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        w = h[:-2] * np.uint64(0x9E3779B97F4A7C15)
        w = ((w ^ (w >> np.uint64(29))) + h[1:-1]) * np.uint64(0xD6E8FEB86659FD93)
        w = ((w ^ (w >> np.uint64(31))) + h[2:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        w ^= w >> np.uint64(32)
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h), bool)
    for i in range(3):
        cover[i : i + len(w)] |= twice
    return int(cover.sum())


def examine(text: str | None, known: dict) -> dict:
    """The columns of one text."""
    text = text or ""
    words: list[bytes] = []
    kept, seen = [], set()
    n_dup = lost = removed = 0
    for line in text.split("\n"):
        own = line.encode("utf-8", "surrogatepass").split()
        if not own:
            kept.append(line)
            continue
        words += own
        again = line in seen
        seen.add(line)
        n_dup += again
        if again or line_fails(line, own):
            lost += _chars(own)
            removed += 1
        else:
            kept.append(line)
    chars = _chars(words)
    repeat = repeated_words(words, known)
    failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT * len(words)
    return {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": n_dup,
        "n_repeat_words": repeat,
        "base_failed": failed,
        "kept": not failed and 100 * lost <= MAX_LOST * chars,
        "lost_chars": lost,
        "n_lines_removed": removed,
        "clean_text": "\n".join(kept),
    }


def clean_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts, base_failed, kept, lost_chars, n_lines_removed and clean_text to every row, in place of columns of
    these names.

    Words are runs of other than ASCII white space; a line is what "\\n" parts, and one without words is no line to the
    rules. A line equal to an earlier one of its text fails. A null text counts as empty and is rejected for its length.
    Texts of any length are read whole. Rows do not affect each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in slices(batches, text):
            found = [examine(t, known) for t in batch.column(text).to_pylist()]
            kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
            yield with_columns(batch, {c: pa.array([x[c] for x in found], kinds[k]) for c, k in COLUMNS.items()})

    return df.mapInArrow(run, schema_with(df, COLUMNS))
