"""Fill-in-the-middle rows: a text is cut in three at token bounds, and its middle is moved to the end.

A token is a run of ASCII letters or one other character. The work is done on whole numbers with one bit for each byte of
a text, the first byte the highest bit: `bytes.translate` gives the bits of two classes, a shift and a few boolean operations
mark where tokens begin, `bit_count` counts them, and the byte at which the k-th begins is found by halving the number and
counting the bits of one half.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.workspace import schema_with, slices, with_columns

#: The marks before a prefix, a suffix and a middle. Fixed values.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_LETTERS = bytes(48 + (65 <= b <= 90 or 97 <= b <= 122) for b in range(256))
_FIRST_BYTES = bytes(48 + (b & 0xC0 != 0x80) for b in range(256))


def marks(text: bytes) -> tuple[int, int]:
    """Two numbers of len(text) bits: where characters begin, and where tokens begin."""
    if not text:
        return 0, 0
    letters, chars = int(text.translate(_LETTERS), 2), int(text.translate(_FIRST_BYTES), 2)
    return chars, chars & ~(letters & letters >> 1)


def select(bits: int, width: int, k: int) -> int:
    """How many bits come before the k-th one, from 0, of the highest `width` bits; width if there are no more than k."""
    if k >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        low = width // 2
        high = bits >> low
        ones = high.bit_count()
        if k < ones:
            bits, width = high, width - low
        else:
            bits, k, at, width = bits & (1 << low) - 1, k - ones, at + width - low, low
    return at


def draws(seed: int, key) -> list[int]:
    """Four 32-bit numbers that depend on the seed and the row's id alone; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def transform(text: bytes, key, seed: int, fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    chars, tokens = marks(text)
    n = tokens.bit_count()
    one, two, three, four = draws(seed, key)
    if not text or three % 100 >= fim_percent or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (select(tokens, len(text), k) for k in sorted((one % (n + 1), two % (n + 1))))
    before_a, before_b = ((chars >> len(text) - x).bit_count() for x in (a, b))
    prefix, middle, suffix = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
    spm = four % 100 < spm_percent
    return n, "spm" if spm else "psm", before_a, before_b - before_a, (suffix + prefix if spm else prefix + suffix) + middle


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """Rows of df with n (the tokens of the text), form (`plain`, `psm` or `spm`), prefix_chars, middle_chars (null where
    plain) and output, in place of columns of these names.

    The cuts and the form depend on seed and id alone, so a row gives the same in every run, and rows that repeat are
    alike. A null text is empty; an empty one, and one that has a mark itself, is left plain. Every row is one of its own: no
    shuffle, and a task holds one text of any length with a few bits for each of its bytes.
    """
    new = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            rows = [transform(t or b"", i, seed, fim_percent, spm_percent) for i, t in zip(batch.column(id_col).to_pylist(), texts)]
            n, form, prefix, middle, output = zip(*rows)
            counts = {k: pa.array(v, pa.int64()) for k, v in (("n", n), ("prefix_chars", prefix), ("middle_chars", middle))}
            yield with_columns(batch, counts | {"form": pa.array(form), "output": pa.array(output, pa.binary()).cast(pa.string())}).select(names)

    schema = schema_with(df, new)
    names = [c for c in df.columns if c not in new] + list(new)
    return df.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of. A text that is not plain has no mark, so the marks of its output are the only ones."""
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
