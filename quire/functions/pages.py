"""Judgements on scanned pages as columns: types, layouts, repetition, risks, which candidate to take.

The patterns and limits below are fixed values of the rules.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

TOC = r"目\s*次|もくじ"
SECTION = r"(?:序章|終章|プロローグ|エピローグ|あとがき|第[0-9一二三四五六七八九十百]+[章話節])"
NARRATIVE_START = r"^\s*(?:序章|終章|プロローグ|エピローグ|あとがき)"
COLOPHON = r"(?:ISBN|Copyright|©|発行所|発行者|発行日|出版社|編集部|印刷所|無断転載|電子書籍|奥付|定価|QRコード|ダウンロード|キャンペーン)"
SAMPLE = r"(?:電子(?:特別)?お試し版|電子(?:特別)?試し読み版|お試し読み版|試し読み版)"
AFTERWORD = r"(?:あとがき|後書き|奥付|発行所|発行者|発行日|ISBN|Copyright|©)"
LATER_SECTION = r"(?:序章|終章|プロローグ|エピローグ|第[0-9一二三四五六七八九十百]+[章話節])"
CONTENT = r"[\p{L}\p{N}_぀-ヿ㐀-鿿]"
NON_TEXT = ("picture", "image", "figure", "diagram")
STRUCTURED = ("table", "table-of-contents", "formula", "handwriting")
HONORIFIC_NAME = r"([㐀-鿿々〆ヵヶ]{2,8})(?:さん|様|殿|君|くん|ちゃん)"
KATAKANA = r"[ァ-ヴー]{4,}"
OVERLAY = "chatgpt"
OVERLAY_PAIRS = (("Kindleカタログ", "UI改善"), ("Kindleカタログ", "要件整理"))
PAGE_TYPES = ("unknown", "narrative", "toc", "illustration", "colophon_or_ad")


def compact(x: Column) -> Column:
    """Without white space of any kind; empty for null."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", "")


def _hits(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit("(?U)" + pattern))


def page_type(page: Column, pages: Column, text: Column, chars: Column) -> Column:
    """A page's type by its place, markers and length; `unknown` where a reviewer must decide."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    n = F.greatest(chars, F.length(compact(t)))
    front = page <= F.greatest(F.lit(12), F.floor(pages / 8))
    late = page >= F.greatest(F.lit(1), pages - F.greatest(F.lit(8), F.floor(pages / 10)))
    colophon = _hits(t, COLOPHON)
    return (
        F.when(front & (t.rlike("(?U)" + TOC) | (_hits(t, SECTION) >= 3)), "toc")
        .when((n >= 300) & t.rlike("(?U)" + NARRATIVE_START), "narrative")
        .when((colophon >= 2) | (late & (colophon >= 1) & (n < 1200)), "colophon_or_ad")
        .when((n < 30) | ((page <= 3) & (n < 200)), "illustration")
        .when(n >= 300, "narrative")
        .otherwise("unknown")
    )


def index_eligible(kind: Column) -> Column:
    """Whether pages of a type are searched; a type that is none is an error."""
    known = F.when(kind.isin(*PAGE_TYPES), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no page type: "), kind)).cast("boolean"))
    return known & (kind == "narrative")


def layout_type(html: Column, text: Column, chars: Column, kind: Column) -> Column:
    """A page's layout by the labels and boxes of its blocks."""
    html = F.coalesce(html, F.lit(""))
    labels = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)data-label=[\"']([^\"']+)[\"']"), F.lit(1)), lambda x: F.lower(F.trim(x)))
    boxes = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)data-bbox=[\"']([^\"']+)[\"']"), F.lit(1)), lambda b: F.transform(F.split(F.trim(b), r"\s+"), lambda x: x.try_cast("double")))
    wide = F.size(F.filter(boxes, lambda b: F.coalesce((F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull()) & (F.get(b, 2) - F.get(b, 0) >= 650), F.lit(False))))
    n = F.greatest(chars, F.length(compact(text)))
    has = lambda names: F.arrays_overlap(labels, F.array(*map(F.lit, names)))
    return (
        F.when((kind == "toc") | has(STRUCTURED), "structured")
        .when(kind.isin("illustration", "colophon_or_ad") & (n < 80), "image_only")
        .when(has(NON_TEXT) & (n >= 30), "mixed_illustration")
        .when((n >= 100) & (wide == 1), "full_width")
        .when(n >= 300, "normal_prose")
        .when(n < 30, "image_only")
        .otherwise("unknown")
    )


_NO_CONTENT = regex.compile("[^" + CONTENT[1:])
_NO_CONTENT_ASCII = bytes(i for i in range(128) if _NO_CONTENT.match(chr(i)))
_SPACES = regex.compile(r"\s+")
_SPACES_ASCII = bytes(i for i in range(128) if _SPACES.match(chr(i)))
GRAM, GRAM_TIMES = 12, 8


def _without(text: str, pattern: regex.Pattern, signs: bytes) -> str:
    """What a pattern leaves of a text; `signs` are the ASCII characters that it matches."""
    return text.encode().translate(None, signs).decode() if text.isascii() else pattern.sub("", text)


def _content(text: str) -> str:
    return _without(text, _NO_CONTENT, _NO_CONTENT_ASCII)


def repeats(text: str) -> bool:
    """Whether a line of ten content characters comes three times, one of forty twice, two neighbouring lines of forty
    together twice, or some twelve content characters eight times."""
    compacted = (_without(line, _SPACES, _SPACES_ASCII) for line in text.splitlines())
    lines = [x for x in compacted if len(x) >= 10 and len(_content(x)) >= 10]
    if any(n >= 3 or n == 2 and len(_content(x)) >= 40 for x, n in Counter(lines).items() if n > 1):
        return True
    if any(n > 1 and len(_content(x)) >= 40 for x, n in Counter(map("".join, zip(lines, lines[1:]))).items()):
        return True
    return _gram_repeats(_content(text))


def _gram_repeats(content: str) -> bool:
    """Whether some GRAM characters come GRAM_TIMES; hashes of all places are sorted, and only grams whose hash comes as often are counted."""
    places = len(content) - GRAM + 1
    if places < GRAM_TIMES:
        return False
    codes = np.frombuffer(content.encode("utf-32-le"), np.uint32).astype(np.uint64)
    hashes = np.zeros(places, np.uint64)
    for i in range(GRAM):
        hashes *= np.uint64(0x9E3779B97F4A7C15)
        hashes += codes[i : i + places]
    ordered = np.sort(hashes)
    often = ordered[GRAM_TIMES - 1 :][ordered[GRAM_TIMES - 1 :] == ordered[: 1 - GRAM_TIMES]]
    if not len(often):
        return False
    at = np.flatnonzero(np.isin(hashes, np.unique(often))).tolist()
    return max(Counter(content[i : i + GRAM] for i in at).values()) >= GRAM_TIMES


@F.arrow_udf(BooleanType())
def has_repetition(texts: pa.Array) -> pa.Array:
    """`repeats` of each text; false for null. Counting grams of long texts has no cheap form in columns."""
    return pa.array([repeats(t or "") for t in texts.to_pylist()], pa.bool_())


def more_complete(primary: Column, external: Column) -> Column:
    """Whether the other candidate keeps materially more text: 256 characters at least in the first, 30 more, and 2 per cent."""
    return _more_complete(compact(primary), compact(external))


def _more_complete(primary: Column, external: Column) -> Column:
    a, b = F.length(primary), F.length(external)
    return (a >= 256) & (b - a >= 30) & (b >= a * 1.02)


def repetition_fallback(primary: Column, external: Column, compacted: Column | None = None) -> Column:
    """Whether the other candidate can stand in for one that repeats itself. `compacted` is the other one's `compact`, if it is
    there already."""
    primary, external = (F.coalesce(x, F.lit("")) for x in (primary, external))
    return has_repetition(primary) & (F.length(compact(external) if compacted is None else compacted) >= 256) & ~has_repetition(external)


def terms(text: Column) -> Column:
    """Names before an honorific, and long katakana words."""
    return _terms(compact(text))


def _terms(t: Column) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(HONORIFIC_NAME), F.lit(1)), F.regexp_extract_all(t, F.lit(KATAKANA), F.lit(0))))


def one_letter_variant(a: Column, b: Column) -> Column:
    """Whether an item of one array only and one of the other only are of one length and differ in one place."""
    left, right = F.array_except(a, b), F.array_except(b, a)

    def apart(x: Column, y: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(1), F.length(x)), lambda i: F.substr(x, i, F.lit(1)) != F.substr(y, i, F.lit(1))))

    return F.exists(left, lambda x: F.exists(right, lambda y: (F.length(x) == F.length(y)) & (apart(x, y) == 1)))


def _overlay(t: Column) -> Column:
    has = lambda x: F.contains(t, F.lit(x))
    out = F.contains(F.lower(t), F.lit(OVERLAY))
    for a, b in OVERLAY_PAIRS:
        out = out | (has(a) & has(b))
    return out


def risk_flags(kind: Column, text: Column, chars: Column, primary: Column, external: Column, compacted: tuple[Column, Column, Column] | None = None) -> Column:
    """Reasons for a review of a page, in the order of their names. `compacted` has `compact` of text, primary and external if
    they are there already, for long texts: each is read by several rules."""
    text, primary, external = (F.coalesce(x, F.lit("")) for x in (text, primary, external))
    t, p, e = compacted or map(compact, (text, primary, external))
    n = F.greatest(chars, F.length(t))
    most = F.greatest(F.length(p), F.length(e))
    told = (kind == "narrative") & (p != "") & (e != "")
    flags = {
        "candidate_content_conflict": (n < 30) & (most >= 300),
        "external_text_repetition": has_repetition(external),
        "named_entity_candidate_disagreement": told & one_letter_variant(_terms(p), _terms(e)),
        "page_type_text_conflict": (kind != "narrative") & (F.greatest(n, most) >= 300),
        "primary_text_repetition": has_repetition(primary),
        "selected_text_repetition": has_repetition(text),
        "ui_overlay_text_detected": _overlay(p) | _overlay(e) | _overlay(t),
        "unselected_external_candidate_more_complete": told & (t != e) & _more_complete(p, e),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in flags.items()]))


def selected_text(engine: Column, primary: Column, external: Column, corrected: Column, primary_name: str = "primary", external_name: str = "external") -> Column:
    """The text of the engine that was chosen; the corrected one for any other name."""
    return F.when(engine == primary_name, primary).when(engine == external_name, external).otherwise(corrected)
