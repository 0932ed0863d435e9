"""Text, number and time functions as column expressions."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode compatibility normal form, which Spark has no function for."""
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def casefold(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.casefold() for t in texts.to_pylist()], pa.string())


def squeezed(x: Column) -> Column:
    """Runs of any white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def name_key(x: Column) -> Column:
    return squeezed(casefold(nfkc(x)))


# Patterns of titles. Fixed values.
PREFIX_LABEL = r"^\s*[【\[][^】\]]{1,40}[】\]]\s*"
INLINE_LABEL = r"【[^】]{1,40}】"
SLASH_NOTE = r"[／/][^／/【\[（(]{1,20}(?:付き?|つき|込み)\s*$"
END_LABEL = r"[（(][^）)]{1,30}[）)]\s*$"
VOLUME_ENDS = (
    r"\s*第?\s*\d{1,3}\s*巻\s*$",
    r"\s*[（(]\s*\d{1,3}\s*[）)]\s*$",
    r"\s+[Vv][Oo][Ll]\.?\s*\d{1,3}\s*$",
    r"\s+[Nn][Oo]\.?\s*\d{1,3}\s*$",
    r"\s+\d{1,3}\s*$",
    r"\s*[:：]\s*\d{1,3}\s*$",
)
END_SIGN = r"[ 　]*[:：\-－—]\s*$"
SERIES_VOLUME = r"[\s 　_\-]*(?:第?\s*\d+(?:\.\d+)?\s*巻?|第?[一二三四五六七八九十百]+巻?|[vV][oO][lL]\.?\s*\d+(?:\.\d+)?|[(（][上中下前後]+[)）])?[\s 　巻]*$"
LAST_NUMBER = r"(?:^|[\s　])(\d+)\s*$"
INNER_NUMBER = r"第?\s*(\d+)\s*巻|[\s　](\d+)(?:\s*$|\s+[(（])"


def stripped(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _cut(x: Column, pattern: str, by: str = "") -> Column:
    return stripped(F.regexp_replace(x, "(?U)" + pattern, by))


def title_key(title: Column) -> Column:
    """A title for comparisons: normalised, without a leading label, inline labels, a note after a slash, a label at the end,
    volume markers (three passes over the patterns) and a sign at the end; null counts as empty. What would be empty stays as it was before the volume was cut."""
    x = F.regexp_replace(stripped(nfkc(F.coalesce(title, F.lit("")))), "(?U)" + PREFIX_LABEL, "")
    x = _cut(F.regexp_replace(x, INLINE_LABEL, " "), SLASH_NOTE)
    x = stripped(F.regexp_replace(x, r"[ \t]+", " "))
    base = _cut(x, END_LABEL)
    for _ in range(3):
        for pattern in VOLUME_ENDS:
            base = _cut(base, pattern)
    base = _cut(base, END_SIGN)
    return F.when(base == "", x).otherwise(base)


def without_volume(title: Column) -> Column:
    """A series title without what numbers a volume at its end."""
    return _cut(stripped(title), SERIES_VOLUME)


def publisher(title: Column) -> Column:
    """The bracketed text a title ends with; empty if none."""
    return stripped(F.regexp_extract(title, r"(?U)\s*\(([^)]+)\)\s*$", 1))


def without_publisher(title: Column) -> Column:
    return _cut(title, r"\s*\([^)]+\)\s*$")


def volume(title: Column) -> Column:
    """The number a title ends with, else the first that a counter, the end or a bracket follows; null if none."""
    found = [F.nullif(F.regexp_extract(title, "(?U)" + p, g), F.lit("")) for p, g in ((LAST_NUMBER, 1), (INNER_NUMBER, 1), (INNER_NUMBER, 2))]
    return F.coalesce(*found).cast("int")


def without_number(title: Column) -> Column:
    """The title without the number that `volume` finds."""
    def without(p: str) -> Column:
        found = F.regexp_substr(title, F.lit(p))
        return stripped(F.concat(F.split_part(title, found, F.lit(1)), F.substr(title, F.regexp_instr(title, F.lit(p)) + F.length(found))))

    last, inner = "(?U)" + LAST_NUMBER, "(?U)" + INNER_NUMBER
    return F.when(title.rlike(last), _cut(title, LAST_NUMBER)).when(title.rlike(inner), without(inner)).otherwise(stripped(title))


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two strings have in common at their beginnings."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)))


def authors_of(note: Column) -> Column:
    """Authors in an order's note: without the edition in front and the seller behind, split at commas of both kinds."""
    return split_list(F.regexp_replace(F.regexp_replace(note, r"(?Ui)^\[Kindle\s*版\]\s*", ""), r"(?U)\s+販売:.*$", ""), "[,、]")


def split_list(x: Column, pattern: str = r"[,、，]") -> Column:
    """Parts between commas of either kind, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(x, pattern), squeezed), lambda p: p != "")


def author_set_key(authors: Column) -> Column:
    """Sorted, trimmed, each once."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(authors, lambda a: F.trim(a)), lambda a: a != ""))), "\n")


def author_list_key(authors: Column) -> Column:
    """Sorted as they are: neither trimmed nor made distinct, as the client groups them."""
    return F.array_join(F.array_sort(authors), "\n")


def stable_id(prefix: str, authors: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\0", F.lit(prefix), authors)), 1, 12)


#: What stands for no value. Fixed values.
PLACEHOLDERS = ("", "not applicable", "not available")


def cleaned(x: Column) -> Column:
    """A text without white space at its ends; null for what stands for no value."""
    t = stripped(x)
    return F.when(~F.lower(t).isin(*PLACEHOLDERS), t)


def money(x: Column) -> Column:
    """A whole amount from text with currency signs and separators; null where there is no digit, sign or point; text that has
    some but is no number is an error."""
    number = F.regexp_replace(cleaned(x), r"[^\d.\-]", "")
    parsed = number.try_cast("decimal(38,8)").cast("long")
    bad = F.raise_error(F.concat(F.lit("no amount: "), x)).cast("long")
    return F.when(F.coalesce(number, F.lit("")) == "", F.lit(None)).when(parsed.isNotNull(), parsed).otherwise(bad)


def iso_text(x: Column) -> Column:
    """A time in ISO form with `T` and an offset for `Z`; what is no time stays as it is, placeholders are null."""
    t = F.replace(cleaned(x), F.lit("Z"), F.lit("+00:00"))
    time = F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)", "$1T$2")
    whole = F.regexp_replace(F.regexp_replace(time, r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00"), r"(T\d{2}:\d{2})(?=$|[+\-])", "$1:00")
    valid = whole.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3}(?:\d{3})?)?(?:[+\-]\d{2}:\d{2})?$") & F.try_to_timestamp(whole).isNotNull()
    return F.when(valid, whole).otherwise(cleaned(x))


def date_prefix(x: Column) -> Column:
    """The first ten characters; an empty text is an error."""
    return F.when(cleaned(x).isNotNull(), F.substring(cleaned(x), 1, 10)).otherwise(F.raise_error(F.lit("a date is empty")).cast("string"))


def iso_time(x: Column) -> Column:
    """A time from ISO text; without a zone it is at +09:00; null where it cannot be read."""
    zoned = x.rlike(r"(?:[zZ]|[+\-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(zoned, F.regexp_replace(x, " ", "T")).otherwise(F.concat(F.regexp_replace(F.trim(x), " ", "T"), F.lit("+09:00"))))


def item_id(url: Column) -> Column:
    """The upper-case item id of a product address (https, an allowed host, no port); anything else is an error."""
    found = F.upper(F.regexp_extract(url, r"(?i)^https://(?:www\.)?amazon\.co\.jp(?:/[^?#]*)?/(?:dp|gp/product)/(B[A-Z0-9]{9})(?:[/?#]|$)", 1))
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no product address: "), url)).cast("string"))


def observation_status(price: Column, points: Column, list_price: Column, source: Column) -> Column:
    """ok with all four and a positive list price, partial with some of the numbers, else failed."""
    complete = price.isNotNull() & points.isNotNull() & (list_price > 0) & source.isNotNull()
    return F.when(F.coalesce(complete, F.lit(False)), "ok").when(F.coalesce(price, points, list_price).isNotNull(), "partial").otherwise("failed")


def artist_key(name: Column) -> Column:
    """A display name as a part of an address: lower case, `_` for a blank, percent-encoded."""
    return percent_encoded(F.replace(F.lower(stripped(name)), F.lit(" "), F.lit("_")))


def index_name(key: Column, language: str) -> Column:
    return F.concat(percent_encoded(F.replace(key, F.lit("_"), F.lit(" "))), F.lit(f"-{language}.nozomi"))


def price_message(title: Column, item: Column, url: Column, price: Column, points: Column, effective: Column, list_price: Column, source: Column, ratio: Column, previous: Column, kinds: Column) -> Column:
    """What a subscriber is told of a price change. The words are fixed values."""
    number = lambda x: F.regexp_replace(F.format_number(x, 0), r"\.$", "")
    yen = lambda x: F.when(x.isNull(), "不明").otherwise(F.concat(F.lit("￥"), number(x)))
    drop = F.when(previous.isNotNull() & effective.isNotNull(), F.concat(F.lit("実質価格の値下がり（"), yen(previous), F.lit(" → "), yen(effective), F.lit("）"))).otherwise("値下がり")
    reasons = F.array_compact(F.array(F.when(F.array_contains(kinds, "price_drop"), drop), F.when(F.array_contains(kinds, "below_threshold"), F.lit("設定した定価比を下回りました"))))
    label = F.when(source == "kindle", "Kindle定価/参考価格").when(source == "paper", "紙版定価").otherwise("定価/参考価格")
    lines = (
        F.concat(F.lit("📚 Kindle価格監視: "), F.coalesce(title, item, F.lit("Kindle 本"))),
        F.concat(F.lit("現在価格: "), yen(price)),
        F.concat(F.lit("付与ポイント: "), F.when(points.isNull(), "不明").otherwise(F.concat(number(points), F.lit(" pt")))),
        F.concat(F.lit("実質価格: "), yen(effective)),
        F.concat(label, F.lit(": "), yen(list_price)),
        F.concat(F.lit("定価比: "), F.when(ratio.isNull(), "不明").otherwise(F.concat(F.format_string("%.1f", ratio), F.lit("%")))),
        F.concat(F.lit("理由: "), F.array_join(reasons, " / ")),
        url,
    )
    return F.concat_ws("\n", *lines)


def effective_price(price: Column, points: Column) -> Column:
    """The price less points, 0 at least; null if either is null or the points exceed the price."""
    return F.when(points <= price, F.greatest(price - points, F.lit(0)))


def ratio_percent(effective: Column, list_price: Column, status: Column) -> Column:
    return F.when((status == "ok") & (list_price > 0), F.try_divide(effective * 100.0, list_price))


def percent_encoded(x: Column) -> Column:
    """URL-encoded, with %20 for a blank."""
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


def escaped(x: Column) -> Column:
    """The five characters of HTML escaped; only mark tags are left as they are."""
    out = x
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"&lt;(/?)mark&gt;", "<$1mark>")


def without_marks(x: Column) -> Column:
    return F.regexp_replace(x, "</?mark>", "")


def image_name(name: Column, page: Column) -> Column:
    """An image's name by its book's, percent-encoded, and page."""
    return F.concat(percent_encoded(name), F.lit("_p"), F.lpad(page.cast("string"), 3, "0"), F.lit(".png"))


def preview(x: Column, n: int = 120) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("…"))).otherwise(x)


def natural_key(x: Column, digits: int = 20) -> Column:
    """A sort key in which runs of digits compare as numbers: each is padded to `digits` places."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), digits, "0")).otherwise(p)), "")


def safe_path(x: Column) -> Column:
    """Whether a relative path stays where it is: no parent parts, no root, no drive, no NUL."""
    p = F.translate(x, "\\", "/")
    return ~(p.rlike(r"(?:^|/)\.\.(?:/|$)") | p.rlike(r"^/|^[A-Za-z]:") | F.contains(p, F.lit("\0")))


def kanji_number(x: Column) -> Column:
    """Numerals from one to ninety-nine; null for anything else."""
    ones = {c: i for i, c in enumerate("一二三四五六七八九", 1)}
    table = F.create_map(*[F.lit(v) for pair in ones.items() for v in pair])
    tens, unit = F.regexp_extract(x, r"^([一二三四五六七八九]?)十", 1), F.regexp_extract(x, r"([一二三四五六七八九])$", 1)
    whole = x.rlike(r"^(?:[一二三四五六七八九]?十[一二三四五六七八九]?|[一二三四五六七八九])$")
    ten = F.when(F.contains(x, F.lit("十")), F.coalesce(F.try_element_at(table, tens), F.lit(1)) * 10).otherwise(0)
    return F.when(whole, ten + F.coalesce(F.try_element_at(table, unit), F.lit(0)))


def metric_text(x: Column) -> Column:
    """Text for error rates: normal form, one kind of dash and of ellipsis, no white space."""
    return F.regexp_replace(F.replace(F.regexp_replace(nfkc(x), "[‐‑‒–—―−]", "-"), F.lit("..."), F.lit("…")), r"(?U)\s+", "")


def metric_text_simple(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+", "")


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance by characters of the reference; null for an empty one."""
    return F.try_divide(F.levenshtein(reference, hypothesis).cast("double"), F.length(reference).cast("double"))


def valid_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    inside = lambda a, b: (a >= 0) & (a < b) & (b <= 1000)
    return F.coalesce(inside(x0, x1) & inside(y0, y1), F.lit(False))


def bigram_overlap(a: Column, b: Column) -> Column:
    """Distinct pairs of neighbouring characters that both have, after punctuation and white space are gone; null where a text is."""
    return _shared_pairs(*[F.regexp_replace(x, r"(?U)[\p{P}\s]+", "") for x in (a, b)])


def _pairs(text: str) -> np.ndarray:
    """The distinct pairs of neighbouring characters as numbers, in order."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    pairs = np.sort(codes[:-1] << 21 | codes[1:])
    return pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] if len(pairs) else pairs


@F.arrow_udf(IntegerType())
def _shared_pairs(a: pa.Array, b: pa.Array) -> pa.Array:
    """A text that comes in rows one after another, as one side of a join does, is taken apart once."""
    last, mine, out = None, None, []
    for x, y in zip(a, b):
        x, y = x.as_py(), y.as_py()
        if x is None or y is None:
            out.append(None)
            continue
        if x != last:
            last, mine = x, _pairs(x)
        theirs = _pairs(y)
        at = np.searchsorted(mine, theirs)
        out.append(int((mine[np.minimum(at, len(mine) - 1)] == theirs).sum()) if len(mine) else 0)
    return pa.array(out, pa.int32())


# Signs that count as punctuation, and small kana. Fixed values.
PUNCTUATION = "、。・！？!?…‥「」『』（）()【】〈〉《》ー―—〜～：；:;,.\"'“”‘’"
SMALL_KANA = "ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮヵヶ"


def character_category(c: Column) -> Column:
    """Of one character: small kana, punctuation, kanji, kana, ascii letter or digit, other; empty for none."""
    return (
        F.when(c == "", "empty")
        .when(F.contains(F.lit(SMALL_KANA), c), "small_kana")
        .when(F.contains(F.lit(PUNCTUATION), c) | c.rlike(r"^\p{P}$"), "punctuation")
        .when(c.rlike(r"^[\u4e00-\u9fff\u3400-\u4dbf]$"), "kanji")
        .when(c.rlike(r"^[\u3040-\u30ff]$"), "kana")
        .when(c.rlike(r"^[A-Za-z0-9]$"), "ascii_or_digit")
        .otherwise("other")
    )


def expansion_line(x: Column, most: int = 60) -> Column:
    """A line of a model's list without numbering, bullets, labels and quotes; null if it is empty or too long."""
    t = F.regexp_replace(x, r"^\s*(?:\d+[.)、]|[-*・•])?\s*(?:[Qq]uery|クエリ|検索語)?\s*[:：]?\s*", "")
    t = F.trim(F.regexp_replace(t, "^[\"'「『“]+|[\"'」』”]+$", ""))
    return F.when((F.length(t) > 0) & (F.length(t) <= most), t)


def content_digest(df_columns: list[str]) -> Column:
    """A digest of a row's fields, each with its length before it, so that no two rows can run together."""
    return F.sha2(F.concat(*[F.concat(F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df_columns]), 256)
