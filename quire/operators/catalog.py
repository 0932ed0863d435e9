"""Imports and listings of the catalog: first rows, merges that only move forward, filters, orders, renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import cleaned, natural_key

# Words in genres and titles that tell a book's type, in this order. Fixed values.
LIGHT_NOVEL = ("ライトノベル", "ラノベ")
COMIC = ("コミック", "マンガ", "漫画")
COMIC_TITLE = r"(?i)第\s*\d+(?:[〜～~]\s*\d+)?\s*[話巻冊集]|コミック第\s*\d+|vol\.\s*\d+"


def first_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order; a partial minimum, so a key with many rows meets once from each task."""
    rest = [c for c in df.columns if c not in key]
    got = df.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__r"))
    return got.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def order_lookup(df: DataFrame, key: list[str], order: list[str], title: str, kind: str, skipped: tuple[str, ...]) -> DataFrame:
    """Order lines as a lookup: without kinds that are no books and titles that say nothing, the first of each key."""
    return first_rows(df.filter(~F.col(kind).isin(*skipped) & cleaned(F.col(title)).isNotNull()), key, order)


def fresh_rows(batch: DataFrame, stored: DataFrame, key: list[str], order: list[str], wanted: Column | None = None) -> DataFrame:
    """Rows of a batch whose key is not stored yet, the first of each; `wanted` is the rows that count at all."""
    rows = batch if wanted is None else batch.filter(F.coalesce(wanted, F.lit(True)))
    return first_rows(rows, key, order).join(stored.select(*key), key, "left_anti")


def sums(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Sums of what can be read as a number; a key with nothing readable has 0."""
    return df.groupBy(key).agg(F.coalesce(F.sum(F.col(value).try_cast("long")), F.lit(0)).alias(name))


def newest(known: DataFrame, seen: DataFrame, key: str, at: str) -> DataFrame:
    """A table of times after an update that only moves forward; keys that are not known are left out."""
    latest = seen.groupBy(key).agg(F.max(at).alias("__at"))
    return known.join(latest, key, "left").withColumn(at, F.greatest(at, "__at")).drop("__at")


def book_type(genres: Column, title: Column, novel: tuple[str, ...], other: tuple[str, ...], light_novel: tuple[str, ...] = LIGHT_NOVEL, comic: tuple[str, ...] = COMIC) -> Column:
    """A book's type by its genres, else comic by its title, else null."""
    g = F.array_join(genres, " ")
    some = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(g, w))
    return F.when(some(light_novel), "novel").when(some(comic), "comic").when(some(novel), "novel").when(some(other), "other").when(title.rlike(COMIC_TITLE), "comic")


def filled_union(base: DataFrame, later: DataFrame, key: str, order: str, fill: str) -> DataFrame:
    """Rows of two sources by key: the first of each, where one column is filled from the later source if it is empty."""
    first = first_rows(base, [key], [order]).withColumn("__base", F.lit(True))
    other = first_rows(later, [key], [order]).select(key, F.struct(*[c for c in base.columns if c != key]).alias("__l"))
    both = first.join(other, key, "full")
    values = [F.when(F.col("__base"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__l.{c}")) if c == fill else F.col(c)).otherwise(F.col(f"__l.{c}")).alias(c) for c in base.columns if c != key]
    return both.select(key, *values)


def library(df: DataFrame, trash: bool = False, text: str | None = None, author: str | None = None, series: str | None = None, state: str | None = None, genre: str | None = None) -> DataFrame:
    """A listing's rows: hidden ones only in the trash, then by text in the name or an author, author, series, state and genre."""
    out = df.filter(F.coalesce("hidden", F.lit(False)) == trash)
    if text:
        low = text.lower()
        out = out.filter(F.contains(F.lower("name"), F.lit(low)) | F.exists("authors", lambda a: F.contains(F.lower(a), F.lit(low))))
    if author:
        out = out.filter(F.array_contains("authors", author))
    for column, value in (("series", series), ("state", state), ("genre", genre)):
        out = out.filter(F.col(column) == value) if value else out
    return out


def library_order(by: str, favourite: Column, name: Column, added: Column, views: Column, viewed: Column) -> list[Column]:
    """Sort columns of a listing."""
    key = natural_key(name)
    return {
        "favourite": [favourite.desc(), key.asc()],
        "name": [key.asc()],
        "name_desc": [key.desc()],
        "added": [F.coalesce(added, F.lit(0)).asc(), key.asc()],
        "added_desc": [F.coalesce(added, F.lit(0)).desc(), key.asc()],
        "views": [F.coalesce(views, F.lit(0)).desc(), key.asc()],
        "viewed": [viewed.desc_nulls_last(), key.asc()],
    }[by]


def grouped(df: DataFrame, group: Column, index: list[Column], name: str) -> DataFrame:
    """Rows with `place`, their place in their group by an index, those without one last."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.coalesce(*index).asc_nulls_last(), name)))


def renumbered(df: DataFrame, wanted: DataFrame, series: str, key: str, index: str) -> DataFrame:
    """Series with the index 1.0, 2.0, ... in a wanted order (series, key, ordinal); an item that is not in its series is an
    error."""
    place = F.row_number().over(Window.partitionBy(series).orderBy("ordinal")).cast("double")
    new = wanted.select(series, key, place.alias("__i"))
    foreign = new.join(df.select(series, key), [series, key], "left_anti")
    checked = new.join(foreign.select(series, key, F.lit(True).alias("__bad")), [series, key], "left")
    checked = checked.filter(F.when(F.col("__bad"), F.raise_error(F.lit("an item is not of the series")).cast("boolean")).otherwise(F.lit(True)))
    return df.join(checked.drop("__bad"), [series, key], "left").withColumn(index, F.coalesce("__i", index)).drop("__i")


def moved(df: DataFrame, group: str, place: str, moving: Column, target: Column) -> DataFrame:
    """Places after some rows of a group were moved together before the row at a target place; the others keep their order."""
    order = [F.when(moving, F.struct(target.cast("double") - 0.5, F.col(place).cast("double"))).otherwise(F.struct(F.col(place).cast("double"), F.lit(0.0)))]
    return df.withColumn("new_place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def inbox(df: DataFrame, read: Column, which: str = "all") -> DataFrame:
    """Rows of a status, each with the counts of all, unread and read ones."""
    counts = df.agg(F.count("*").alias("total"), F.count_if(~read).alias("unread_count"), F.count_if(read).alias("read_count"))
    return df.filter({"all": F.lit(True), "read": read, "unread": ~read}[which]).crossJoin(counts)


def series_suggestions(selected: DataFrame, known: DataFrame, least: float = 0.4, most: int = 5) -> DataFrame:
    """(selection, series, score): for titles (selection, title, author_key) the series (series, title, author_key) whose title
    begins alike: the mean share of the common prefix in the longer title, 0.2 more if all author keys agree, 1 at most.

    A series is a candidate only if it shares a first character with a title. Titles are not held against titles: those of a
    selection are counted by their prefixes and lengths, and a title of a series meets these counts by its own prefixes. The
    sum of the lengths of common prefixes is the sum of the counts of all prefixes in common."""
    prefixes = lambda t: F.explode(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substr(t, F.lit(1), i))).alias("p")
    n = selected.groupBy("selection").agg(F.count("*").alias("n"))
    a = selected.filter("length(title) > 0").groupBy("selection", F.col("title").alias("t"), F.col("author_key").alias("k")).agg(F.count("*").alias("times"))
    b = known.filter("length(title) > 0").groupBy("series", F.col("title").alias("s"), F.col("author_key").alias("j")).agg(F.count("*").alias("of_series"))
    begins = a.select("selection", F.length("t").alias("lt"), prefixes(F.col("t")), "times").groupBy("p", "selection", "lt").agg(F.sum("times").alias("times"))
    titles = b.select("s").distinct()
    common = titles.select("s", prefixes(F.col("s"))).join(begins, "p").groupBy("s", "selection", "lt").agg(F.sum("times").alias("chars"))
    totals = common.groupBy("s", "selection").agg(F.sum(F.col("chars") / F.greatest(F.length("s"), "lt")).alias("total"))
    # how many titles of a selection have a first character, and the author key of all of them if there is one
    keys = a.groupBy("selection", F.substring("t", 1, 1).alias("c")).agg(F.sum("times").alias("met"), F.min("k").alias("k"), (F.min("k") == F.max("k")).alias("one"), F.count_if(F.col("k").isNull()).alias("nulls"))
    agree = F.when(F.col("j").isNull(), F.col("one").isNull()).otherwise((F.col("nulls") == 0) & F.coalesce("one", F.lit(False)) & F.coalesce(F.col("k") == F.col("j"), F.lit(False)))
    pairs = b.join(totals, "s").join(keys.withColumnRenamed("selection", "__u"), (F.col("selection") == F.col("__u")) & (F.substring("s", 1, 1) == F.col("c")))
    met = pairs.groupBy("selection", "series").agg(F.sum(F.col("total") * F.col("of_series")).alias("total"), F.sum(F.col("met") * F.col("of_series")).alias("met"), F.bool_and(agree).alias("same")).join(n, "selection")
    score = F.round(F.least(F.lit(1.0), F.col("total") / F.col("n") + F.when(F.col("same") & (F.col("met") == F.col("n")), 0.2).otherwise(0.0)), 4)
    scored = met.select("selection", "series", score.alias("score")).filter(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("selection").orderBy(F.desc("score"), "series"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most)
