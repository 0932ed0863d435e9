"""Small selections over the library's records: what is ready, eligible, pending, or belongs to a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A chunk of a shorter page, or so near to the ends of its book, gets no context. Fixed values.
LEAST_BODY, MARGIN = 300, 5
HISTORY = 500


def ready(books: DataFrame, name: str, indexed_at: str, wanted: DataFrame | None = None) -> DataFrame:
    """Names of books that have an index, of those that are wanted, in order."""
    found = books.filter(F.col(indexed_at).isNotNull()).select(name)
    return (found.join(wanted.select(name).distinct(), name, "left_semi") if wanted is not None else found).orderBy(name)


def skips_context(chars: Column, page: Column, pages: Column) -> Column:
    return (chars < LEAST_BODY) | (page <= MARGIN) | (page > pages - MARGIN)


def tuning_page(approved: Column, page_type: Column, layout: Column, engine: Column, reviewer: str, corrected: Column) -> Column:
    """Whether a page may train a model: approved prose that the reviewer's text was taken for. A null is a no."""
    fine = approved & (page_type == "narrative") & (layout == "normal_prose") & (engine == reviewer) & corrected.rlike(r"(?U)\S")
    return F.coalesce(fine, F.lit(False))


def meaningful(df: DataFrame, columns: list[str]) -> Column:
    """Whether any of the columns has a value; an empty array is none."""
    kinds = dict(df.dtypes)
    return F.array_max(F.array(*[(F.coalesce(F.size(c), F.lit(0)) > 0) if kinds[c].startswith("array") else F.col(c).isNotNull() for c in columns]).cast("array<int>")) == 1


def pending(pages: DataFrame, text: str, names: str, redo: bool = False) -> DataFrame:
    """Pages with text whose names were not found yet; all with text to do them again."""
    some = pages.filter(F.coalesce(F.col(text), F.lit("")) != "")
    return some if redo else some.filter(F.col(names).isNull())


def job_identity(jobs: DataFrame, books: DataFrame, series: DataFrame, authors: DataFrame, book: str, series_id: str, author: str, place: str) -> DataFrame:
    """Jobs with their book, its series if it has one, and its authors in order."""
    lists = authors.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(place, author))).alias("__l"))
    j = jobs.join(books, book).join(series, series_id, "left").join(lists, book, "left")
    return j.withColumn("authors", F.coalesce(F.transform("__l", lambda x: x[author]), F.array().cast("array<string>"))).drop("__l")


def history(df: DataFrame, key: str, limit: int = 100) -> DataFrame:
    """The newest rows, by key; 1 to 500 of them."""
    if not 1 <= limit <= HISTORY:
        raise ValueError(f"limit must be from 1 to {HISTORY}")
    return df.orderBy(F.desc(key)).limit(limit)


def assigned_index(names: list[str], index: float | list[float], title: str) -> list[tuple[str, float]]:
    """(name, index): one index for all names, or one for each."""
    if not title.strip() or not names:
        raise ValueError("a title and names are needed")
    if isinstance(index, list) and len(index) != len(names):
        raise ValueError("as many indexes as names are needed")
    return list(zip(names, index if isinstance(index, list) else [index] * len(names)))


def assign_series(records: DataFrame, names: list[str], index: float | list[float], title: str, key: str) -> DataFrame:
    """The records with series_title and series_index set for the names, which must all be there."""
    given = records.sparkSession.createDataFrame(assigned_index(names, index, title), f"{key} {records.schema[key].dataType.simpleString()}, __i double")
    j = records.join(F.broadcast(given), key, "left")
    return j.withColumns({"series_title": F.when(F.col("__i").isNotNull(), F.lit(title.strip())).otherwise(F.col("series_title")), "series_index": F.coalesce("__i", "series_index")}).drop("__i")


def series_of_authors(records: DataFrame, series: str, authors: str, chosen: list[str]) -> DataFrame:
    """Series of which a record has just the chosen authors, whatever their order and case."""
    key = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda a: F.lower(F.trim(a)))))
    return records.filter(F.col(series).isNotNull() & (key(F.col(authors)) == key(F.array(*map(F.lit, chosen))))).select(series).distinct()


def appended(sessions: DataFrame, messages: DataFrame, batch: DataFrame, session: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) after a batch: its messages of known sessions are added, and these sessions touched at their newest."""
    known = batch.join(sessions.select(session), session, "left_semi")
    newest = known.groupBy(session).agg(F.max(at).alias("__t"))
    touched = sessions.join(newest, session, "left").withColumn("last_message_at", F.greatest("last_message_at", "__t")).drop("__t")
    return touched, messages.unionByName(known.select(*messages.columns))


def wall_clock(ts: Column, zone: str = "Asia/Tokyo") -> Column:
    """A moment as the clock of a zone shows it, whatever the session's zone."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")


def case_folded(df: DataFrame, path: str) -> DataFrame:
    """Rows by path whatever its case, equal ones by the path itself."""
    return df.orderBy(F.lower(path), path)


def per_participant(topics: DataFrame, who: str, sender: str, recipient: str, topic: str) -> DataFrame:
    """Topics that somebody sent to or received from."""
    return topics.filter((F.col(sender) == who) | (F.col(recipient) == who)).select(topic).distinct()


def grouped_error_report(rows: DataFrame, group: str, reference: str, hypothesis: str, page: str) -> DataFrame:
    """(group, pages, distance, chars, rate, exact, worst): micro error rate, pages that are right to the letter, and the largest
    rate of a page. An empty reference is an error."""
    text = F.when(F.length(reference) > 0, F.col(reference)).otherwise(F.raise_error(F.concat(F.lit("no reference text: "), F.col(page).cast("string"))))
    d = rows.select(group, text.alias("r"), F.col(hypothesis).alias("h")).withColumn("d", F.levenshtein("r", F.coalesce("h", F.lit(""))).cast("long"))
    got = d.groupBy(group).agg(F.count("*").alias("pages"), F.sum("d").alias("distance"), F.sum(F.length("r")).cast("long").alias("chars"), F.count_if(F.col("d") == 0).alias("exact"), F.max(F.col("d") / F.length("r")).alias("worst"))
    return got.withColumn("rate", F.col("distance") / F.col("chars"))


def ranked_order(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with their number in each group."""
    return df.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
