"""Scope, eligibility and classification predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_scope(df: DataFrame, column: str, names: list[str] | DataFrame | None) -> DataFrame:
    """None is everything; an empty scope is nothing. A DataFrame of names (one column) is joined, not collected."""
    if names is None:
        return df
    if isinstance(names, DataFrame):
        return df.join(names.select(names.columns[0]).withColumnRenamed(names.columns[0], column).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(names)) if names else df.filter(F.lit(False))


def eligible(min_chars: int = 0, margin: int = 0, flag: str = "eligible", chars: str = "char_count", page: str = "page_no", pages: str = "page_count") -> Column:
    """Eligible rows with enough characters, that are not among the first or last `margin` pages by number."""
    out = F.col(flag) & (F.col(chars) >= min_chars)
    return out & (F.col(page) > margin) & (F.col(page) <= F.col(pages) - margin) if margin else out


def positional_margin(df: DataFrame, group: str, order: str, margin: int) -> DataFrame:
    """Drop the first and last `margin` of the rows that are there, by position, where a group has more than twice as many."""
    by = Window.partitionBy(group)
    n, k = F.count("*").over(by), F.row_number().over(by.orderBy(order))
    marked = df.withColumns({"__n": n, "__k": k})
    return marked.filter((F.col("__n") <= 2 * margin) | (F.col("__k") > margin) & (F.col("__k") <= F.col("__n") - margin)).drop("__n", "__k")


def keyword(columns: list[str], text: str, *related: Column) -> Column:
    """Case-insensitive containment in any column; the wildcards % and _ in the text are live, as users rely on."""
    out = F.lit(False)
    for c in [*map(F.col, columns), *related]:
        out = out | F.coalesce(c.ilike(f"%{text}%"), F.lit(False))
    return out


def first_of(*cases: tuple[Column, str], default: str) -> Column:
    """The label of the first condition that holds."""
    out = F.lit(default)
    for condition, label in reversed(cases):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def ownership(returned: Column, purchased: Column, active: Column, borrowed: Column) -> Column:
    return first_of((returned, "returned"), (purchased, "purchased"), (active, "borrowed_active"), (borrowed, "borrowed_ended"), default="unknown")


def capture_state(links: Column, pending: Column) -> Column:
    return first_of((pending, "pending"), (links == 1, "captured"), (links > 1, "ambiguous"), default="none")


def read_state(explicit: Column, views: Column) -> Column:
    """An explicit state if it is a legal one, else by the number of views."""
    return F.when(explicit.isin("unread", "reading", "done"), explicit).otherwise(F.when(F.coalesce(views, F.lit(0)) > 0, "reading").otherwise("unread"))


def cleaned(column: Column) -> Column:
    """Trimmed; empty values and the placeholders "not applicable" and "not available" become null."""
    x = F.regexp_replace(column, r"(?U)^\s+|\s+$", "")
    return F.when(~F.lower(x).isin("", "not applicable", "not available"), x)


def in_time_range(ts: Column, since: Column | None, until: Column | None) -> Column:
    """From since on, before until; with a bound, rows without a time are out."""
    out = F.lit(True)
    if since is not None:
        out = out & (ts >= since)
    if until is not None:
        out = out & (ts < until)
    return F.coalesce(out, F.lit(False))


def not_checked_since(checked: Column, threshold: Column) -> Column:
    """Rows to check: never checked, or not after the threshold."""
    return ~F.coalesce(checked > threshold, F.lit(False))


def patched(old: Column, new: Column, given: Column, empty: Column) -> Column:
    """A field of a partial update: kept unless given, cleared by an empty value."""
    return F.when(~given, old).when(empty, F.lit(None)).otherwise(new)


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, failing at run time on a row that breaks the condition."""
    return df.filter(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
