"""Readers: tables with a contract, files of records, packed numbers, HTML blocks, logs."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class ContractError(ValueError):
    """An input that lacks what its reader is promised."""


def csv_with_contract(spark: SparkSession, path: str, required: list[str], encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header; all columns are text. A byte-order mark before the first name is dropped; a missing column
    is an error before any row is read."""
    df = spark.read.csv(path, header=True, encoding=encoding, multiLine=True, escape='"')
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractError(f"{path} lacks the columns {missing}")
    return df


def files(spark: SparkSession, root: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """Files below a folder: path, name, folder, length, modified, and, if asked for, content and its sha256."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    out = df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return out.withColumn("sha256", F.sha2("content", 256)) if content else out


def json_items(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """The objects of the `items` array of JSON documents; a document without one is an error."""
    docs = spark.read.schema(f"items array<struct<{item_schema}>>").json(path, multiLine=True)
    checked = docs.filter(F.when(F.col("items").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("a document has no items array")).cast("boolean")))
    return checked.select(F.inline("items"))


def json_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Objects of one line each with a unique key; a line that cannot be read fails the job, as does a repeated or missing key."""
    df = spark.read.schema(schema).json(path, mode="FAILFAST")
    bad = df.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).limit(1).count()
    if bad:
        raise ContractError(f"{path}: {key} is not unique")
    return df


def packed_integers(content: Column) -> Column:
    """Big-endian unsigned 32-bit integers; what is left over at the end is dropped."""
    n = (F.octet_length(content) / 4).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.hex(F.substring(content, i * 4 + 1, F.lit(4))), 16, 10).cast("long"))


def assigned_json(script: Column, schema: str) -> Column:
    """The JSON of a script that assigns it to a variable."""
    body = F.regexp_replace(F.regexp_replace(script, r"(?s)^\s*(?:var|let|const)\s+[\w$]+\s*=\s*", ""), r"(?s);\s*$", "")
    return F.from_json(body, schema, {"mode": "FAILFAST"})


def numbered_pages(found: DataFrame) -> DataFrame:
    """Of `files` with content those with a number as name, by folder: folder, page_no, sha256. In each folder the numbers
    must be 1, 2, ... without gaps."""
    pages = found.withColumn("page_no", F.regexp_extract("name", r"^(\d+)\.[A-Za-z]+$", 1).try_cast("int")).filter("page_no is not null")
    gaps = pages.groupBy("folder").agg(F.count_distinct("page_no").alias("n"), F.min("page_no").alias("low"), F.max("page_no").alias("high"), F.count("*").alias("all"))
    if gaps.filter("low <> 1 or high <> n or n <> all").limit(1).count():
        raise ContractError("page numbers are not contiguous from 1")
    return pages.select("folder", "page_no", "sha256")


# Lines of the log of two searches that run side by side. Fixed values.
LOG_MARKS = ("lexical shadow", "lexical ICU fallback")
LOG_SUCCESS = r"lexical shadow: query_hash=([0-9a-f]{12}) fts_count=(\d+) icu_count=(\d+) overlap=(\d+) fts_ms=(\d+(?:\.\d+)?) icu_ms=(\d+(?:\.\d+)?)"
LOG_UNAVAILABLE = r"lexical shadow unavailable: query_hash=([0-9a-f]{12}) fts_count=(\d+) fts_ms=(\d+(?:\.\d+)?) icu_ms=(\d+(?:\.\d+)?) error_type=(\w+)"
LOG_FALLBACK = r"lexical ICU fallback: query_hash=([0-9a-f]{12}) error_type=(\w+)"
LOG_TIME = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})"


def search_log(lines: DataFrame, column: str = "value", since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Lines with their kind, time, hash, counts and times. A line without a mark is ignored; with a bound, one without a time or
    out of the range is filtered; one that fits no pattern is malformed."""
    line = F.col(column)
    g = lambda p, i: F.nullif(F.regexp_extract(line, p, i), F.lit(""))
    ts = F.try_to_timestamp(F.replace(g(LOG_TIME, 1), F.lit("T"), F.lit(" ")))
    outside = F.lit(False)
    if since is not None:
        outside = outside | ~F.coalesce(ts >= since, F.lit(False))
    if until is not None:
        outside = outside | ~F.coalesce(ts < until, F.lit(False))
    marked = F.contains(line, F.lit(LOG_MARKS[0])) | F.contains(line, F.lit(LOG_MARKS[1]))
    kind = (
        F.when(~F.coalesce(marked, F.lit(False)), "ignore")
        .when(outside, "filtered")
        .when(line.rlike(LOG_SUCCESS), "success")
        .when(line.rlike(LOG_UNAVAILABLE), "unavailable")
        .when(line.rlike(LOG_FALLBACK), "fallback")
        .otherwise("malformed")
    )
    counts = [g(LOG_SUCCESS, i).cast("int").alias(n) for i, n in ((3, "icu"), (4, "overlap"))]
    times = [F.coalesce(g(LOG_SUCCESS, i), g(LOG_UNAVAILABLE, j)).cast("double").alias(n) for i, j, n in ((5, 3, "fts_ms"), (6, 4, "icu_ms"))]
    hash_ = F.coalesce(g(LOG_SUCCESS, 1), g(LOG_UNAVAILABLE, 1), g(LOG_FALLBACK, 1))
    fts = F.coalesce(g(LOG_SUCCESS, 2), g(LOG_UNAVAILABLE, 2)).cast("int")
    return lines.select(ts.alias("ts"), hash_.alias("hash"), fts.alias("fts"), *counts, *times, kind.alias("kind"))


class _Blocks(HTMLParser):
    """Elements that have a label and a box, with the text inside them."""

    def __init__(self):
        super().__init__()
        self.found: list[dict] = []
        self.open: list[tuple[str, int | None]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        place = None
        if tag == "div" and "data-label" in a and "data-bbox" in a:
            box = [float(x) for x in a["data-bbox"].replace(",", " ").split() if x.replace(".", "", 1).replace("-", "", 1).isdigit()]
            place = len(self.found)
            self.found.append({"label": a["data-label"] or "", "box": box, "text": "", "place": place})
        if tag not in ("br", "img", "hr", "input", "meta", "link"):
            self.open.append((tag, place))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        for _, place in reversed(self.open):
            if place is not None:
                self.found[place]["text"] += data
                return


def html_blocks(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, label, box, text) of the labelled blocks of each page, in order; a page without any has no rows."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("box", pa.list_(pa.float64())), ("text", pa.string()), ("place", pa.int32())]))

    @F.arrow_udf("array<struct<label:string,box:array<double>,text:string,place:int>>")
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            out = []
            for page in pages.to_pylist():
                parser = _Blocks()
                parser.feed(page or "")
                out.append([b | {"text": b["text"].strip()} for b in parser.found])
            yield pa.array(out, kind)

    return df.select(key, F.inline(parse(html))).select(key, "place", "label", "box", "text")


def vectors(spark: SparkSession, path: str, key: str, vector: str, dim: int) -> DataFrame:
    """A table of vectors; at run time a row whose vector is not finite, not of the dimension, or zero is an error."""
    from quire.operators.search import valid_vector

    df = spark.read.parquet(path)
    return df.filter(F.when(valid_vector(F.col(vector), dim), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a vector: "), F.col(key).cast("string"))).cast("boolean")))


#: Encodings that a file is tried in as a whole, in this order. Fixed values.
ENCODINGS = ("utf-8-sig", "cp932", "utf-8")


@F.arrow_udf(StringType())
def decoded(contents: pa.Array) -> pa.Array:
    """The text of whole files: in the first encoding in which all of it can be read, else with marks for what cannot."""

    def one(data: bytes) -> str:
        for name in ENCODINGS:
            try:
                return data.decode(name)
            except UnicodeDecodeError:
                continue
        return data.decode("utf-8", "replace")

    return pa.array([None if c is None else one(c) for c in contents.to_pylist()], pa.string())


def texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files as (path, name, sha256, text), whatever their encoding; an empty file has no row."""
    return files(spark, root, pattern, content=True).select("path", "name", "sha256", decoded("content").alias("text"))


def csv_kinds(spark: SparkSession, root: str, kinds: dict[str, tuple[str, str]], ledger: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Files of several kinds, each known by its name: ({kind: rows}, files).

    kinds is {file name: (kind, key column)}. The rows of a kind are maps of its columns as text, with path and key; rows without
    a key are left out. files has (kind, path, name, sha256, status, records, missing), status being `skipped` for those
    that the ledger (kind, name, sha256) has, else `success`. A kind without files has no rows."""
    named = spark.createDataFrame([(n, k, c) for n, (k, c) in kinds.items()], "name string, kind string, key_column string")
    found = texts(spark, root, "*.csv").join(F.broadcast(named), "name")
    if ledger is not None:
        found = found.join(ledger.select("kind", "name", "sha256").distinct().withColumn("__seen", F.lit(True)), ["kind", "name", "sha256"], "left")
    else:
        found = found.withColumn("__seen", F.lit(None).cast("boolean"))

    @F.arrow_udf("array<map<string,string>>")
    def parsed(bodies: pa.Array) -> pa.Array:
        kind = pa.list_(pa.map_(pa.string(), pa.string()))
        out = []
        for body in bodies.to_pylist():
            rows = csv.DictReader(io.StringIO(body or "", newline=""))
            out.append([[(k.strip(), v) for k, v in r.items() if k is not None and isinstance(v, str)] for r in rows])
        return pa.array(out, kind)

    new = found.filter("__seen is null").withColumn("rows", parsed("text"))
    rows = new.select("kind", "path", "key_column", F.explode("rows").alias("fields"))
    rows = rows.withColumn("key", F.trim(F.try_element_at("fields", F.col("key_column")))).withColumn("missing", F.coalesce(F.col("key") == "", F.lit(True)))
    counts = rows.groupBy("kind", "path").agg(F.count_if(~F.col("missing")).alias("records"), F.count_if("missing").alias("missing"))
    status = F.when(F.col("__seen"), "skipped").otherwise("success")
    told = found.select("kind", "path", "name", "sha256", status.alias("status")).join(counts, ["kind", "path"], "left").fillna(0, ["records", "missing"])
    good = rows.filter("not missing").select("kind", "path", "key", "fields")
    return {k: good.filter(F.col("kind") == k).drop("kind") for k in {k for k, _ in kinds.values()}}, told


def head(ids: Column, count: int) -> Column:
    """The first `count` of an array, also where a source sends more than was asked for."""
    return F.slice(ids, 1, count)


CASES = "id string, query string, source string, scope struct<type:string,book_name:string>, relevant array<struct<book_name:string,page_no:bigint,grade:bigint>>"


def evaluation_cases(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The cases of an evaluation document: (id, query, scope_book, source, relevant). What is wrong with any of them, by case, is
    one error: no or a repeated id, an empty query, a scope that is none, no relevant pages, a page without a book, below 0 or
    there twice, a grade that is not 1, 2 or 3."""
    document = spark.read.schema(f"schema_version string, cases array<struct<{CASES.replace(' string', ':string').replace(' struct', ':struct').replace(' array', ':array')}>>").json(path, multiLine=True, mode="FAILFAST")
    first = document.first()
    if first is None or first.schema_version != version or not first.cases:
        raise ContractError(f"{path} has no cases of {version}")
    cases = document.select(F.posexplode("cases").alias("place", "c")).select("place", "c.*")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = lambda c: F.coalesce(c, F.lit(True))
    pages = F.transform("relevant", lambda r: F.struct(r["book_name"], r["page_no"]))
    problem = (
        F.when(blank(F.col("id")), "no id")
        .when(F.row_number().over(Window.partitionBy("id").orderBy("place")) > 1, "repeated id")
        .when(blank(F.col("query")), "empty query")
        .when(F.col("scope").isNotNull() & bad(~F.col("scope.type").isin("all", "book")), "scope")
        .when((F.col("scope.type") == "book") & blank(F.col("scope.book_name")), "scope without a book")
        .when(F.coalesce(F.size("relevant"), F.lit(0)) < 1, "no relevant pages")
        .when(F.exists("relevant", lambda r: blank(r["book_name"]) | bad(r["page_no"] < 0)), "relevant page")
        .when(F.exists("relevant", lambda r: bad(~r["grade"].between(1, 3))), "grade")
        .when(F.size(F.array_distinct(pages)) < F.size(pages), "relevant page twice")
    )
    checked = cases.withColumn("problem", problem)
    wrong = checked.filter("problem is not null").select("place", "id", "problem").orderBy("place").limit(20).collect()
    if wrong:
        raise ContractError(f"{path}: " + "; ".join(f"case {r.place + 1} ({r.id}): {r.problem}" for r in wrong))
    return checked.select("id", F.trim("query").alias("query"), F.when(F.col("scope.type") == "book", F.col("scope.book_name")).alias("scope_book"), F.coalesce("source", F.lit("")).alias("source"), "relevant")
