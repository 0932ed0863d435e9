"""Window and ordered-sequence operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first row of each group in an order; null times come last in a descending one."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("__n", rank).filter("__n = 1").drop("__n")


def previous_valid(value: Column, valid: Column, key: str, order: str) -> Column:
    """The last value before a row for which `valid` held, of the same key."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(valid, value), ignorenulls=True).over(before)


def previous_of(value: Column, valid: Column, key: str, order: str) -> Column:
    """What `value` was, null included, in the last row before for which `valid` held."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(valid, F.struct(value.alias("v"))), ignorenulls=True).over(before)["v"]


def crossing(value: Column, previous: Column, threshold: Column) -> Column:
    """Whether a value is below a threshold that the previous one, if any, was not below."""
    return F.coalesce((value < threshold) & (previous.isNull() | (previous >= threshold)), F.lit(False))


def debounced(df: DataFrame, key: str, ts: str, order: str, seconds: int) -> DataFrame:
    """Views that count: the first, and each that comes `seconds` or more after the one before, counted or not."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(order))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return df.withColumn("counts", before.isNull() | (gap >= seconds * 1_000_000))


def unseen_prefix(df: DataFrame, key: str, order: str, item: str, head: str) -> DataFrame:
    """Items before the place of the head seen last time (column `head`, null: none); all where it is not there."""
    place = F.min(F.when(F.col(item) == F.col(head), F.col(order))).over(Window.partitionBy(key))
    return df.withColumn("__p", place).filter(F.col("__p").isNull() | (F.col(order) < F.col("__p"))).drop("__p")


def neighbours_in_order(df: DataFrame, group: str, *order: str, item: str) -> DataFrame:
    """Add the items before and after each row in its group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumns({"previous": F.lag(item).over(w), "next": F.lead(item).over(w)})


def fused(rankings: list[DataFrame], key: list[str], rank: str = "rank", k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (k + rank) over all rows of all lists; a key that is twice in a list counts
    twice. `first` is where a key was first seen: by list, then by rank."""
    rows = None
    for i, r in enumerate(rankings):
        one = r.select(*key, F.try_divide(F.lit(1.0), F.col(rank) + k).alias("__s"), F.struct(F.lit(i).alias("list"), F.col(rank).cast("long").alias("rank")).alias("__f"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*key).agg(F.sum("__s").alias("score"), F.min("__f").alias("first"))


def capped(df: DataFrame, group: str, per_group: int, top: int, *order: Column) -> DataFrame:
    """At most so many rows of each group, and of all, in an order."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("__n", rank).filter(F.col("__n") <= per_group).drop("__n").orderBy(*order).limit(top)


def best_by(df: DataFrame, key: list[str], score: str, order: str) -> DataFrame:
    """The row with the best score of each key, of equals the first."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), order))
    return df.withColumn("__n", rank).filter("__n = 1").drop("__n")


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, query: str, item: str, rank: str, grade: str, ks: tuple[int, ...] = (5, 10, 30)) -> DataFrame:
    """Per query: recall at each k, reciprocal rank within 10, and nDCG at 10 with gain 2^grade - 1."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(grade), item))
    ideal = relevant.withColumn("__p", place).groupBy(query).agg(F.count("*").alias("__n"), F.sum(F.when(F.col("__p") <= 10, _gain(F.col(grade), F.col("__p")))).alias("__i"))
    return _metrics(ranked.join(relevant, [query, item]), ideal, query, rank, grade, ks)


def ranking_metrics_by_label(ranked: DataFrame, queries: DataFrame, items: DataFrame, query: str, item: str, rank: str, label: str, grade: str, ks: tuple[int, ...] = (5, 10, 30)) -> DataFrame:
    """`ranking_metrics` where the items of a query's label are relevant, but for itself; queries are items too, (query, label), and
    items (item, label, grade), each once. Of a label the numbers of its grades tell what is best, so pairs are not made."""
    hits = ranked.join(items, item).join(queries, [query, label])
    sizes = items.groupBy(label, grade).agg(F.count("*").alias("__c"))
    own = items.select(F.col(item).alias(query), label, F.col(grade).alias("__g"))
    grades = queries.join(own, [query, label], "left").join(sizes, label).withColumn("__c", F.col("__c") - F.coalesce((F.col("__g").eqNullSafe(F.col(grade)) & F.col("__g").isNotNull()).cast("int"), F.lit(0)))
    upto = F.sum("__c").over(Window.partitionBy(query).orderBy(F.desc(grade)))
    first = F.col("__u") - F.col("__c") + 1
    gains = F.when(first <= F.least("__u", F.lit(10)), F.aggregate(F.sequence(first, F.least("__u", F.lit(10))), F.lit(0.0), lambda s, p: s + _gain(F.col(grade), p)))
    ideal = grades.filter("__c > 0").withColumn("__u", upto).groupBy(query).agg(F.sum("__c").alias("__n"), F.sum(gains).alias("__i"))
    return _metrics(hits, ideal, query, rank, grade, ks)


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def _metrics(hits: DataFrame, ideal: DataFrame, query: str, rank: str, grade: str, ks: tuple[int, ...]) -> DataFrame:
    """The figures of queries that have something relevant, from what they found of it and from the best order: (query, __n, __i)."""
    got = hits.groupBy(query).agg(
        *[F.count(F.when(F.col(rank) <= k, 1)).alias(f"__h{k}") for k in ks],
        F.min(F.when(F.col(rank) <= 10, F.col(rank))).alias("__r"),
        F.sum(F.when(F.col(rank) <= 10, _gain(F.col(grade), F.col(rank)))).alias("__d"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(got, query, "left").select(
        query,
        *[F.round(zero(F.col(f"__h{k}") / F.col("__n")), 6).alias(f"recall_{k}") for k in ks],
        F.round(zero(F.try_divide(F.lit(1.0), F.col("__r"))), 6).alias("mrr_10"),
        F.round(zero(F.try_divide(F.col("__d"), F.col("__i"))), 6).alias("ndcg_10"),
    )


def evenly(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """k rows of each group at even distances, ends included; the middle one for k = 1, all where there are no more."""
    by = Window.partitionBy(group)
    marked = df.withColumns({"__i": F.row_number().over(by.orderBy(order)) - 1, "__n": F.count("*").over(by)})
    if k == 1:
        return marked.filter(F.col("__i") == F.floor(F.col("__n") / 2)).drop("__i", "__n")
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("__n") - 1) / (k - 1)).cast("long"))
    return marked.filter((F.col("__n") <= k) | F.array_contains(places, F.col("__i").cast("long"))).drop("__i", "__n")


def hash_sample(df: DataFrame, stratum: str, n: int, seed: str, *columns: str) -> DataFrame:
    """The n rows of each stratum with the least digest of a seed and columns: the same ones each time."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]), 256)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("__d"))
    return df.withColumn("__d", digest).withColumn("__n", rank).filter(F.col("__n") <= n).drop("__d", "__n")


def group_representative(df: DataFrame, group: str, index: str, name: str) -> DataFrame:
    """A group's last row by index, with the group's size; rows alone in their group stand for themselves."""
    by = Window.partitionBy(group)
    rank = F.row_number().over(by.orderBy(F.col(index).desc_nulls_last(), name))
    return df.withColumns({"members": F.count("*").over(by), "__n": rank}).filter("__n = 1").drop("__n")


def queue_position(df: DataFrame, state: str, queued: str, order: str, lanes: str) -> DataFrame:
    """The place of each queued row in its lane, from 1."""
    return df.filter(F.col(state) == queued).withColumn("position", F.row_number().over(Window.partitionBy(lanes).orderBy(order)))
