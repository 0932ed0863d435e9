"""Aggregates: rates over grouping sets, percentiles, pairs, histograms, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.shared import stored


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def error_rate(distance: str = "distance", chars: str = "chars") -> Column:
    """Micro-averaged: the sum of distances by the sum of characters."""
    return ratio(F.sum(distance), F.sum(chars))


def over_grouping_sets(df: DataFrame, groups: list[str], measures: dict[str, Column]) -> DataFrame:
    """The measures overall and by each single column, as rows (grouping, value, ...) in one pass over df."""
    sets = [[], *[[F.col(g)] for g in groups]]
    got = df.groupingSets(sets, *map(F.col, groups)).agg(F.grouping_id().alias("__id"), *[m.alias(n) for n, m in measures.items()])
    which = F.lit("overall")
    value = F.lit(None).cast("string")
    for i, g in enumerate(groups):
        mask = (1 << len(groups)) - 1 - (1 << (len(groups) - 1 - i))
        which = F.when(F.col("__id") == mask, F.lit(g)).otherwise(which)
        value = F.when(F.col("__id") == mask, F.col(g).cast("string")).otherwise(value)
    return got.select(which.alias("grouping"), value.alias("value"), *measures)


def nearest_rank(df: DataFrame, groups: list[str], value: str, at: list[float]) -> DataFrame:
    """The value at rank ceil(p * n) of each group, for each p: percentile_disc, which merges partial counts."""
    spec = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(p * 100)}") for p in at]
    return df.groupBy(*groups).agg(*spec)


def nearest_rank_by_ranges(df: DataFrame, groups: list[str], value: str, at: list[float]) -> DataFrame:
    """The same for groups with very many distinct values: (groups, p, value).

    Values are counted, so that one that many rows have is one row, and dealt in ranges of group and value, however large a group
    is. Ranges are added up first; only the range where a rank falls is gone through value by value."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ranges = stored(counted.repartitionByRange(*groups, "__v").withColumn("__range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy(*groups, "__range").agg(F.sum("__n").alias("__in"))
    of_group = Window.partitionBy(*groups)
    upto = of_group.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumns({"__upto": F.sum("__in").over(upto), "__all": F.sum("__in").over(of_group)})
    wanted = sums.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in at]))).withColumn("__rank", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("__all"))))
    wanted = wanted.filter("__rank <= __upto and __rank > __upto - __in").select(*groups, "__range", "p", (F.col("__rank") - (F.col("__upto") - F.col("__in"))).alias("__rank"))
    inside = Window.partitionBy(*groups, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = ranges.join(wanted.select(*groups, "__range").distinct(), [*groups, "__range"], "left_semi").withColumn("__c", F.sum("__n").over(inside))
    found = hit.join(wanted, [*groups, "__range"]).filter("__c >= __rank and __c - __n < __rank")
    return found.select(*groups, "p", F.col("__v").alias(value))


def distribution(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """samples, interpolated median, nearest-rank p95 and maximum, rounded to 6 places."""
    return df.groupBy(*groups).agg(
        F.count(value).alias("samples"),
        F.round(F.median(value), 6).alias("median"),
        F.round(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})"), 6).alias("p95"),
        F.round(F.max(value), 6).alias("max"),
    )


def modal(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Per key: rows, and the most frequent value, of equals the one seen first."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(key).agg(F.sum("n").alias("n"), F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def pairs(df: DataFrame, container: str, item: str, most: int = 1000) -> DataFrame:
    """How often two items are in one container: (a, b, n) with a < b.

    A container's items are distinct. Up to `most` of them are paired within one row; larger containers are paired by a join,
    which spills and whose skew Spark splits: all of their pairs are made, however long that takes.
    """
    items = stored(df.select(container, item).filter(F.col(item).isNotNull()).distinct(), "items")  # read thrice below
    large = items.groupBy(container).agg(F.count("*").alias("__n")).filter(F.col("__n") > most).select(container)
    sets = items.join(large, container, "left_anti").groupBy(container).agg(F.array_sort(F.collect_set(item)).alias("s"))
    ab = sets.select(F.posexplode("s").alias("i", "a"), "s").select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    rest = items.join(large, container, "left_semi")
    both = rest.withColumnRenamed(item, "a").join(rest.withColumnRenamed(item, "b"), container).filter("a < b").select("a", "b")
    return ab.unionByName(both).groupBy("a", "b").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, groups: list[str], value: str, width: int, bins: int) -> DataFrame:
    """Counts by bins of a width, the last of them open."""
    return df.groupBy(*groups, F.least(F.floor(F.col(value) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def duplicate_groups(df: DataFrame, key: str, content: Column) -> DataFrame:
    """Contents that several rows have: (digest, members, first)."""
    return df.select(key, F.sha2(content, 256).alias("digest")).groupBy("digest").agg(F.count("*").alias("members"), F.min(key).alias("first")).filter("members > 1")


def low_outliers(df: DataFrame, group: str, size: str, floor: int, part: float) -> DataFrame:
    """Rows whose size is under the larger of a floor and a part of their group's upper median."""
    middle = df.groupBy(group).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {size} DESC)").alias("__m"))
    return df.join(middle, group).filter(F.col(size) < F.greatest(F.lit(floor).cast("double"), F.col("__m") * part)).drop("__m")


def term_counts(df: DataFrame, terms: dict[str, str], text: str) -> DataFrame:
    """How often each literal occurs, without overlaps, in each row's text: a column for each."""
    count = lambda t: ((F.length(text) - F.length(F.replace(F.col(text), F.lit(t), F.lit("")))) / len(t)).cast("long")
    return df.withColumns({name: count(t) for name, t in terms.items()})


def gate(checks: dict[str, Column], pending: dict[str, Column]) -> Column:
    """failed if a check fails, else pending if something is pending, else passed."""
    ok, wait = F.lit(True), F.lit(False)
    for c in checks.values():
        ok = ok & F.coalesce(c, F.lit(False))
    for c in pending.values():
        wait = wait | F.coalesce(c, F.lit(True))
    return F.when(~ok, "failed").when(wait, "pending").otherwise("passed")


def medoid(df: DataFrame, group: str, index: str, text: str) -> DataFrame:
    """Of each group's readings the one with the least sum of normalised edit distances to the others; of equals the first. All
    pairs of a group's readings are compared, by a join."""
    a = df.select(group, F.col(index).alias("i"), F.col(text).alias("x"))
    b = a.select(F.col(group).alias("__g"), F.col("i").alias("j"), F.col("x").alias("y"))
    d = F.try_divide(F.levenshtein("x", "y").cast("double"), F.greatest(F.length("x"), F.length("y")).cast("double"))
    apart = a.join(b, (F.col(group) == F.col("__g")) & (F.col("i") < F.col("j"))).select(group, F.array("i", "j").alias("both"), F.coalesce(d, F.lit(0.0)).alias("d"))
    each = apart.select(group, F.explode("both").alias("i"), "d").unionByName(a.select(group, "i", F.lit(0.0).alias("d")))
    sums = each.groupBy(group, "i").agg(F.sum("d").alias("total"))
    return sums.groupBy(group).agg(F.min_by("i", F.struct(F.round("total", 9), "i")).alias(index), F.round(F.min("total"), 6).alias("total"))
