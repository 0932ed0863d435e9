"""Joins of the catalog and the page store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.shared import spread

#: A block of more rows is dealt in parts of about so many; two parts meet at a time.
PART = 50_000
#: Pairs that `shared_scores` makes at a time; of one row they may be more.
PAIRS = 1 << 19


def flag_exists(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """Add whether `other` has the row's key. The keys are made distinct before they meet df, so no row is doubled."""
    keys = other.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(keys, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def count_matches(df: DataFrame, other: DataFrame, key: str, name: str, condition: Column | None = None) -> DataFrame:
    """Add the number of rows of `other` with the row's key (that meet a condition); 0 where there is none."""
    counted = other.filter(condition) if condition is not None else other
    return df.join(counted.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def ordered_strings(df: DataFrame, key: str, value: str, order: str, name: str, separator: str = " / ") -> DataFrame:
    """The values of each key in an order, joined to one string."""
    got = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("__l"))
    return got.select(key, F.array_join(F.transform("__l", lambda x: x["v"]), separator).alias(name))


def neighbours(hits: DataFrame, pages: DataFrame, book: str = "book", page: str = "page_no") -> DataFrame:
    """The hit pages and the pages before and after that exist, each once; direct hits are marked."""
    near = hits.select(book, F.explode(F.array(F.struct(F.col(page).alias("p"), F.lit(True).alias("d")), *[F.struct((F.col(page) + i).alias("p"), F.lit(False).alias("d")) for i in (-1, 1)])).alias("__n"))
    near = near.select(book, F.col("__n.p").alias(page), F.col("__n.d").alias("direct")).groupBy(book, page).agg(F.max("direct").alias("direct"))
    return pages.select(book, page).distinct().join(near, [book, page])


def related(items: DataFrame, chosen: DataFrame, key: str, series: str, authors: str, index: str, per_series: int = 8, per_author: int = 5) -> DataFrame:
    """Of each chosen item the items of its series by index, and others that share an author: (of, key, why, rank). Keys are
    unique.

    Both joins are equi-joins, on the series and on single authors. What counts is limited within each chosen item, and what
    may count before the joins: the first of a series, one more for the item itself, and the first of an author outside a series.
    """
    me = chosen.select(F.col(key).alias("of"), F.col(series).alias("__s"), F.col(authors).alias("__a"))
    order = [F.col(index).asc_nulls_last(), F.col(key)]
    place = F.row_number().over(Window.partitionBy(series).orderBy(*order))
    first = items.select(key, series, index).filter(F.col(series).isNotNull()).withColumn("__k", place).filter(F.col("__k") <= per_series + 1).drop("__k")
    same = me.select("of", "__s").join(first, (F.col("__s") == F.col(series)) & (F.col(key) != F.col("of")))
    rank = F.row_number().over(Window.partitionBy("of").orderBy(*order))
    by_series = same.select("of", key, F.lit("series").alias("why"), rank.alias("rank")).filter(F.col("rank") <= per_series)
    # of an author and a series only the first items can be among the first of any chosen item
    rows = items.select(key, series, F.explode(authors).alias("__author"))
    k = F.row_number().over(Window.partitionBy("__author", series).orderBy(key))
    right = rows.withColumn("__k", k).filter(F.col("__k") <= per_author + 1).drop("__k")
    left = me.select("of", "__s", F.explode("__a").alias("__author"))
    # what chosen items of a series have from an author is found once for all of them
    wanted = left.select("__author", "__s").distinct()
    others = wanted.join(right, "__author").filter(~F.coalesce(F.col("__s") == F.col(series), F.lit(False)))
    k = F.row_number().over(Window.partitionBy("__author", "__s").orderBy(key))
    few = others.withColumn("__k", k).filter(F.col("__k") <= per_author + 1).select(F.col("__author").alias("__b"), F.col("__s").alias("__t"), key)
    shared = left.join(few, (F.col("__author") == F.col("__b")) & F.col("__s").eqNullSafe(F.col("__t")) & (F.col(key) != F.col("of"))).select("of", key).distinct()
    rank = F.row_number().over(Window.partitionBy("of").orderBy(key))
    by_author = shared.select("of", key, F.lit("author").alias("why"), rank.alias("rank")).filter(F.col("rank") <= per_author)
    return by_series.unionByName(by_author)


def vote(members: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most common value of each key's members; of equals the one seen first."""
    counts = members.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))
    return best


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Join on columns of which nulls are equal; Catalyst still hashes them."""
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return left.join(right, condition, how)


def difference(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows that were added, removed or changed between two snapshots with unique keys: (key, change)."""
    a = left.select(F.col(key).alias("__a"), F.struct(*values).alias("__old"))
    b = right.select(F.col(key).alias("__b"), F.struct(*values).alias("__new"))
    both = a.join(b, F.col("__a") == F.col("__b"), "full")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return both.select(F.coalesce("__a", "__b").alias(key), change.alias("change")).filter(F.col("change").isNotNull())


def consistency(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, and ids that occur twice: (key, problem)."""
    n = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = n(left, "l").join(n(right, "r"), key, "full").fillna(0, ["l", "r"])
    problems = F.array_compact(F.array(F.when(F.col("l") == 0, F.lit("extra")), F.when(F.col("r") == 0, F.lit("missing")), F.when(F.col("l") > 1, F.lit("duplicate_left")), F.when(F.col("r") > 1, F.lit("duplicate_right"))))
    return both.select(key, F.explode(problems).alias("problem"))


def contained(names: DataFrame, titles: DataFrame, name: str, title: str, order: str, n: int = 3) -> DataFrame:
    """For each name the first title (in an order) of at least n characters that it contains."""
    long = titles.filter(F.length(title) >= n)
    distinct = names.select(F.col(name).alias("__key"), name).distinct()
    hits = containing(distinct, "__key", name, long.select(title).distinct(), title, n).join(long, title)
    return hits.groupBy(F.col("__key").alias(name)).agg(F.min_by(title, order).alias(title))


#: Grams by which parts are looked for have at most so many characters.
LONGEST_GRAM = 32


def containing(texts: DataFrame, key: str, text: str, parts: DataFrame, part: str, n: int = 3) -> DataFrame:
    """(key, part) where a text contains a part of n characters at least. Parts are distinct.

    A part is looked for only in the texts that have its rarest gram, so a beginning that many parts or texts share
    makes no pairs: two equi-joins, not a comparison of everything with everything. A part's grams have the greatest power
    of two of characters that it has, n at least and LONGEST_GRAM at most: grams of three would be in ever more texts as
    tables grow. Which sizes there are is all that is collected. Grams are known by a hash; what meets is then compared.
    They are many more than the files' size lets expect, so the joins are hinted to be by merging: none of their sides is
    sent to the driver and all tasks.
    """

    def grams(c: str, size: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(c) - size + 1)
        return F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.substr(F.col(c), i, size))))

    power = F.lit(n)
    for size in (2**i for i in range(LONGEST_GRAM.bit_length())):
        power = F.when(F.length(part) >= size, F.lit(max(n, size))).otherwise(power) if size > n else power
    long = parts.filter(F.length(part) >= n)
    sizes = sorted(r[0] for r in long.select(power).distinct().collect())
    of_parts = long.select(part, F.explode(grams(part, power)).alias("__g"))
    each = [F.when(F.length(text) >= k, grams(text, F.lit(k))).otherwise(F.array().cast("array<bigint>")) for k in sizes]
    all_grams = F.array_distinct(F.concat(*each)) if each else F.array().cast("array<bigint>")
    of_texts = texts.select(F.col(key), F.explode(all_grams).alias("__g")).join(of_parts.select("__g").distinct().hint("merge"), "__g", "left_semi")
    seen = of_texts.groupBy("__g").agg(F.count("*").alias("__n"))
    # a gram that no text has comes first: its part is in no text
    counted = of_parts.join(seen.hint("merge"), "__g", "left").groupBy(part).agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__g").alias("g"))).alias("__r"))
    rarest = counted.filter("__r.n > 0").select(part, F.col("__r.g").alias("__g"))
    near = of_texts.join(rarest.hint("merge"), "__g").select(F.col(key).alias("__k"), part)
    whole = texts.select(F.col(key), F.col(text).alias("__text"))
    return near.join(whole.hint("merge"), F.col("__k") == F.col(key)).filter(F.contains("__text", F.col(part))).select(key, part)


def candidate_scores(left: DataFrame, right: DataFrame, block: str, rules: list[tuple[Column, int]], least: int, keys: list[tuple[Column, Column]] | None = None, ids: tuple[str, str] = ("", ""), only: Column | None = None) -> DataFrame:
    """Pairs that share a block, scored by rules, with more than the least score; with `only`, of the pairs of ids that it holds for.

    keys: arrays of values of a left and a right row, of which a pair with more than the least score has some value in common.
    Then ids, which are unique, meet by equality of block and value, each pair once, and their rows are joined afterwards;
    without keys, all pairs of a block meet. Pairs are shuffled with their rows; where all rules ask for values in common and both
    sides are one table, `shared_scores` shuffles rows alone."""
    score = sum((F.when(c, F.lit(points)).otherwise(F.lit(0)) for c, points in rules), F.lit(0))
    only = F.lit(True) if only is None else only
    if not keys:
        return left.join(right, block).filter(only).withColumn("score", score).filter(F.col("score") > least)
    met = None
    for a, b in keys:
        one, two = (df.select(block, i, F.explode(F.array_distinct(v)).alias("__v")) for df, i, v in ((left, ids[0], a), (right, ids[1], b)))
        part = one.join(two, [block, "__v"]).filter(only).select(*ids)
        met = part if met is None else met.unionByName(part)
    return met.distinct().join(left.hint("merge"), ids[0]).join(right.drop(block).hint("merge"), ids[1]).withColumn("score", score).filter(F.col("score") > least)


def shared_scores(df: DataFrame, key: str, block: list[str], rules: list[tuple[Column, int]], least: int) -> DataFrame:
    """Pairs (a, b, score) of keys of a block, the smaller one first, with more than the least score.

    rules: arrays of values, and the points of a pair whose rows have some value in common; nulls have nothing in common.
    Points are above 0, and least is 0 or more. A block's rows are dealt to one task, which finds pairs by their values, scores
    each once and gives it away: what is shuffled are rows, and no pair. A task holds one block, or two parts of one that has
    more than PART rows; then each row goes to as many tasks as its block has parts."""
    if least < 0 or any(points <= 0 for _, points in rules):
        raise ValueError("a pair without any value in common would count, or a value in common would count against it")
    points = [p for _, p in rules]
    rows = df.select(F.col(key).alias("key"), *[F.col(c).alias(f"block_{i}") for i, c in enumerate(block)], *[v.alias(f"rule_{i}") for i, (v, _) in enumerate(rules)])
    by = [f"block_{i}" for i in range(len(block))]
    rows = rows.dropna(subset=["key", *by])
    parts = rows.groupBy(*by).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).filter("parts > 1")
    rows = rows.join(F.broadcast(parts), by, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # one narrow row to a large block
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.struct(*by, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    dealt = spread(rows.select(cell.alias("cell"), "key", "part", "other", *[f"rule_{i}" for i in range(len(rules))]), "cell")
    most = PAIRS

    def meet(cells: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys_a, keys_b, scores in _shared(pa.Table.from_batches(cells), points, least, most):
            yield pa.record_batch([keys_a, keys_b, pa.array(scores)], names=["a", "b", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    return dealt.groupBy("cell").applyInArrow(meet, f"a {kind}, b {kind}, score int")


def _shared(rows: pa.Table, points: list[int], least: int, most: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """The pairs of one part's rows, or of the rows of two parts, about `most` at a time."""
    rows = rows.sort_by([("part", "ascending"), ("key", "ascending")])
    n, keys, part = rows.num_rows, rows.column("key").combine_chunks(), rows.column("part").to_numpy()
    alone = bool(part[0] == rows.column("other").to_numpy()[0])
    cut = int(np.searchsorted(part, part[0], "right"))  # where the other part begins
    rank = pc.rank(keys, tiebreaker="dense").to_numpy().astype(np.int64)
    values = [_values(rows.column(f"rule_{i}").combine_chunks(), n) for i in range(len(points))]

    # rules that together give no more than the least score find no pairs; of one value to a row, they are read off those found
    spare, checked = 0, {}
    for i in sorted(range(len(points)), key=points.__getitem__):
        spare += points[i]
        at, code = values[i]
        if spare <= least and len(np.unique(at)) == len(at):
            checked[i] = np.full(n, -1, np.int64)
            checked[i][at] = code

    # each value of a rule has its rows side by side
    sizes = [0 if i in checked else int(code.max()) + 1 if len(code) else 0 for i, (_, code) in enumerate(values)]
    first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    posts = np.sort(np.concatenate([(code + first[i]) * n + at for i, (at, code) in enumerate(values) if i not in checked] or [np.zeros(0, np.int64)]))
    code, row = np.divmod(posts, n)
    rule = np.searchsorted(first, code, "right") - 1
    ends = np.searchsorted(code, code, "right")
    # a row meets those after it, or those of the other part
    starts = np.arange(1, len(posts) + 1) if alone else np.where(row < cut, np.searchsorted(posts, code * n + cut), ends)

    order = np.argsort(row, kind="stable")
    row_of, starts, counts, rule = row[order], starts[order], (ends - starts)[order], rule[order]
    total = np.concatenate(([0], np.cumsum(counts)))
    bounds = np.searchsorted(row_of, np.arange(n + 1))  # where a row's values begin
    made = total[bounds]
    worth, bits = np.array(points, np.int32), max(1, (len(points) - 1).bit_length())
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(made, made[begin] + most, "right")) - 1)
        p, q = bounds[begin], bounds[end]
        c = counts[p:q]
        y = row[np.repeat(starts[p:q] - (total[p:q] - total[p]), c) + np.arange(c.sum())]
        met = ((np.repeat((row_of[p:q] - begin) * n, c) + y) << bits) | np.repeat(rule[p:q], c)
        if len(met):
            met.sort()
            met = met[np.concatenate(([True], met[1:] != met[:-1]))]
            pair, gained = met >> bits, worth[met & ((1 << bits) - 1)]
            new = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            score = np.add.reduceat(gained, new, dtype=np.int32)
            x, y = np.divmod(pair[new], n)
            x += begin
            for i, of in checked.items():
                score += ((of[x] == of[y]) & (of[x] >= 0)) * worth[i]
            kept = (score > least) & (rank[x] != rank[y])
            x, y, score = x[kept], y[kept], score[kept]
            turned = rank[x] > rank[y]
            a, b = np.where(turned, y, x), np.where(turned, x, y)
            if len(a):
                yield keys.take(pa.array(a)), keys.take(pa.array(b)), score
        begin = end


def _values(lists: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all values in a column of arrays, and the values' numbers; each once in a row, without nulls."""
    at, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).dictionary_encode().indices
    some = flat.is_valid().to_numpy(zero_copy_only=False)
    both = np.unique(flat.fill_null(0).to_numpy().astype(np.int64)[some] * n + at[some])
    code, at = np.divmod(both, n)
    return at, code


def range_count(left: DataFrame, right: DataFrame, key: str, position: str, last: int, name: str) -> DataFrame:
    """How many rows of `right` lie at positions 1 to last of each key of left; 0 where there is none."""
    return count_matches(left, right, key, name, F.col(position).between(1, last))
