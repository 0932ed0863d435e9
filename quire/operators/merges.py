"""Write semantics as transformations: what a table is after a merge. The caller writes it to a new path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(target: DataFrame, batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of a batch that a table lacks, the first of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    first = batch.withColumn("__n", rank).filter("__n = 1").drop("__n")
    return first.join(target.select(*key), key, "left_anti")


def upsert(target: DataFrame, batch: DataFrame, key: list[str], keep_old_when_null: list[str] = (), overwrite: list[str] = ()) -> DataFrame:
    """The table after an upsert of rows with unique keys: `overwrite` columns take the new value, `keep_old_when_null`
    ones only where it is not null; columns that are in neither list are as they were, or new for new rows."""
    values = [c for c in target.columns if c not in key]
    old = target.select(*key, F.struct(*values).alias("__old"))
    new = batch.select(*key, F.struct(*values).alias("__new"))
    both = old.join(new, key, "full")
    exists, given = F.col("__old").isNotNull(), F.col("__new").isNotNull()

    def merged(c: str) -> Column:
        o, n = F.col(f"__old.{c}"), F.col(f"__new.{c}")
        if c in overwrite:
            return F.when(given, n).otherwise(o)
        if c in keep_old_when_null:
            return F.coalesce(n, o)
        return F.when(exists, o).otherwise(n)

    return both.select(*key, *[merged(c).alias(c) for c in values])


def replace_partitions(target: DataFrame, batch: DataFrame, partition: str) -> DataFrame:
    """The table with the batch's partitions in place of its own."""
    return target.join(batch.select(partition).distinct(), partition, "left_anti").unionByName(batch)


def changed_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows to write: new or different ones with deleted = false, keys that are gone with deleted = true."""
    values = [c for c in new.columns if c not in key]
    both = old.select(*key, F.struct(*values).alias("__o")).join(new.select(*key, F.struct(*values).alias("__n")), key, "full")
    return both.filter(~F.col("__o").eqNullSafe(F.col("__n"))).select(*key, *[F.col(f"__n.{c}").alias(c) for c in values], F.col("__n").isNull().alias("deleted"))


def publish(history: DataFrame, batch: DataFrame, key: str, at: Column) -> DataFrame:
    """A history with validity times after a publication: active rows of the batch's keys are retired, the new ones are active."""
    keys = batch.select(key).distinct().withColumn("__k", F.lit(True))
    retired = history.join(keys, key, "left").withColumn("retired_at", F.when(F.col("__k") & F.col("retired_at").isNull(), at).otherwise(F.col("retired_at"))).drop("__k")
    fresh = batch.withColumns({"published_at": at, "retired_at": F.lit(None).cast("timestamp")})
    return retired.unionByName(fresh.select(*retired.columns))


def prune_tail(df: DataFrame, counts: DataFrame, key: list[str], index: str, count: str) -> DataFrame:
    """Rows whose index, from 0, is below the count that their key has now; a key without a count keeps nothing."""
    return df.join(counts.select(*key, F.col(count).alias("__n")), key).filter(F.col(index) < F.col("__n")).drop("__n")


def not_imported(files: DataFrame, ledger: DataFrame, key: tuple[str, ...] = ("kind", "name", "sha256")) -> DataFrame:
    """Discovered files that the ledger lacks."""
    return files.join(ledger.select(*key), list(key), "left_anti")


def replaced(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch in place of a whole table, with its columns and types."""
    return batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema])


def replaced_rows(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """The table with the batch's rows in place of all of its own with their keys, however many a key has."""
    return target.join(batch.select(*key).distinct(), key, "left_anti").unionByName(batch.select(*target.columns))


def compensated(old: DataFrame, new: DataFrame, failed: DataFrame, key: list[str]) -> DataFrame:
    """A rebuild with the old rows back for the keys that failed."""
    return new.join(failed.select(*key), key, "left_anti").unionByName(old.join(failed.select(*key).distinct(), key, "left_semi"))


def snapshot_once(history: DataFrame, canonical: DataFrame, key: str, run: str) -> DataFrame:
    """A history with a run of the canonical rows of keys that have none yet, taken before these are replaced."""
    first = canonical.join(history.select(key).distinct(), key, "left_anti").withColumn("run", F.lit(run))
    return history.unionByName(first.select(*history.columns))


def lifecycle(events: DataFrame, run: str, order: str, event: str, counters: list[str]) -> DataFrame:
    """Runs from their events: `running` until one `succeeded` or `failed` (the first of these counts), with summed counters."""
    end = F.min_by(F.when(F.col(event).isin("succeeded", "failed"), F.col(event)), F.when(F.col(event).isin("succeeded", "failed"), F.col(order)))
    return events.groupBy(run).agg(F.coalesce(end, F.lit("running")).alias("status"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def reusable(checkpoints: DataFrame, blocks: DataFrame, key: list[str], same: list[str]) -> DataFrame:
    """Blocks with whether a checkpoint can stand for them: its key and all of the `same` columns agree."""
    known = checkpoints.select(*key, *same).distinct().withColumn("reused", F.lit(True))
    return blocks.join(known, [*key, *same], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def retained(generations: DataFrame, now: Column, days: int, at: str, valid: str) -> DataFrame:
    """Generations with whether retention removes them: older than so many days, with a valid manifest, and not the newest."""
    newest = generations.agg(F.max(at).alias("__n"))
    return generations.crossJoin(F.broadcast(newest)).withColumn("purged", (F.col(at) < now - F.make_dt_interval(F.lit(days))) & F.col(valid) & (F.col(at) < F.col("__n"))).drop("__n")


def split_for_training(df: DataFrame, run: str, train: list, validation: list, forbidden: list) -> DataFrame:
    """Rows of the runs named for training and validation, with their side. A run that is forbidden or on both sides is an
    error at once; one that is absent, or an empty side, is an error of the job."""
    if set(train) & set(validation) or (set(train) | set(validation)) & set(forbidden) or not train or not validation:
        raise ValueError("runs must be on one side each, allowed, and both sides must have some")
    named = df.sparkSession.createDataFrame([(r, "train") for r in train] + [(r, "validation") for r in validation], f"{run} {df.schema[run].dataType.simpleString()}, side string")
    both = F.broadcast(named).join(df.withColumn("__there", F.lit(True)), run, "left")
    return both.filter(F.when(F.col("__there"), F.lit(True)).otherwise(F.raise_error(F.lit("a named run is absent")).cast("boolean"))).drop("__there")
