"""Writers with versions: a folder of immutable generations and a table of which one holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import content_digest


class Conflict(RuntimeError):
    """The revision that a writer started from is not the one that holds any more."""


def digest(df: DataFrame) -> str:
    """A digest of all rows that does not depend on their order: the sum and the xor of the rows' digests, and their number."""
    row = F.conv(F.substring(content_digest(df.columns), 1, 15), 16, 10).cast("long")
    got = df.select(row.alias("d")).agg(F.count("*").alias("n"), F.bit_xor("d").alias("x"), F.sum(F.col("d").cast("decimal(38,0)")).alias("s")).first()
    return f"{got.n}-{got.x or 0:x}-{int(got.s or 0):x}"


class Versioned:
    """A table at a path: `generation-*` folders, and `manifest` rows (revision, generation, digest, rows, status).

    A generation is written whole and checked before the manifest names it, so a reader sees the old one or the new one.
    Manifest rows are only added; the one with the highest revision holds. A revision is claimed by creating a file that must
    not exist, so of two writers that saw the same revision one fails. A writer that dies between its claim and its row
    leaves a claim to be deleted by hand.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> DataFrame:
        return self.spark.read.schema("revision long, generation string, digest string, rows long, status string").parquet(f"{self.path}/manifest")

    def current(self):
        """The manifest row that holds, or None."""
        try:
            return self.manifest().orderBy(F.desc("revision")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def read(self) -> DataFrame:
        row = self.current()
        if row is None or row.status != "active":
            raise Conflict(f"{self.path} has no active generation")
        return self.spark.read.parquet(f"{self.path}/{row.generation}")

    def write(self, df: DataFrame, expected: int | None = None) -> int:
        """Write a generation and make it hold, if the revision is the expected one (None: whichever holds now)."""
        before = self.current()
        revision = before.revision if before else 0
        if expected is not None and expected != revision:
            raise Conflict(f"revision {revision} holds, not {expected}")
        generation = f"generation-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{generation}")
        got = self.spark.read.parquet(f"{self.path}/{generation}")
        self._add(revision, generation, digest(got), got.count(), "active")
        return revision + 1

    def mark_stale(self) -> int:
        """Say that the generation no longer agrees with its source."""
        row = self.current()
        self._add(row.revision if row else 0, row.generation if row else None, row.digest if row else None, row.rows if row else 0, "stale")
        return (row.revision if row else 0) + 1

    def verify(self) -> bool:
        """Whether the generation that holds has the digest it was written with."""
        row = self.current()
        return row is not None and digest(self.spark.read.parquet(f"{self.path}/{row.generation}")) == row.digest

    def roll_back(self, revision: int) -> int:
        """Make the generation of an earlier revision hold again."""
        row = self.manifest().filter((F.col("revision") == revision) & (F.col("status") == "active")).first()
        if row is None:
            raise Conflict(f"revision {revision} was never active")
        now = self.current()
        self._add(now.revision, row.generation, row.digest, row.rows, "active")
        return now.revision + 1

    def _claim(self, revision: int) -> None:
        """Create the file that only one writer of a revision can create."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/claims/{revision}")
        files = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        try:
            files.create(path, False).close()
        except Exception as e:
            if "exist" in str(e).lower():
                raise Conflict(f"revision {revision} is being written by another") from e
            raise

    def _add(self, revision: int, generation: str | None, digest: str | None, rows: int, status: str) -> None:
        now = self.current()
        if (now.revision if now else 0) != revision:
            raise Conflict(f"revision {now.revision if now else 0} holds, not {revision}")
        self._claim(revision + 1)
        row = [(revision + 1, generation, digest, rows, status)]
        self.spark.createDataFrame(row, "revision long, generation string, digest string, rows long, status string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Overwrite only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def entries(df: DataFrame, key: list[str], flags: list[str] = ()) -> DataFrame:
    """Rows as JSON documents without null fields; a flag is there only where it is true: (key, entry)."""
    values = [F.when(F.col(c), F.lit(True)).alias(c) if c in flags else F.col(c) for c in df.columns if c not in key]
    return df.select(*key, F.to_json(F.struct(*values)).alias("entry"))


def rows(df: DataFrame, key: str, entry: str, schema: str) -> DataFrame:
    """JSON documents as rows: fields by a schema, arrays as JSON text."""
    got = df.select(key, F.from_json(entry, schema, {"mode": "FAILFAST"}).alias("__e")).select(key, "__e.*")
    return got.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in got.dtypes])
