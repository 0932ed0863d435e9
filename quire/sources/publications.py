"""Several tables that are published together, in generations.

A generation's tables are written whole to a folder of its own and checked, each alone and against each other, on what was
read back. Then one file, `manifests/<revision>.json`, is put in place by one rename that fails if the file exists. A reader
takes the newest manifest, so it sees all tables of one revision or all of another; of two writers that started from the same
revision one fails; a writer that dies before the rename leaves folders that no manifest names, and nothing else to clear.
The file system must rename without overwriting in one step, as HDFS does.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from quire.sources.writers import Conflict, digest


class Invalid(RuntimeError):
    """A generation that may not be published: the rows that a check found."""


Check = Callable[[dict[str, DataFrame]], DataFrame]


def orphans(child: str, column: str, parent: str, parent_column: str | None = None) -> Check:
    """A check that each value of a column is there in another table; null counts as no value."""

    def find(tables: dict[str, DataFrame]) -> DataFrame:
        known = tables[parent].select(tables[parent][parent_column or column].alias("__key")).distinct()
        rows = tables[child].filter(tables[child][column].isNotNull())
        return rows.join(known, rows[column] == known["__key"], "left_anti")

    return find


def repeated(name: str, *columns: str) -> Check:
    """A check that a key is there once."""
    return lambda tables: tables[name].groupBy(*columns).count().filter("count > 1")


class Publication:
    """Tables at a path. A manifest has revision, created (seconds), status, and for each table its parts, folders with
    their number of rows and digest; a table that was appended to has several."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._at = hadoop.Path
        self._files = hadoop.Path(self.path).getFileSystem(self._conf)

    def manifests(self) -> list[dict]:
        """All manifests, oldest first. One small file for each revision."""
        folder = self._at(f"{self.path}/manifests")
        if not self._files.exists(folder):
            return []
        rows = self.spark.read.text(f"{self.path}/manifests/*.json", wholetext=True).collect()
        return sorted((json.loads(r.value) for r in rows), key=lambda m: m["revision"])

    def current(self) -> dict | None:
        return (self.manifests() or [None])[-1]

    def at(self, revision: int) -> dict:
        found = [m for m in self.manifests() if m["revision"] == revision]
        if not found:
            raise Conflict(f"{self.path} has no revision {revision}")
        return found[0]

    def read(self, name: str, revision: int | None = None) -> DataFrame:
        manifest = self.current() if revision is None else self.at(revision)
        if manifest is None or name not in manifest["tables"]:
            raise Conflict(f"{self.path} has no table {name}")
        return self._read(manifest["tables"][name])

    def _read(self, table: dict) -> DataFrame:
        parts = [self.spark.read.schema(table["schema"]).parquet(f"{self.path}/{p['folder']}") for p in table["parts"]]
        return reduce(DataFrame.unionAll, parts)  # each part may have partition folders of its own

    def publish(self, tables: dict[str, DataFrame], checks: dict[str, Check] | None = None, partition_by: dict[str, str] | None = None, expected: int | None = None, append: bool = False, created: float | None = None) -> int:
        """Write tables as a new revision, which holds from then on. With `append` they are added to those that hold, as
        further parts; tables that are not given stay. `expected` is the revision that the caller started from."""
        before = self.current()
        revision = before["revision"] if before else 0
        if expected is not None and expected != revision:
            raise Conflict(f"revision {revision} holds, not {expected}")
        generation = f"generations/{uuid.uuid4().hex}"
        new: dict[str, dict] = dict(before["tables"]) if append and before else {}
        for name, df in tables.items():
            by = (partition_by or {}).get(name)
            fields = [f for f in df.schema if f.name != by] + [f for f in df.schema if f.name == by]
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
            if append and name in new and new[name]["schema"] != schema:
                raise Invalid(f"{name} has {schema}, not {new[name]['schema']}")
            writer = df.write.partitionBy(by) if by else df.write
            writer.parquet(f"{self.path}/{generation}/{name}")
            part = {"folder": f"{generation}/{name}"}
            back = self._read({"schema": schema, "parts": [part]})
            found = digest(back)
            part |= {"rows": int(found.split("-")[0]), "digest": found}  # the digest begins with the number of rows
            new[name] = {"schema": schema, "parts": [*(new[name]["parts"] if append and name in new else []), part]}
        back = {name: self._read(t) for name, t in new.items()}
        for what, check in (checks or {}).items():
            wrong = check(back).limit(5).collect()
            if wrong:
                raise Invalid(f"{what}: {wrong}")
        return self._put(revision, {"created": time.time() if created is None else created, "status": "active", "tables": new})

    def restore(self, revision: int) -> int:
        """Make an earlier revision hold again, as a new one, if its tables still have their digests."""
        old = self.at(revision)
        damaged = self.damaged(revision)
        if damaged:
            raise Invalid(f"revision {revision} has other rows than were written: {damaged}")
        now = self.current()["revision"]
        return self._put(now, {"created": time.time(), "status": f"restored from {revision}", "tables": old["tables"]})

    def damaged(self, revision: int | None = None) -> list[str]:
        """The parts of a revision that have not the rows they were written with, or are not there."""
        manifest = self.current() if revision is None else self.at(revision)
        out = []
        for table in manifest["tables"].values():
            for part in table["parts"]:
                there = self._files.exists(self._at(f"{self.path}/{part['folder']}"))
                if not there or digest(self._read(table | {"parts": [part]})) != part["digest"]:
                    out.append(part["folder"])
        return out

    def purge(self, before: float) -> list[str]:
        """Delete the generations that only manifests older than `before` name, never those of the one that holds, and
        those that no manifest names and that are older. Their folders, sorted."""
        known = self.manifests()
        names = lambda ms: {p["folder"].split("/")[1] for m in ms for t in m["tables"].values() for p in t["parts"]}
        kept = names([m for m in known if m["created"] >= before] + known[-1:])
        listed = self._files.listStatus(self._at(f"{self.path}/generations")) if known else []
        ages = {s.getPath().getName(): s.getModificationTime() / 1000 for s in listed}
        gone = sorted(g for g, t in ages.items() if g not in kept and (g in names(known) or t < before))
        for g in gone:
            self._files.delete(self._at(f"{self.path}/generations/{g}"), True)
        return gone

    def _put(self, revision: int, manifest: dict) -> int:
        """The one step that publishes: a rename to a name that must not exist."""
        text = json.dumps({"revision": revision + 1, **manifest}, sort_keys=True)
        staged = self._at(f"{self.path}/staged/{uuid.uuid4().hex}.json")
        final = self._at(f"{self.path}/manifests/{revision + 1:012d}.json")
        out = self._files.create(staged, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._files.mkdirs(final.getParent())
        fs = self.spark._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            context.rename(staged, final, options)
        except Exception as e:
            self._files.delete(staged, False)
            if "exist" in str(e).lower():
                raise Conflict(f"revision {revision + 1} was published by another") from e
            raise
        return revision + 1
