"""Stored tables that are appended to, edited and deleted from, a version at a time.

A store is a folder on a file system whose renames are atomic. Rows stand in Parquet folders that never change, one for each bucket of a table's key and write.
A version is a small file that names the folders of every table and the changes that have been applied; it appears by one rename, which fails if another
writer was first, and then the change is worked out anew on that writer's version. So a change of several tables is there as a whole or not at all; one that is run
again does nothing; what a stopped run has written is in no version; and a reader keeps the version that it has opened. Deletes and edits write only the
buckets that hold their rows, and only what a version names of them is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Attempts at a version when others keep coming first.
ATTEMPTS = 20
BUCKET = "__bucket"


@dataclass(frozen=True)
class Table:
    """schema: DDL of its rows; key: the columns that its buckets, edits and insertions go by; folders: by bucket."""

    schema: str
    key: tuple[str, ...]
    buckets: int
    folders: dict[str, tuple[str, ...]]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.key]), F.lit(self.buckets)).cast("int")


Tables = dict[str, Table]


class Snapshot:
    """The tables of one version."""

    def __init__(self, spark: SparkSession, path: str, version: int, tables: Tables, applied: tuple[str, ...]):
        self.spark, self.path, self.version, self.tables, self.applied = spark, path, version, tables, applied

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some buckets of it."""
        table = self.tables[name]
        schema = T.StructType.fromDDL(table.schema)
        folders = [f"{self.path}/{f}" for b, own in table.folders.items() if buckets is None or int(b) in buckets for f in own]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def held(self, name: str, where: DataFrame | Column) -> list[int]:
        """Buckets with rows that a condition finds, or that have the keys of a table."""
        table = self.tables[name]
        rows = where if isinstance(where, DataFrame) else self.read(name).where(where)
        return [r[BUCKET] for r in rows.select(table.bucket().alias(BUCKET)).distinct().collect()]  # table.buckets at most


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._at = jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, or the newest; version 0 is empty."""
        there = self.versions()
        version = (there[-1] if there else 0) if version is None else version
        if not version:
            return Snapshot(self.spark, self.path, 0, {}, ())
        if version not in there:
            raise ValueError(f"there is no version {version} of {self.path}")
        said = json.loads(self.spark.read.text(f"{self.path}/versions/{version:010}.json", wholetext=True).first()[0])
        tables = {n: Table(t["schema"], tuple(t["key"]), t["buckets"], {b: tuple(f) for b, f in t["folders"].items()}) for n, t in said["tables"].items()}
        return Snapshot(self.spark, self.path, version, tables, tuple(said["applied"]))

    def _commit(self, version: int, tables: Tables, applied: tuple[str, ...]) -> bool:
        """Whether this version is ours now; False if another writer has it."""
        said = {"tables": {n: {"schema": t.schema, "key": t.key, "buckets": t.buckets, "folders": t.folders} for n, t in tables.items()}, "applied": applied}
        part = self._at(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(part)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        final = self._at(f"{self.path}/versions/{version:010}.json")
        try:
            context.rename(self._fs.makeQualified(part), self._fs.makeQualified(final), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            self._fs.delete(part, False)
            if self._fs.exists(final):
                return False
            raise
        return True

    def write(self, table: Table, rows: DataFrame) -> dict[str, tuple[str, ...]]:
        """Rows in folders of their own, by bucket; in no version yet."""
        names = T.StructType.fromDDL(table.schema).names
        folder = f"data/{uuid.uuid4().hex}"
        rows.select(*[F.col(f"`{c}`") for c in names]).withColumn(BUCKET, table.bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        made = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/{folder}"))]
        return {n.split("=")[1]: (f"{folder}/{n}",) for n in made if n.startswith(f"{BUCKET}=")}

    def change(self, change_id: str, work: Callable[[Snapshot], Tables]) -> bool:
        """Apply a change once: work gives the tables that are new or different. False if it has been applied before."""
        for _ in range(ATTEMPTS):
            now = self.snapshot()
            if change_id in now.applied:
                return False
            if self._commit(now.version + 1, now.tables | work(now), (*now.applied, change_id)):
                return True
        raise PySparkException(f"{change_id}: {ATTEMPTS} versions of other writers came first")

    def create(self, name: str, schema: str, key: tuple[str, ...], buckets: int = 16) -> bool:
        return self.change(f"create {name}", lambda now: {name: Table(schema, key, buckets, {})})

    def append(self, name: str, rows: DataFrame, change_id: str) -> bool:
        """Add rows, all or none."""

        def work(now: Snapshot) -> Tables:
            table = now.tables[name]
            return {name: _with(table, {b: (*table.folders.get(b, ()), *new) for b, new in self.write(table, rows).items()})}

        return self.change(change_id, work)

    def insert_absent(self, name: str, rows: DataFrame, change_id: str) -> bool:
        """Add a row for each key that isn't there, whoever else adds it at the same time; of rows with one key, any one."""

        def work(now: Snapshot) -> Tables:
            table = now.tables[name]
            new = rows.dropDuplicates(list(table.key))
            new = new.join(now.read(name, now.held(name, new)).select(*table.key), list(table.key), "left_anti")
            return {name: _with(table, {b: (*table.folders.get(b, ()), *own) for b, own in self.write(table, new).items()})}

        return self.change(change_id, work)

    def delete(self, conditions: dict[str, Column], change_id: str) -> bool:
        """Delete the rows that fulfil a condition, of one table or of several at once."""

        def work(now: Snapshot) -> Tables:
            out = {}
            for name, condition in conditions.items():
                hit = now.held(name, condition)
                if hit:
                    out[name] = self._rewritten(now, name, hit, now.read(name, hit).where(~F.coalesce(condition, F.lit(False))))
            return out

        return self.change(change_id, work)

    def upsert(self, name: str, rows: DataFrame, change_id: str) -> bool:
        """Put rows in the place of those with their keys, or beside them. Rows' keys are unique."""

        def work(now: Snapshot) -> Tables:
            table, hit = now.tables[name], now.held(name, rows)
            stays = now.read(name, hit).join(rows.select(*table.key), list(table.key), "left_anti")
            return {name: self._rewritten(now, name, hit, stays.unionByName(rows.select(*stays.columns)))}

        return self.change(change_id, work)

    def _rewritten(self, now: Snapshot, name: str, hit: list[int], rows: DataFrame) -> Table:
        return _with(now.tables[name], {str(b): () for b in hit} | self.write(now.tables[name], rows))

    def sweep(self) -> int:
        """Remove folders that no version names, left by stopped runs; to be run while nobody writes. Gives their number."""
        named = {f.split("/")[1] for v in self.versions() for t in self.snapshot(v).tables.values() for own in t.folders.values() for f in own}
        folder = self._at(f"{self.path}/data")
        stray = [s.getPath() for s in self._fs.listStatus(folder) if s.getPath().getName() not in named] if self._fs.exists(folder) else []
        for p in stray:
            self._fs.delete(p, True)
        return len(stray)


def _with(table: Table, folders: dict[str, tuple[str, ...]]) -> Table:
    return Table(table.schema, table.key, table.buckets, {b: f for b, f in (table.folders | folders).items() if f})

