"""Tables as immutable Parquet files under one chain of numbered commits.

A commit names the folders that it adds to any number of tables, so a change of several tables becomes visible at
once or not at all.  Folders are partitioned by tenant and graph and never changed; what a commit writes is in
proportion to what it changes.  A folder either holds new rows, or replaces rows by their key (an upsert), or the whole
table.  The chain is kept by creating each commit file only if it is not there yet, which needs a file system with an
atomic create; of two writers that change one table from one version one loses and derives its change again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import SCHEMAS, ConcurrentModification, SchemaMismatch

SCHEMA_VERSION = 2
SCOPE = ("tenant_id", "graph_id")
KEYS = {"runs": "run_id", "sources": "source_id", "segments": "segment_id", "nodes": "node_id", "edges": "edge_id", "changesets": "changeset_id"}
INSERT, UPSERT, REPLACE = "insert", "upsert", "replace"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._log: list[list[dict]] = []  # the commits read so far
        if not self._create("_schema", str(SCHEMA_VERSION)) and self._text("_schema") != str(SCHEMA_VERSION):
            raise SchemaMismatch(f"the store has schema {self._text('_schema')}, this library {SCHEMA_VERSION}")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _create(self, name: str, text: str) -> bool:
        """Whether the file was not there before."""
        if self._fs.exists(self._path(name)):
            return False
        try:
            stream = self._fs.create(self._path(name), False)
        except Exception:
            if self._fs.exists(self._path(name)):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commits(self) -> list[list[dict]]:
        while self._fs.exists(self._path(name := f"_commits/{len(self._log) + 1:012d}")):
            self._log.append(json.loads(self._text(name)))
        return self._log

    def version(self, table: str | None = None) -> int:
        """Of the store; with a table, that of its last change."""
        log = self._commits()
        return next((i for i in range(len(log), 0, -1) if table is None or any(c["table"] == table for c in log[i - 1])), 0)

    def _folders(self, table: str, version: int) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {INSERT: [], UPSERT: []}
        for commit in self._commits()[:version]:
            for c in commit:
                if c["table"] == table:
                    if c["mode"] == REPLACE:
                        out = {INSERT: [], UPSERT: []}
                    out[UPSERT if c["mode"] == UPSERT else INSERT].append(c["folder"])
        return out

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version (the latest without one); empty with its schema if nothing was written."""
        folders = self._folders(table, self.version() if version is None else version)
        columns = self.spark.createDataFrame([], SCHEMAS[table]).columns
        load = lambda names: self.spark.read.schema(SCHEMAS[table] + ", commit string").option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/{n}" for n in names])
        rows = load(folders[INSERT]).select(*columns) if folders[INSERT] else self.spark.createDataFrame([], SCHEMAS[table])
        if not folders[UPSERT]:
            return rows
        key = [*SCOPE, KEYS[table]]
        order = self.spark.createDataFrame([(n.removeprefix("commit="), i) for i, n in enumerate(folders[UPSERT])], "commit string, turn int")
        newer = load(folders[UPSERT]).join(F.broadcast(order), "commit")  # a row per commit
        last = newer.groupBy(*key).agg(F.max_by(F.struct(*columns), "turn").alias("row")).select("row.*")
        return rows.join(last.select(*key), key, "left_anti").unionByName(last)

    def commit(self, *changes: tuple[str, str, DataFrame], expected: int | None = None) -> int:
        """Write (table, mode, rows) changes and make them visible together; an error if one of the tables that are not
        only added to, or with ``expected`` any of them, has changed since that version."""
        seen = self.version() if expected is None else expected
        told = []
        for table, mode, rows in changes:
            folder = f"commit=c{uuid.uuid4().hex}"
            rows.select(*self.spark.createDataFrame([], SCHEMAS[table]).columns).write.partitionBy(*SCOPE).parquet(f"{self.root}/{table}/{folder}")
            told.append({"table": table, "mode": mode, "folder": folder})
        strict = {c["table"] for c in told if expected is not None or c["mode"] != INSERT}
        while True:
            for commit in self._commits()[seen:]:
                for c in commit:
                    if c["table"] in strict and (expected is not None or c["mode"] != INSERT):
                        raise ConcurrentModification(f"{c['table']} has moved past version {seen}")
            if self._create(f"_commits/{len(self._log) + 1:012d}", json.dumps(told)):
                return self.version()

    def write(self, table: str, rows: DataFrame, expected: int) -> int:
        """A whole new table after ``expected``."""
        return self.commit((table, REPLACE, rows), expected=expected)

    def append(self, table: str, rows: DataFrame) -> int:
        return self.commit((table, INSERT, rows))

    def compact(self, table: str) -> int:
        """The same rows in one folder; for a table of many commits."""
        version = self.version()
        return self.commit((table, REPLACE, self.read(table, version)), expected=version)

    def tenant_counts(self, table: str) -> DataFrame:
        return self.read(table).groupBy("tenant_id").count()

    def delete_tenant(self, tenant: str) -> None:
        """Delete a tenant's files from every version of every table; may be repeated."""
        folder = f"tenant_id={self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(tenant)}"
        for c in (c for commit in self._commits() for c in commit):
            self._fs.delete(self._path(f"{c['table']}/{c['folder']}/{folder}"), True)

    def drop(self) -> None:
        """Delete the whole store."""
        self._fs.delete(self._path(""), True)
        self._log = []
