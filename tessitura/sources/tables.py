"""Versioned table folders: batches of Parquet under a manifest, for appended batches, merges by key and read-only roots.

A root holds tables; a table holds ``data/<batch>`` folders and ``manifest/<version>`` folders, each the full list of the batches that
make up that version. A batch is written under its own name before a manifest names it, so a retried batch replaces its own folder and
counts once, and a reader sees the last complete version or nothing. One writer at a time commits to a table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessitura.sources.songs import upsert

MANIFEST = "batch string, place int"


@dataclass(frozen=True)
class Root:
    """A catalogue of versioned tables in a folder that all executors share."""

    spark: SparkSession
    path: str
    read_only: bool = False

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self, table: str) -> list[int]:
        """The complete versions of a table: those whose manifest Spark has finished."""
        folder = f"{self.path}/{table}/manifest"
        return [int(v) for v in self._names(folder) if "_SUCCESS" in self._names(f"{folder}/{v}")]

    def tables(self) -> list[str]:
        return [t for t in self._names(self.path) if self.versions(t)]

    def batches(self, table: str, version: int | None = None) -> list[str]:
        known = self.versions(table)
        if not known:
            return []
        version = max(known) if version is None else version
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/{table}/manifest/{version:08d}").orderBy("place").collect()  # a row a batch
        return [r["batch"] for r in rows]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        found = self.batches(table, version)
        if not found:
            raise KeyError(f"no table {table} in {self.path}")
        return self.spark.read.parquet(*(f"{self.path}/{table}/data/{b}" for b in found))

    def _commit(self, table: str, batches: list[str]) -> int:
        version = max(self.versions(table), default=0) + 1
        rows = self.spark.createDataFrame([(b, i) for i, b in enumerate(batches)], MANIFEST)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{table}/manifest/{version:08d}")
        return version

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError(f"{self.path} is attached read-only")

    def append(self, table: str, rows: DataFrame, batch: str) -> int:
        """Add ``rows`` as ``batch``; the same batch again replaces what it wrote before. Returns the table's version."""
        self._writable()
        known = self.batches(table)
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/data/{batch}")
        return max(self.versions(table)) if batch in known else self._commit(table, [*known, batch])

    def merge(self, table: str, rows: DataFrame, key: str, version: str) -> int:
        """Upsert by ``key``: of equal keys the row with the larger ``version`` stays, a fresh one on a tie. Earlier versions stay readable."""
        self._writable()
        merged = upsert(self.read(table), rows, key, version) if self.versions(table) else rows
        batch = f"merge-{uuid.uuid4().hex[:12]}"
        merged.write.parquet(f"{self.path}/{table}/data/{batch}")
        return self._commit(table, [batch])


def attach(spark: SparkSession, path: str, prefix: str) -> dict[str, str]:
    """Temporary views ``<prefix>_<table>`` over another root's latest versions, read-only; returns table: view."""
    root = Root(spark, path, read_only=True)
    views = {t: f"{prefix}_{t}" for t in root.tables()}
    for t, view in views.items():
        root.read(t).createOrReplaceTempView(view)
    return views

