"""The candidate, confirmed and explored tables as versioned Parquet.

A commit costs what it changes: new rows are appended, and a verification rewrites only
the pending candidates. Which keys are taken stands in narrow tables stored in buckets, so that a
batch finds its new keys without moving the stored ones, and the next ids stand in the manifest.

Every commit writes its tables into new folders and then one row per table into the
manifest, in a single file. Spark publishes that file last and by one rename, so readers
see all tables of a commit or none, and a failed commit leaves only unused folders. One
job commits at a time. When a table has FAN_IN folders of a level, the commit merges them into one of the
next, so n commits leave some log n folders and a row is written again log n times. Folders that
were merged or replaced are kept: a reader may still hold them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultgrain.schemas import LEDGER_ENTERED, LEDGER_KEYS, LEDGER_TABLES
from faultgrain.sources.buckets import read_buckets, write_buckets

_MANIFEST = "version BIGINT, name STRING, paths ARRAY<STRING>, tag STRING, next_id BIGINT"
_FOLDER = re.compile(r"/v\d+-l(\d+)-b(\d+)-[0-9a-f]+$")

FAN_IN = 4
BUCKETS = 8
# A whole new content is merged with nothing that is added later.
_WHOLE = 99


class Ledger:
    """``buckets`` is the number of files a commit may add to a key table; it may differ from commit to commit,
    but a key table's folders of another number cost an exchange of the batch, not of the folder."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        tables: Mapping[str, str] = LEDGER_TABLES,
        keys: Mapping[str, Sequence[str]] = LEDGER_KEYS,
        entered: Mapping[str, str] = LEDGER_ENTERED,
        buckets: int = BUCKETS,
    ) -> None:
        self.spark, self._root, self._tables = spark, root.rstrip("/"), dict(tables)
        self._keys, self._entered, self.buckets = dict(keys), dict(entered), buckets

    def _manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self._root}/manifest")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _MANIFEST)

    def _current(self) -> tuple[int, dict[str, list[str]], dict[str, int]]:
        """The newest version, each table's folders and its next id (a handful of rows)."""
        manifest = self._manifest()
        newest = manifest.filter(F.col("version") == manifest.agg(F.max("version")).scalar())
        rows = newest.collect()
        ids = {row.name: row.next_id for row in rows if row.next_id is not None}
        return (rows[0].version if rows else 0), {row.name: row.paths for row in rows}, ids

    @property
    def version(self) -> int:
        return self._current()[0]

    def folders(self, name: str) -> list[str]:
        """Where a table's rows are."""
        return self._current()[1].get(name, [])

    def next_id(self, name: str) -> int:
        """One more than the largest id the table ever had; nothing of it is read."""
        return self._current()[2].get(name, 1)

    def has_tag(self, tag: str) -> bool:
        """A commit with this tag exists; lets a repeated batch be skipped."""
        return not self._manifest().filter(F.col("tag") == tag).isEmpty()

    def _read(self, name: str, folder: str) -> DataFrame:
        layout, named = self._tables[name], _FOLDER.search(folder)
        if named and int(named[2]):
            return read_buckets(self.spark, folder, layout, self._keys[name], int(named[2]))
        return self.spark.read.schema(layout).parquet(folder)

    def runs(self, name: str) -> list[DataFrame]:
        """A table's folders, each as rows of its own; those of a key table are bucketed by the key."""
        return [self._read(name, folder) for folder in self.folders(name)]

    def read(self, name: str) -> DataFrame:
        runs = self.runs(name)
        return reduce(DataFrame.unionAll, runs) if runs else self.spark.createDataFrame([], self._tables[name])

    def candidates(self) -> DataFrame:
        """All candidates, pending and settled."""
        return self.read("open").unionByName(self.read("closed"))

    def _write(self, name: str, rows: DataFrame, version: int, level: int) -> str:
        layout = StructType.fromDDL(self._tables[name])
        rows = rows.select(*(F.col(field.name).cast(field.dataType) for field in layout))
        buckets = self.buckets if name in self._keys else 0
        folder = f"{self._root}/{name}/v{version}-l{level}-b{buckets}-{uuid.uuid4().hex}"
        if buckets:
            write_buckets(rows, folder, self._keys[name], buckets)
        else:
            rows.write.parquet(folder)
        return folder

    def _merged(self, name: str, folders: list[str], version: int) -> list[str]:
        """``folders`` with FAN_IN of one level made one of the next, as long as there are as many."""
        by_level: dict[int, list[str]] = {}
        for folder in folders:
            named = _FOLDER.search(folder)
            by_level.setdefault(int(named[1]) if named else 0, []).append(folder)
        level = next((n for n, own in sorted(by_level.items()) if len(own) >= FAN_IN and n < _WHOLE), None)
        if level is None:
            return folders
        rows = reduce(DataFrame.unionAll, (self._read(name, folder) for folder in by_level[level]))
        whole = self._write(name, rows, version, level + 1)
        left = [folder for folder in folders if folder not in by_level[level]]
        return self._merged(name, [*left, whole], version)

    def commit(
        self,
        append: Mapping[str, DataFrame] | None = None,
        replace: Mapping[str, DataFrame] | None = None,
        tag: str = "",
    ) -> int:
        """Add rows to tables, or give tables a whole new content; returns the new version.

        Rows added to a table that has a key table enter their keys there too.
        """
        version, paths, ids = self._current()
        version += 1

        def add(name: str, rows: DataFrame) -> str:
            folder = self._write(name, rows, version, 0)
            paths[name] = self._merged(name, [*paths.get(name, ()), folder], version)
            return folder

        def count(name: str, folder: str) -> None:
            if "id" in StructType.fromDDL(self._tables[name]).names and name not in self._keys:
                largest = self._read(name, folder).agg(F.max("id")).first()[0]
                ids[name] = max(ids.get(name, 1), (largest or 0) + 1)

        for name, rows in (append or {}).items():
            folder = add(name, rows)
            count(name, folder)
            if entry := self._entered.get(name):
                add(entry, self._read(name, folder))
        for name, rows in (replace or {}).items():
            paths[name] = [self._write(name, rows, version, _WHOLE)]
            count(name, paths[name][0])
        rows = [(version, name, folders, tag, ids.get(name)) for name, folders in paths.items()]
        entry = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        entry.write.mode("append").parquet(f"{self._root}/manifest")
        return version


def split_by_status(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows for the ``open`` table and rows for the ``closed`` one."""
    return pending(candidates), candidates.filter(F.col("status") != "pending")


def by_id(table: DataFrame, row_id: int) -> DataFrame:
    """Zero or one row; the filter reaches the scan."""
    return table.filter(F.col("id") == row_id)


def in_id_order(table: DataFrame) -> DataFrame:
    return table.orderBy("id")


def pending(candidates: DataFrame) -> DataFrame:
    """Candidates still to be verified; order them with ``in_id_order``."""
    return candidates.filter(F.col("status") == "pending")
