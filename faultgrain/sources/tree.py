"""Directory trees on a shared file system as file tables.

Folders are listed level by level inside tasks and files are read inside tasks, so neither
names nor contents pass through the driver. Spark's own file sources cannot be used here:
they hide names starting with ``_`` or ``.`` and follow links.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultgrain.functions.paths import VENDOR_DIRS
from faultgrain.functions.text import decode_utf8
from faultgrain.session import materialize

_ENTRY = "path string, is_dir boolean"
# Contents handed to Spark at a time.
_BATCH_BYTES = 16 << 20


def mounted_path(root: str) -> str:
    """A ``file:`` URI or plain path as a path of the mounted file system."""
    path = root.removeprefix("file:")
    if "://" in path.lstrip("/"):
        raise ValueError(f"{root} is not on a mounted file system")
    return "/" + path.lstrip("/") if root.startswith("file:") else path


def _list_level(folders: DataFrame, root: str, skip_dirs: bool) -> DataFrame:
    """Files and folders directly inside ``folders``; links are left out."""

    def keep(entry: os.DirEntry) -> bool:
        if entry.is_symlink():
            return False
        if entry.is_dir(follow_symlinks=False):
            return not (skip_dirs and (entry.name.startswith(".") or entry.name in VENDOR_DIRS))
        return entry.is_file(follow_symlinks=False)

    def entries(folder: str) -> Iterator[tuple[str, bool]]:
        with os.scandir(os.path.join(root, folder)) as found:
            for entry in filter(keep, found):
                name = f"{folder}/{entry.name}" if folder else entry.name
                yield name, entry.is_dir(follow_symlinks=False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                rows: list[tuple[str, bool]] = []
                for row in entries(folder):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["path", "is_dir"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "is_dir"])

    return folders.select("path").mapInPandas(run, _ENTRY)


def list_tree(spark: SparkSession, root: str, skip_dirs: bool = True) -> DataFrame:
    """Relative paths of all regular files below ``root`` (column ``path``).

    Links are not followed; hidden and vendor folders are not entered unless ``skip_dirs``
    is off. One job per level of the tree.
    """
    root = mounted_path(root)
    files, folders = None, spark.createDataFrame([("",)], "path string")
    while True:
        level = materialize(_list_level(folders, root, skip_dirs), "tree-level")
        found = level.filter("NOT is_dir").select("path")
        files = found if files is None else files.unionByName(found)
        folders = level.filter("is_dir").select("path").repartition("path")
        if folders.isEmpty():
            return files


def read_tree(spark: SparkSession, root: str, skip_dirs: bool = True) -> DataFrame:
    """``files(path, content)`` with bytes decoded as UTF-8, bad bytes as U+FFFD."""
    base = mounted_path(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple[str, bytes]] = []
            size = 0
            for path in batch["path"]:
                with open(os.path.join(base, path), "rb") as source:
                    rows.append((path, source.read()))
                size += len(rows[-1][1])
                if size >= _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "raw"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["path", "raw"])

    listed = list_tree(spark, root, skip_dirs).repartition("path")
    raw = listed.mapInPandas(run, "path string, raw binary")
    return raw.select("path", decode_utf8(F.col("raw")).alias("content"))
