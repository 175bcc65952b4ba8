"""File tables to the function index and the tasks of one exploration pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.functions import paths
from faultgrain.operators.spans import HANDLERS, Handler, index_files


def source_files(files: DataFrame) -> DataFrame:
    """Files of a known language outside hidden and vendor directories, with ``language``.

    A table may mark links by ``is_symlink``; they are never read. A snapshot brings its
    ``language`` along.
    """
    path = F.col("path")
    if "is_symlink" in files.columns:
        files = files.filter(~F.col("is_symlink")).drop("is_symlink")
    if "language" not in files.columns:
        files = files.withColumn("language", paths.language(path))
    return files.filter(F.col("language").isNotNull() & ~paths.in_skipped_dir(path))


def build_index(files: DataFrame, handlers: Mapping[str, Handler] = HANDLERS) -> DataFrame:
    """``file_index``: path, language, line_count and functions of every source file.

    ``functions`` is NULL when a file could not be parsed or its language has no handler,
    and empty when it has none. File contents are never shuffled.
    """
    return index_files(source_files(files).select("path", "language", "content"), handlers)


def in_index_order(index: DataFrame) -> DataFrame:
    """Rows by path components (``a/b.py`` before ``a-b.py``)."""
    return index.orderBy(paths.parts(F.col("path")))


def plan_tasks(index: DataFrame, scope: str | None = None) -> DataFrame:
    """One task per non-test file below ``scope``."""
    path = F.col("path")
    return index.filter(paths.in_scope(path, scope) & ~paths.is_test_file(path)).select(
        "path", "language", "functions"
    )


def pending_tasks(tasks: DataFrame, explored: DataFrame) -> DataFrame:
    """Tasks whose file was not explored yet."""
    return tasks.join(explored.select(F.col("file").alias("path")), "path", "left_anti")


def skipped_tasks(tasks: DataFrame, explored: DataFrame) -> DataFrame:
    """Tasks whose file was explored in an earlier run."""
    return tasks.join(explored.select(F.col("file").alias("path")), "path", "left_semi")
