"""Directory trees as a data source of Spark's own: ``spark.read.format("file_tree").load(root)``.

The driver lists the upper levels of the tree until there are enough folders to share out; each partition
walks one folder, or a share of its files, so neither names nor contents of what lies below pass through the
driver. ``root`` is a path of a mounted disk, where links are left out, or a URI of an object store or file
system that pyarrow knows (``s3://``, ``gs://``, ``hdfs://``).

As a stream the folders directly below the root are read in the order of their names; each has to appear
complete, under a name after those before it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from faultgrain.functions.paths import VENDOR_DIRS

FORMAT = "file_tree"
# The driver goes down a level while there are fewer folders than this.
FOLDERS = 256
# Files of one listed folder that a partition reads, and into how many shares a folder that is walked is cut.
FILES, SHARES = 2_000, 4


@dataclass
class Part(InputPartition):
    """The files of a folder, with those of the folders below it or without, that fall into one of its shares."""

    folder: str
    below: bool
    share: int
    shares: int


class _Files:
    """A tree's folders and files by paths relative to its root."""

    def __init__(self, root: str, hidden: bool) -> None:
        self._hidden, self._store = hidden, None
        if "://" in root.removeprefix("file:"):
            from pyarrow.fs import FileSystem

            self._store, self._root = FileSystem.from_uri(root)
        else:
            self._root = "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root
        self._root = self._root.rstrip("/")

    def _named(self, folder: str, name: str) -> str:
        return f"{folder}/{name}" if folder else name

    def _entries(self, folder: str) -> Iterator[tuple[str, bool]]:
        place = f"{self._root}/{folder}" if folder else self._root
        if self._store is None:
            with os.scandir(place) as found:
                for entry in found:
                    if entry.is_dir(follow_symlinks=False) or entry.is_file(follow_symlinks=False):
                        yield entry.name, entry.is_dir(follow_symlinks=False)
            return
        from pyarrow.fs import FileSelector, FileType

        for entry in self._store.get_file_info(FileSelector(place)):
            if entry.type in (FileType.Directory, FileType.File):
                yield entry.base_name, entry.type == FileType.Directory

    def list(self, folder: str) -> tuple[list[str], list[str]]:
        """The folders and the files directly inside."""
        folders, files = [], []
        for name, is_folder in self._entries(folder):
            if not is_folder:
                files.append(self._named(folder, name))
            elif self._hidden or not (name.startswith(".") or name in VENDOR_DIRS):
                folders.append(self._named(folder, name))
        return sorted(folders), files

    def walk(self, folder: str) -> Iterator[str]:
        left = [folder]
        while left:
            folders, files = self.list(left.pop())
            yield from files
            left += reversed(folders)

    def read(self, path: str) -> bytes:
        if self._store is None:
            with open(f"{self._root}/{path}", "rb") as source:
                return source.read()
        with self._store.open_input_file(f"{self._root}/{path}") as source:
            return source.read()


def _shares(folder: str, below: bool, shares: int) -> list[Part]:
    return [Part(folder, below, share, shares) for share in range(shares)]


def _rows(files: _Files, part: Part) -> Iterator[tuple[str, str]]:
    for path in files.walk(part.folder) if part.below else files.list(part.folder)[1]:
        if zlib.crc32(path.encode(errors="surrogateescape")) % part.shares == part.share:
            yield path, files.read(path).decode("utf-8", "replace")


class TreeReader(DataSourceReader):
    def __init__(self, files: _Files) -> None:
        self._files = files

    def partitions(self) -> list[Part]:
        parts, level = [], [""]
        while level and len(level) < FOLDERS:
            deeper = []
            for folder in level:
                folders, files = self._files.list(folder)
                deeper += folders
                parts += _shares(folder, False, -(-len(files) // FILES))
            level = deeper
        return parts + [part for folder in level for part in _shares(folder, True, SHARES)]

    def read(self, partition: Part) -> Iterator[tuple[str, str]]:
        return _rows(self._files, partition)


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, files: _Files) -> None:
        self._files = files

    def initialOffset(self) -> dict:
        return {"folder": ""}

    def latestOffset(self) -> dict:
        return {"folder": max(self._files.list("")[0], default="")}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        came = [f for f in self._files.list("")[0] if start["folder"] < f <= end["folder"]]
        return [part for folder in came for part in _shares(folder, True, SHARES)]

    def read(self, partition: Part) -> Iterator[tuple[str, str]]:
        return _rows(self._files, partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept: the folders stay where they are."""


class TreeSource(DataSource):
    """``path, content``; option ``hidden`` is ``true`` to enter hidden and vendor folders as well."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content string"

    def _files(self) -> _Files:
        return _Files(self.options["path"], str(self.options.get("hidden", "false")).lower() == "true")

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(self._files())

    def streamReader(self, schema: object) -> TreeStreamReader:
        return TreeStreamReader(self._files())


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(TreeSource)
