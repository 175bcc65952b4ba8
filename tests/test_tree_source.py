"""The tree data source, in one read and as a stream."""

import os

import pytest

from faultgrain.sources import tree_source


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "src"
    for path, data in (
        ("app.py", b"x = 1\n"), ("__init__.py", b""), ("_private/a.py", b"a"), (".hidden.py", b"h"), (".git/hook.py", b"g"),
        ("node_modules/x.js", b"n"), ("deep/er/z.c", "é".encode()), ("deep/er/est/y.c", b"y"), ("bad.py", b"a\xffb"),
    ):
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_bytes(data)
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "secret.py").write_text("no")
    os.symlink(tmp_path / "outside", base / "linked")
    os.symlink(tmp_path / "outside" / "secret.py", base / "link.py")
    os.symlink(base, base / "deep" / "cycle")
    return base


def read(spark, path, **options):
    tree_source.register(spark)
    return {r.path: r.content for r in spark.read.format("file_tree").options(**options).load(str(path)).collect()}


SEEN = {
    "app.py": "x = 1\n", "__init__.py": "", "_private/a.py": "a", ".hidden.py": "h", "deep/er/z.c": "é", "deep/er/est/y.c": "y", "bad.py": "a�b",
}


def test_one_read(spark, root):
    assert read(spark, root) == read(spark, f"file:{root}") == SEEN
    assert read(spark, root, hidden="true") == SEEN | {".git/hook.py": "g", "node_modules/x.js": "n"}
    tree_source.register(spark)
    frame = spark.read.format("file_tree").load(str(root))
    assert len(frame.schema) == 2 and frame.rdd.getNumPartitions() >= 4


def test_partitions_hold_every_file_once(root, monkeypatch):
    files = tree_source._Files(str(root), False)
    for folders, most in ((1, 1), (2, 2), (256, 1)):
        monkeypatch.setattr(tree_source, "FOLDERS", folders)
        monkeypatch.setattr(tree_source, "FILES", most)
        parts = tree_source.TreeReader(files).partitions()
        rows = [row for part in parts for row in tree_source._rows(files, part)]
        assert len(rows) == len(SEEN) and dict(rows) == SEEN


def test_a_uri_goes_through_the_store(root):
    class Store(tree_source._Files):
        def __init__(self, path):
            from pyarrow.fs import LocalFileSystem

            self._hidden, self._store, self._root = False, LocalFileSystem(), path

    found = {path: Store(str(root)).read(path) for path in Store(str(root)).walk("_private")}
    assert found == {"_private/a.py": b"a"}


def test_folders_arrive_one_after_another(spark, root, tmp_path):
    tree_source.register(spark)
    inbox, out = tmp_path / "inbox", str(tmp_path / "out")
    inbox.mkdir()

    def run():
        stream = spark.readStream.format("file_tree").load(str(inbox))
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck"))
        query = writer.trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        return sorted(r.path for r in spark.read.schema("path string, content string").parquet(out).collect())

    for day, names in (("day1", ["a.py", "sub/b.py"]), ("day2", ["c.py"])):
        for name in names:
            (inbox / day / name).parent.mkdir(parents=True, exist_ok=True)
            (inbox / day / name).write_text(name)
        found = run()
    assert found == ["day1/a.py", "day1/sub/b.py", "day2/c.py"]
    assert run() == found
