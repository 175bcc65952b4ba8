"""Session helpers: the shared scratch folder and cutting lineage through it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


# The folders made inside the innermost ``scratch_scope`` of this thread.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("faultgrain")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster other
    machines could not read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="faultgrain-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused folder name below the scratch root; a ``scratch_scope`` around the call removes it."""
    path = f"{scratch_root(spark)}/faultgrain/{label}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, through Spark's file systems."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written inside are deleted at the end, when nothing may read them any more.

    What is to stay has to be stored before under a path taken outside: until then a lost executor's tasks
    may read every scratch table again.
    """
    token = _made.set([])
    try:
        yield
    finally:
        for path in _made.get():
            remove(spark, path)
        _made.reset(token)


def stored(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written to the shared folder and read back; all other scratch tables it made are deleted."""
    path = scratch_path(spark, label)
    with scratch_scope(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, in the session ``spark`` if given.

    Cuts the lineage and fixes results that must not change when a lost executor's
    tasks run again: sampled range bounds, answers of outside services.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return (spark or df.sparkSession).read.schema(df.schema).parquet(path)
