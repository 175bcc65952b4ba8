"""Frozen copies of a file table; every later stage reads the copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultgrain.functions.paths import has_part, language
from faultgrain.schemas import SNAPSHOT

# Folders kept out of a snapshot: the jobs' own results and version control.
EXCLUDED = (".faultgrain", ".git")


def digest_of(content: Column) -> Column:
    """What tells contents apart; a missing content is one of its own."""
    return F.coalesce(F.sha2(content, 256), F.lit("missing"))


def included(files: DataFrame, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """``files`` outside the excluded folders; links are left out, as a copy has no place for them."""
    kept = files.filter(~has_part(F.col("path"), exclude))
    return kept.filter(~F.coalesce("is_symlink", F.lit(False))) if "is_symlink" in files.columns else kept


def freeze(files: DataFrame, root: str, snapshot_id: str, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Write ``files`` once as snapshot ``snapshot_id`` and return the copy.

    The copy is stored by language, so a job for some languages opens only their files, and with a
    digest of each content, so that two snapshots are compared without their contents.
    """
    folder = f"{root.rstrip('/')}/{snapshot_id}"
    kept = included(files, exclude).select("path", "content", digest_of(F.col("content")).alias("digest"))
    by_language = kept.withColumn("language", language(F.col("path")))
    # Half the bytes of the default for the digests and texts alike; a copy is written once and read often.
    by_language.write.partitionBy("language").option("compression", "zstd").parquet(folder)
    return read_snapshot(files.sparkSession, root, snapshot_id)


def read_snapshot(spark: SparkSession, root: str, snapshot_id: str) -> DataFrame:
    """``files(path, content, digest, language)`` of a snapshot."""
    return spark.read.schema(SNAPSHOT).parquet(f"{root.rstrip('/')}/{snapshot_id}")
