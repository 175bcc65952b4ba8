"""Text sinks: the report and the probe scripts."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultgrain.operators.report import ORDER


def write_report(blocks: DataFrame, folder: str) -> None:
    """Write the blocks as text parts whose names are in report order.

    The sort is a range sort over all tasks; concatenating the parts gives the document.
    The target must be a new folder and is complete once it holds ``_SUCCESS``.
    """
    blocks.orderBy(*ORDER).select("text").write.text(folder)


_PUBLISHED = "number BIGINT, folder STRING"


def _published(spark: SparkSession, target: str) -> tuple[int, str | None]:
    """The number and folder of the report that readers see; 0 and none before the first."""
    try:
        entries = spark.read.schema(_PUBLISHED).parquet(f"{target}/published")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    newest = entries.agg(F.max(F.struct("number", "folder")).alias("newest")).first().newest
    return newest.number, newest.folder


def publish_report(blocks: DataFrame, target: str) -> None:
    """Make the blocks the report of ``target``, in place of the one before.

    Tasks write the parts to a new folder; then one entry names it, in a file that Spark commits by one
    rename. Readers see the old report or the new one, and a write that fails leaves the old one. One job
    publishes at a time.
    """
    target, folder = target.rstrip("/"), f"text-{uuid.uuid4().hex}"
    write_report(blocks, f"{target}/{folder}")
    entry = [(_published(blocks.sparkSession, target)[0] + 1, folder)]
    blocks.sparkSession.createDataFrame(entry, _PUBLISHED).coalesce(1).write.mode("append").parquet(f"{target}/published")


def read_report(spark: SparkSession, target: str) -> DataFrame:
    """``position, line`` of the published report, positions from 1; no rows before the first."""
    target = target.rstrip("/")
    folder = _published(spark, target)[1]
    if folder is None:
        return spark.createDataFrame([], "position long, line string")
    # A part is what one task of the sort wrote; its name says which.
    parts = spark.read.text(f"{target}/{folder}", wholetext=True).select(F.col("_metadata.file_name").alias("part"), "value")
    parts = parts.withColumn("lines", F.split(F.regexp_replace("value", r"\n\z", ""), "\n"))
    # One row a part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select("part", F.size("lines").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    lines = parts.select("part", F.posexplode("lines").alias("at", "line")).join(F.broadcast(first), "part")
    return lines.select((F.col("first") + F.col("at") + 1).cast("long").alias("position"), "line")


def write_probes(probes: DataFrame, folder: str, *carried: str) -> None:
    """The latest probes as rows (name, candidate_id, interpreter, script) in a new folder."""
    name = F.concat(F.lit("probe_"), F.col("candidate_id")).alias("name")
    probes.select(name, "candidate_id", "interpreter", "script", *carried).write.parquet(folder)
