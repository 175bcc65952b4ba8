"""Answers kept as they come, so that no prompt is paid for twice.

An answer is stored under the digest of its stage and prompt. Prompts are asked in batches of bounded
bytes, each a job that adds its answers to the journal when it ends: a job that dies loses one batch,
and the next run asks only what no batch has stored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultgrain.operators.first_wins import first_per_key
from faultgrain.plans.skew import lookup
from faultgrain.session import scratch_path

ENTRIES = "digest STRING, text STRING, failure STRING, job STRING"
BATCH_BYTES = 1 << 30


def digest_of(stage: str, prompt: Column) -> Column:
    """What an answer is stored under."""
    return F.sha2(F.concat(F.lit(f"{len(stage)}:{stage}"), prompt), 256)


class Journal:
    """``batch_bytes`` of prompts are asked at a time: the most that a lost job has to ask again."""

    def __init__(self, spark: SparkSession, root: str, batch_bytes: int = BATCH_BYTES) -> None:
        self.spark, self._root, self.batch_bytes = spark, root.rstrip("/"), batch_bytes

    def entries(self) -> DataFrame:
        """``digest, text, failure, job``: every call that came back, broken ones with their failure."""
        try:
            return self.spark.read.schema(ENTRIES).parquet(self._root)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ENTRIES)

    def answers(self) -> DataFrame:
        """``digest, text``, one answer a digest."""
        good = self.entries().filter("failure IS NULL")
        return first_per_key(good, ["digest"], ["job", "text"]).select("digest", "text")

    def ask(
        self, prompts: DataFrame, ask: Callable[[DataFrame], DataFrame], stage: str = "", fail_fast: bool = False
    ) -> DataFrame:
        """``key, text, failure`` for each prompt (key, prompt), of which only those without an answer are asked.

        Prompts alike are asked once. ``ask`` turns (key, prompt) into (key, text, failure). Broken calls are not
        answers: the next run asks them again; with ``fail_fast`` one ends the job as soon as its batch is stored.
        """
        job = uuid.uuid4().hex
        named = prompts.select("key", "prompt", digest_of(stage, F.col("prompt")).alias("digest"))
        # A missing prompt has no digest and is asked on its own.
        todo = lookup(named, self.answers().select("digest"), ["digest"], ["key"], "left_anti")
        todo = first_per_key(todo.select("digest", "prompt"), ["digest"], ["prompt"])
        size = todo.agg(F.coalesce(F.sum(F.octet_length("prompt")), F.lit(0))).first()[0]
        batches = -(-size // self.batch_bytes)
        # Stored by batch, so that each job opens its own prompts only.
        folder = scratch_path(self.spark, "asked")
        batch = F.pmod(F.xxhash64("digest"), F.lit(max(1, batches)))
        todo.withColumn("batch", batch).write.partitionBy("batch").parquet(folder)
        stored = self.spark.read.schema("digest STRING, prompt STRING, batch BIGINT").parquet(folder)
        for number in range(batches):
            part = stored.filter(F.col("batch") == number).select(F.col("digest").alias("key"), "prompt")
            came = ask(part).select(F.col("key").alias("digest"), "text", "failure", F.lit(job).alias("job"))
            came.write.mode("append").parquet(self._root)
            if fail_fast and (broken := self._broken(job).first()):
                raise RuntimeError(f"{broken.digest}: {broken.failure}")
        told = self.answers().withColumn("failure", F.lit(None).cast("string"))
        told = told.unionByName(self._broken(job).select("digest", "text", "failure"))
        return lookup(named.select("key", "digest"), told, ["digest"], ["key"]).select("key", "text", "failure")

    def _broken(self, job: str) -> DataFrame:
        return self.entries().filter((F.col("job") == job) & F.col("failure").isNotNull())
