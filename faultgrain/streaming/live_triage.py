"""Run logs as a stream of first-seen evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultgrain.functions.evidence import Markers
from faultgrain.operators.triage import triage

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, not in executor memory."""
    spark.conf.set(
        STATE_STORE,
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def first_evidence(run_log: DataFrame, markers: Markers = Markers(), salts: int | None = None) -> DataFrame:
    """Proven runs of a streaming run log, one per evidence key (the first to arrive).

    Two deduplications: the first per key and salt, so a key holding much of the stream is
    spread over ``salts`` tasks (the session's shuffle partitions if not given) and sends at most as
    many rows to the second, which is per key. State grows with the number of distinct keys; call ``keep_state_on_disk`` first.
    """
    salts = salts or int(run_log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    proven = triage(run_log, markers).filter("verdict = 'true_positive'")
    salt = F.pmod(F.xxhash64("candidate_id", "run_id", "step"), F.lit(salts))
    return (
        proven.withColumn("_salt", salt)
        .dropDuplicates(["evidence_key", "_salt"])
        .dropDuplicates(["evidence_key"])
        .drop("_salt")
    )
