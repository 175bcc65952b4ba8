"""Streaming forms over the event file, run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultgrain.bindings import stream_view, table
from faultgrain.queries.lifecycle import _SETTLED_FRESH
from faultgrain.queries.registry import query
from faultgrain.queries.triage import VERDICT_SQL
from faultgrain.session import scratch_path
from faultgrain.sources.ledger import Ledger
from faultgrain.streaming.attempts import finish_verification, start_verification
from faultgrain.streaming.intake import start_intake
from faultgrain.streaming.keyed_state import attempt_states, start_attempt_states, start_first_evidence
from faultgrain.streaming.live_triage import STATE_STORE, first_evidence, keep_state_on_disk


@query(
    "SELECT DISTINCT file, concat('fn', k % 15) AS function, CAST(79 AS INT) AS cwe_id, 'pending' AS status "
    "FROM ($answers) a WHERE event_type IN ('click', 'error') OR (event_type = 'view' AND k % 4 = 2) "
    "OR (event_type = 'signup' AND k % 5 = 4)"
)
def stream_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers streamed into the ledger."""
    root, checkpoint = scratch_path(spark, "ledger"), scratch_path(spark, "stream")
    answers = stream_view(spark, sf_dir, "answers").select("file", "text")
    start_intake(answers, root, checkpoint).awaitTermination()
    return Ledger(spark, root).candidates().select("file", "function", "cwe_id", "status")


@query(f"SELECT DISTINCT evidence_key, top_frames FROM ({VERDICT_SQL}) v WHERE verdict = 'true_positive'")
def stream_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-seen evidence of a streamed run log."""
    out, checkpoint = scratch_path(spark, "evidence"), scratch_path(spark, "stream")
    provider = spark.conf.get(STATE_STORE)
    keep_state_on_disk(spark)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    # The state keeps the number of partitions it starts with: one per core.
    spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    found = first_evidence(stream_view(spark, sf_dir, "run_log")).select(
        "evidence_key", F.array_join("top_frames", "|").alias("top_frames")
    )
    writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set(STATE_STORE, provider)
    return spark.read.schema("evidence_key string, top_frames string").parquet(out)


_OUTCOME_STATUS = (
    "CASE WHEN outcome IN ('generator_refused', 'audit_rejected', 'rejected') THEN 'rejected' "
    "WHEN outcome IN ('inconclusive') THEN outcome WHEN outcome = 'proven' THEN 'proven' END"
)


@query(
    f"SELECT candidate_id AS id, coalesce(max({_OUTCOME_STATUS}), 'pending') AS status, CAST(max(fails) AS INT) AS attempts "
    f"FROM ({_SETTLED_FRESH}) s GROUP BY candidate_id"
)
def stream_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts streamed in three batches that cut runs; proven means confirmed or duplicate."""
    root, checkpoint = scratch_path(spark, "ledger"), scratch_path(spark, "stream")
    events = table(spark, sf_dir, "events")
    candidates = events.select("user_id").distinct().select(
        F.col("user_id").alias("id"),
        F.concat(F.lit("src/f"), "user_id", F.lit(".c")).alias("file"),
        F.lit("main").alias("function"),
        F.lit(20).alias("cwe_id"),
        F.lit("seen").alias("bug_category"),
        F.lit("seen").alias("description"),
        F.lit("any").alias("trigger"),
        F.lit("pending").alias("status"),
        F.lit(None).alias("reject_reason"),
        F.lit(0).alias("verify_attempts"),
    )
    Ledger(spark, root).commit(append={"open": candidates})
    folder = scratch_path(spark, "split-events")
    day = F.dayofmonth("ts")
    half = F.col("event_id") % 2 == 0  # the runs of days 10 and 20 are cut in two
    # As many files a batch as there are cores, whatever the table's.
    dealt = events.repartition(spark.sparkContext.defaultParallelism, "event_id")
    dealt = dealt.withColumn(
        "_file", (day > 10).cast("int") + (day > 20).cast("int") + (day.isin(10, 20) & half).cast("int")
    )
    for number in range(3):
        arrived = dealt.filter(F.col("_file") == number).drop("_file")
        arrived.write.mode("append").parquet(f"{folder}/events.parquet")
        attempts = stream_view(spark, folder, "attempts")
        start_verification(attempts, root, checkpoint).awaitTermination()
    finish_verification(Ledger(spark, root))
    status = F.when(F.col("status").isin("confirmed", "duplicate"), "proven").otherwise(F.col("status"))
    return Ledger(spark, root).candidates().select(
        "id", status.alias("status"), F.col("verify_attempts").alias("attempts")
    )


@query(
    f"SELECT candidate_id AS id, coalesce(max({_OUTCOME_STATUS}), 'pending') AS status, CAST(max(fails) AS INT) AS attempts "
    f"FROM ({_SETTLED_FRESH}) s GROUP BY candidate_id"
)
def stream_attempt_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts streamed out of order in three batches that cut nearly every run, counted in keyed state."""
    folder, out, checkpoint = (scratch_path(spark, name) for name in ("split-events", "states", "stream"))
    events = table(spark, sf_dir, "events")
    provider, partitions = spark.conf.get(STATE_STORE), spark.conf.get("spark.sql.shuffle.partitions")
    keep_state_on_disk(spark)
    spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    try:
        for part in (2, 0, 1):
            arrived = events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part)
            arrived.write.mode("append").parquet(f"{folder}/events.parquet")
            start_attempt_states(stream_view(spark, folder, "attempts"), out, checkpoint).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set(STATE_STORE, provider)
    return attempt_states(spark, out).select(F.col("candidate_id").alias("id"), "status", "attempts")


@query(f"SELECT DISTINCT evidence_key FROM ({VERDICT_SQL}) v WHERE verdict = 'true_positive'")
def stream_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proven evidence streamed in two batches into the ledger: state of bounded age, then the key table."""
    root, folder, checkpoint = (scratch_path(spark, name) for name in ("ledger", "split-events", "stream"))
    events = table(spark, sf_dir, "events")
    provider, partitions = spark.conf.get(STATE_STORE), spark.conf.get("spark.sql.shuffle.partitions")
    keep_state_on_disk(spark)
    spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    try:
        for part in range(2):
            events.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{folder}/events.parquet")
            start_first_evidence(stream_view(spark, folder, "run_log"), root, checkpoint, "1 second").awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set(STATE_STORE, provider)
    return Ledger(spark, root).read("confirmed").select("evidence_key")
