"""Keyed state: attempts counted in any order, and first evidence whose state expires.

A key that holds a third of the stream sends few rows to its state: attempts are reduced inside each task
before they are dealt by candidate, evidence under salts. State lies in RocksDB (``keep_state_on_disk``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from faultgrain.functions.evidence import Markers
from faultgrain.operators.first_wins import first_per_key, latest_per_key, not_in
from faultgrain.operators.ids import assign_ids
from faultgrain.operators.lifecycle import ATTEMPT_BUDGET, FINAL_OUTCOMES, OUTCOME_BY_EVENT, REWRITE_BUDGET, STATUS_BY_OUTCOME, event_of
from faultgrain.operators.triage import triage
from faultgrain.session import materialize
from faultgrain.sources.ledger import Ledger

RATIONED = ("audit_invalid", "unreachable")
RUNS_A_BLOCK = 1024
STATE = "candidate_id long, status string, attempts int, end_run int"


def _first_steps(limit: int):
    """Of each Arrow batch the steps a run can end with: the first ending one, and ``limit`` of each rationed kind."""

    def first_steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.sort_values("step", kind="stable")
            rationed = rows["event"].isin(RATIONED)
            ends = rows["event"].isin(list(OUTCOME_BY_EVENT)) & ~rationed
            yield pd.concat(
                [
                    rows[rationed].groupby(["candidate_id", "run_id", "event"]).head(limit),
                    rows[ends].groupby(["candidate_id", "run_id"]).head(1),
                    # Nothing else ends a run, but it shows that the candidate is there.
                    rows[~ends & ~rationed].groupby("candidate_id").head(1),
                ]
            )

    return first_steps


def outcome_of(steps: dict[str, list[int]], limit: int) -> str:
    """What a run ends with, given the places of its first steps by event."""
    places = [(at[limit - 1], event) for event, at in steps.items() if event in RATIONED and len(at) >= limit]
    places += [(at[0], event) for event, at in steps.items() if event not in RATIONED]
    return OUTCOME_BY_EVENT[min(places)[1]] if places else "pending"


class AttemptFold(StatefulProcessor):
    """A candidate's runs, each by its first steps; they may come in any order and cut anywhere.

    Each call to the state is a message to the JVM, so RUNS_A_BLOCK runs are one value: a batch reads and writes
    a candidate's few blocks, not its runs one by one, and no value grows with the number of runs.
    """

    def __init__(self, rewrites: int, budget: int) -> None:
        self._limit, self._budget = rewrites + 1, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._numbers = handle.getValueState("numbers", "blocks STRING")
        self._blocks = handle.getMapState("blocks", "block INT", "runs STRING")

    def _merge(self, known: dict[str, dict[str, list[int]]], came: dict[str, dict[str, list[int]]]) -> dict[str, dict[str, list[int]]]:
        """The runs of a block with their first steps of both."""
        merged = dict(known)
        for run_id, steps in came.items():
            before = known.get(run_id, {})
            merged[run_id] = {
                event: sorted({*before.get(event, ()), *steps.get(event, ())})[: self._limit if event in RATIONED else 1]
                for event in sorted({*before, *steps})
            }
        return merged

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values: object) -> Iterator[Row]:
        came: dict[int, dict[str, dict[str, list[int]]]] = {}
        for row in rows:
            if row.event in OUTCOME_BY_EVENT:
                block = came.setdefault(row.run_id // RUNS_A_BLOCK, {})
                block.setdefault(str(row.run_id), {}).setdefault(row.event, []).append(row.step)
        numbers = self._numbers.get()
        stored = json.loads(numbers[0]) if numbers else []
        every = sorted({*stored, *came})
        if len(every) > len(stored):
            self._numbers.update((json.dumps(every),))
        status, attempts, end_run = "pending", 0, None
        for number in every:
            if end_run is not None and number not in came:
                continue  # nothing after the run that settles a candidate is judged
            known = json.loads(self._blocks.getValue((number,))[0]) if number in stored else {}
            runs = self._merge(known, came.get(number, {}))
            if runs != known:
                self._blocks.updateValue((number,), (json.dumps(runs),))
            for run_id in sorted(map(int, runs)) if end_run is None else ():
                outcome = outcome_of(runs[str(run_id)], self._limit)
                if outcome in FINAL_OUTCOMES:
                    status, end_run = STATUS_BY_OUTCOME.get(outcome, outcome), run_id
                elif outcome == "setup_failure":
                    attempts += 1
                    if attempts >= self._budget:
                        status, end_run = "inconclusive", run_id
                if end_run is not None:
                    break
        yield Row(candidate_id=key[0], status=status, attempts=attempts, end_run=end_run)

    def close(self) -> None:
        pass


def start_attempt_states(
    attempts: DataFrame, out: str, checkpoint: str, rewrites: int = REWRITE_BUDGET, budget: int = ATTEMPT_BUDGET, markers: Markers = Markers()
) -> StreamingQuery:
    """Keep each candidate's status, attempt count and ending run up to date; ``attempt_states`` reads them.

    Steps and runs may arrive in any order and be repeated. A proven candidate is ``proven``: which bug stands
    for it is decided elsewhere. A candidate's state holds, for each of its runs, a bounded number of steps.
    """
    events = triage(attempts, markers).select(
        F.col("candidate_id").cast("long").alias("candidate_id"), F.col("run_id").cast("int").alias("run_id"),
        F.col("step").cast("int").alias("step"), event_of(F.col("kind"), F.col("verdict")).alias("event"),
    )
    events = events.dropna(subset=["candidate_id", "run_id", "step"])
    reduced = events.mapInPandas(_first_steps(rewrites + 1), events.schema)
    states = reduced.groupBy("candidate_id").transformWithState(AttemptFold(rewrites, budget), STATE, "Update", "None")

    def store(batch: DataFrame, batch_id: int) -> None:
        # A batch that is repeated after a failure replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    writer = states.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def attempt_states(spark: SparkSession, out: str) -> DataFrame:
    """``candidate_id, status, attempts, end_run``: each candidate's latest state."""
    rows = spark.read.schema(f"{STATE}, batch long").parquet(out)
    return latest_per_key(rows, ["candidate_id"], ["batch"]).drop("batch")


def start_first_evidence(
    run_log: DataFrame, ledger_root: str, checkpoint: str, remember: str = "1 day", markers: Markers = Markers(), salts: int | None = None
) -> StreamingQuery:
    """Enter each piece of proven evidence in the ledger's confirmed table once, with state of bounded age.

    The state stops what arrived within ``remember``, which is nearly all; what is seen again later passes it
    and is stopped by the ledger's key table, of which nothing is moved. So state holds the keys of the last
    ``remember`` only, however many there ever were. A key that holds much of the stream is first reduced
    under ``salts`` salts (the session's shuffle partitions if not given).
    """
    ledger = Ledger(run_log.sparkSession, ledger_root)
    salts = salts or int(run_log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    proven = triage(run_log, markers).filter("verdict = 'true_positive'")
    proven = proven.select("evidence_key", "candidate_id", "run_id", "step", "probe_path", F.current_timestamp().alias("arrived"))
    proven = proven.withColumn("salt", F.pmod(F.xxhash64("candidate_id", "run_id", "step"), F.lit(salts)))
    lately = proven.withWatermark("arrived", remember).dropDuplicatesWithinWatermark(["evidence_key", "salt"])
    # Of the few rows that pass for a key the ledger takes the first.

    def store(batch: DataFrame, batch_id: int) -> None:
        tag = f"evidence-{batch_id}"
        if not ledger.has_tag(tag):
            came = materialize(batch, "evidence", ledger.spark)
            first = first_per_key(came, ["evidence_key"], ["run_id", "candidate_id", "step"])
            new = not_in(first, ledger.runs("evidence_keys"), ["evidence_key"], ledger.buckets)
            new = assign_ids(new, ["run_id", "candidate_id", "step"], start=ledger.next_id("confirmed"))
            ledger.commit(append={"confirmed": new}, tag=tag)

    writer = lately.writeStream.foreachBatch(store).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
