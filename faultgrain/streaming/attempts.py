"""Attempts as a stream, counted against each candidate's budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultgrain.operators.lifecycle import ATTEMPT_BUDGET, REWRITE_BUDGET
from faultgrain.plans.prefilter import wanted_only
from faultgrain.plans.skew import lookup
from faultgrain.plans.verify import verify
from faultgrain.session import materialize
from faultgrain.sources.ledger import Ledger


def last_runs(steps: DataFrame) -> DataFrame:
    """``candidate_id, last_run``: the run of each candidate that no later one follows yet."""
    return steps.groupBy("candidate_id").agg(F.max("run_id").alias("last_run"))


def steps_of(steps: DataFrame, last: DataFrame) -> DataFrame:
    """The steps of the last runs. A filter drops most others in the scan, before their texts are moved."""
    run = steps.withColumn("_run", F.xxhash64("candidate_id", "run_id"))
    some = wanted_only(run, "_run", last.select(F.xxhash64("candidate_id", "last_run").alias("_run")), "_run").drop("_run")
    return lookup(some, last, ["candidate_id"], ["run_id", "step"], "inner").filter("run_id = last_run").drop("last_run")


def start_verification(
    attempts: DataFrame,
    ledger_root: str,
    checkpoint: str,
    rewrites: int = REWRITE_BUDGET,
    budget: int = ATTEMPT_BUDGET,
) -> StreamingQuery:
    """Fold the runs into the ledger as they end; ``finish_verification`` folds the last ones.

    The ledger is the state: it holds every candidate's status and attempt count, and the steps
    of each candidate's last run, which the next batch may go on with. It survives any executor, and
    the fold keeps a busy candidate's rows spread over tasks, which a keyed state operator would
    not. A candidate's runs have to arrive in run order; batches may cut them anywhere.
    """

    ledger = Ledger(attempts.sparkSession, ledger_root)

    def fold(batch: DataFrame, batch_id: int) -> None:
        tag = f"attempts-{batch_id}"
        if not ledger.has_tag(tag):
            waiting = ledger.read("waiting")
            new = materialize(batch.select(*waiting.columns), "attempts", ledger.spark)
            steps = waiting.unionByName(new)
            last = materialize(last_runs(steps), "last-runs")
            # All steps are folded as they lie; what became of a run that may go on is dropped, a row a run.
            verify(ledger, steps, rewrites, budget, tag=tag, also={"waiting": steps_of(steps, last)}, last=last)

    return (
        attempts.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def finish_verification(ledger: Ledger, rewrites: int = REWRITE_BUDGET, budget: int = ATTEMPT_BUDGET) -> DataFrame:
    """Fold the runs still waiting for more steps: no more will come."""
    waiting = ledger.read("waiting")
    return verify(ledger, waiting, rewrites, budget, also={"waiting": waiting.limit(0)})
