"""Answers as a stream, stored as candidates batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from faultgrain.operators.contracts import judge_issues
from faultgrain.plans.explore import store_findings
from faultgrain.session import materialize
from faultgrain.sources.ledger import Ledger


def start_intake(answers: DataFrame, ledger_root: str, checkpoint: str) -> StreamingQuery:
    """Judge the answers (file, text) of each batch and store the new findings.

    A batch repeated after a failure finds its tag in the ledger and is skipped.
    """

    ledger = Ledger(answers.sparkSession, ledger_root)

    def store(batch: DataFrame, batch_id: int) -> None:
        tag = f"intake-{batch_id}"
        if not ledger.has_tag(tag):
            # Read back in the ledger's session: a stream's own has no adaptive execution.
            judged = materialize(judge_issues(batch), "judged", ledger.spark)
            store_findings(ledger, judged, tag)

    return (
        answers.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
