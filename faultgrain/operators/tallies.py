"""Counts over one or many runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _counted(rows: DataFrame, metric: str) -> DataFrame:
    return rows.select("run_id", F.lit(metric).alias("metric"))


def exploration_tallies(
    tasks: DataFrame, skipped: DataFrame, failed: DataFrame, offered: DataFrame, new: DataFrame
) -> DataFrame:
    """Per run: files explored (failed ones too), files skipped, candidates new and known.

    Every input has run_id; ``offered`` are all candidate rows of valid answers and ``new``
    the ones the ledger took. One aggregation over the labelled union of the inputs.
    """
    metrics = {"files": tasks, "files_skipped": skipped, "failures": failed, "offered": offered, "new": new}
    labelled = None
    for metric, rows in metrics.items():
        part = _counted(rows, metric)
        labelled = part if labelled is None else labelled.unionByName(part)
    count = lambda metric: F.count_if(F.col("metric") == metric)
    return labelled.groupBy("run_id").agg(
        count("files").alias("files"),
        count("files_skipped").alias("files_skipped"),
        count("new").alias("candidates_new"),
        (count("offered") - count("new")).alias("candidates_dup"),
        count("failures").alias("answer_failures"),
    )


def outcome_count(*outcomes: str) -> Column:
    return F.count_if(F.col("outcome").isin(*outcomes))


def verify_tallies(outcomes: DataFrame) -> DataFrame:
    """Per run: how many candidates ended in each class. ``probes`` counts executed verdicts."""
    return outcomes.groupBy("run_id").agg(
        outcome_count("confirmed", "rejected", "duplicate").alias("probes"),
        outcome_count("audit_rejected").alias("audit_rejected"),
        outcome_count("generator_refused").alias("generator_refused"),
        outcome_count("confirmed").alias("confirmed_new"),
        outcome_count("rejected").alias("rejected"),
        outcome_count("duplicate").alias("duplicates"),
        outcome_count("pending").alias("pending"),
        outcome_count("setup_failure").alias("setup_failures"),
        outcome_count("inconclusive").alias("inconclusive"),
        outcome_count("failure").alias("verify_failures"),
    )


def run_summary(explored: DataFrame, verified: DataFrame) -> DataFrame:
    """One row per run from both stages; a stage that did not run counts zero."""
    return explored.join(verified, "run_id", "full_outer").na.fill(0)


def duplicate_density(resolved: DataFrame) -> DataFrame:
    """Proven candidates per bug that represents them."""
    return resolved.groupBy("bug_id").agg(F.count(F.lit(1)).alias("candidates"))


def status_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
