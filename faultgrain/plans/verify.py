"""One verification job: attempt logs to candidate states and confirmed bugs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.functions.evidence import Markers
from faultgrain.operators import lifecycle, tallies
from faultgrain.operators.report import check_references
from faultgrain.operators.triage import triage
from faultgrain.plans.skew import lookup
from faultgrain.session import materialize
from faultgrain.sources.ledger import Ledger, split_by_status

CARRIED = ("evidence_key", "probe_path")


def verify(
    ledger: Ledger,
    attempts: DataFrame,
    rewrites: int = lifecycle.REWRITE_BUDGET,
    budget: int = lifecycle.ATTEMPT_BUDGET,
    markers: Markers = Markers(),
    tag: str = "",
    also: Mapping[str, DataFrame] | None = None,
    last: DataFrame | None = None,
) -> DataFrame:
    """Fold the attempts of pending candidates into the ledger.

    Returns one row per (candidate, run) that took part: outcome, reason and bug. The
    candidates and the confirmed bugs change in one commit, which rewrites only what was
    pending, and gives the tables of ``also`` a new content. Of ``last`` (candidate_id, last_run), if given,
    a candidate's runs before its last one take part only.
    """
    candidates = ledger.read("open")
    open_candidates = candidates.select(F.col("id").alias("candidate_id"), "verify_attempts")
    # The log is read once; a batch of a stream goes on in the ledger's own session, where
    # adaptive execution is not switched off.
    outcomes = lifecycle.run_outcomes(triage(attempts, markers), rewrites, CARRIED)
    outcomes = materialize(outcomes, "all-outcomes", ledger.spark)
    asked = open_candidates.select("candidate_id")
    if last is None:
        taking_part = lookup(outcomes, asked, ["candidate_id"], ["run_id"], "left_semi")
    else:
        taking_part = lookup(outcomes, asked.join(last, "candidate_id"), ["candidate_id"], ["run_id"], "inner")
        taking_part = taking_part.filter("run_id < last_run").drop("last_run")
    taking_part = materialize(taking_part, "outcomes")
    ends = materialize(lifecycle.candidate_ends(taking_part, budget, open_candidates), "ends")
    settled = materialize(lifecycle.settle(taking_part, ends), "settled")
    proven = settled.filter("outcome = 'proven'")
    keys = ledger.runs("evidence_keys")
    bugs, resolved = lifecycle.confirm(proven, keys, ledger.next_id("confirmed"), ledger.buckets)
    final = materialize(lifecycle.name_proven(settled, resolved), "final")
    updated = lifecycle.apply_updates(candidates, lifecycle.status_updates(final), ends)
    check_references(bugs, candidates)
    still_open, closed = split_by_status(materialize(updated, "candidates"))
    ledger.commit(append={"confirmed": bugs, "closed": closed}, replace={"open": still_open, **(also or {})}, tag=tag)
    return final


def summarise(explored: DataFrame, final: DataFrame) -> DataFrame:
    """The run summary of exploration tallies and verification outcomes."""
    return tallies.run_summary(explored, tallies.verify_tallies(final))
