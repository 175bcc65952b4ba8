"""Attempt histories to candidate outcomes under bounded budgets.

Every rule of the history is "the first event of this kind" or "the n-th event of this
kind" with n fixed by a budget. So each fold keeps the first n rows per group and kind
with a ranked filter, which Spark applies before the shuffle as well, and only then
aggregates. A candidate with a billion attempts costs each task n rows per kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultgrain.operators.first_wins import first_per_key, not_in
from faultgrain.operators.ids import assign_ids, next_id
from faultgrain.plans.skew import lookup
from faultgrain.sources.buckets import dealt

# Default budgets.
REWRITE_BUDGET = 2
ATTEMPT_BUDGET = 3

# What ends a run of a candidate, and the outcome it ends with. ``audit_invalid`` and
# ``unreachable`` only end it once the rewrite budget is spent.
OUTCOME_BY_EVENT = {
    "generate_failed": "pending",
    "audit_unavailable": "pending",
    "refused": "generator_refused",
    "audit_invalid": "audit_rejected",
    "unreachable": "rejected",
    "setup_failure": "setup_failure",
    "true_positive": "proven",
    "false_positive": "rejected",
    "error": "failure",
}
FINAL_OUTCOMES = ("generator_refused", "audit_rejected", "rejected", "proven")
CLEAN_RUN = "the run ended clean"


def _map(values: dict[str, str], key: Column) -> Column:
    table = F.create_map(*(F.lit(item) for pair in values.items() for item in pair))
    return F.element_at(table, key)


def event_of(kind: Column, verdict: Column) -> Column:
    """An executed step is named by its verdict, any other step by its kind."""
    return F.when(kind == "exec", verdict).otherwise(kind)


def run_outcomes(
    attempts: DataFrame, rewrites: int = REWRITE_BUDGET, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per (candidate, run): the first event that ends the run.

    ``attempts`` has candidate_id, run_id, step, kind, verdict (of executed steps) and
    detail; the columns ``keep`` of the ending step are carried along. A run nothing
    ended is ``pending``.
    """
    event = event_of(F.col("kind"), F.col("verdict"))
    rationed = F.col("event").isin("audit_invalid", "unreachable")
    kind = (
        F.when(rationed, F.col("event"))
        .when(F.col("event").isin(*OUTCOME_BY_EVENT), "ends")
        .otherwise("passes")
    )
    limit = rewrites + 1
    ranked = (
        attempts.withColumn("event", event)
        .withColumn("_kind", kind)
        .withColumn(
            "_rank",
            F.row_number().over(
                Window.partitionBy("candidate_id", "run_id", "_kind").orderBy("step")
            ),
        )
        .filter(F.col("_rank") <= limit)
    )
    ends = F.when(rationed, F.col("_rank") == limit).otherwise(
        (F.col("_kind") == "ends") & (F.col("_rank") == 1)
    )
    ending = F.when(ends, F.struct("event", "detail", *keep))
    order = F.when(ends, F.col("step"))
    fixed = {
        "unreachable": f"no run reached the target path after {rewrites} rewrites",
        "false_positive": CLEAN_RUN,
    }
    reason = F.coalesce(
        _map(fixed, F.col("_end.event")),
        F.when(F.col("_end.event").isin("refused", "audit_invalid"), F.col("_end.detail")),
    )
    return (
        ranked.groupBy("candidate_id", "run_id")
        .agg(F.min_by(ending, order).alias("_end"), F.min(order).alias("end_step"))
        .select(
            "candidate_id",
            "run_id",
            F.coalesce(_map(OUTCOME_BY_EVENT, F.col("_end.event")), F.lit("pending")).alias("outcome"),
            reason.alias("reason"),
            "end_step",
            *(F.col(f"_end.{c}").alias(c) for c in keep),
        )
    )


def _with_prior(ranked: DataFrame, prior: DataFrame | None) -> DataFrame:
    """Add ``_prior``: setup failures already counted for the candidate."""
    if prior is None:
        return ranked.withColumn("_prior", F.lit(0))
    known = prior.select("candidate_id", F.col("verify_attempts").alias("_prior"))
    return ranked.join(known, "candidate_id", "left").withColumn(
        "_prior", F.coalesce("_prior", F.lit(0))
    )


def candidate_ends(
    outcomes: DataFrame, budget: int = ATTEMPT_BUDGET, prior: DataFrame | None = None
) -> DataFrame:
    """One row per candidate: the run that settled it, if any, and its attempt count.

    A candidate is settled by its first final outcome or by the setup failure that uses
    up ``budget``, whichever run comes first. ``prior`` (candidate_id, verify_attempts)
    holds the failures counted in earlier jobs.
    """
    kind = (
        F.when(F.col("outcome").isin(*FINAL_OUTCOMES), "final")
        .when(F.col("outcome") == "setup_failure", "setup")
        .otherwise("open")
    )
    ranked = (
        outcomes.select("candidate_id", "run_id", kind.alias("_kind"))
        .withColumn(
            "_rank",
            F.row_number().over(Window.partitionBy("candidate_id", "_kind").orderBy("run_id")),
        )
        .filter(F.col("_rank") <= budget)
    )
    ranked = _with_prior(ranked, prior)
    final_run = F.min(F.when(F.col("_kind") == "final", F.col("run_id")))
    spent_run = F.min(
        F.when(
            (F.col("_kind") == "setup") & (F.col("_rank") + F.col("_prior") >= budget),
            F.col("run_id"),
        )
    )
    setup_runs = F.collect_list(F.when(F.col("_kind") == "setup", F.col("run_id")))
    counted = F.size(
        F.filter("_setup", lambda run: F.col("end_run").isNull() | (run <= F.col("end_run")))
    )
    return (
        # At most ``budget`` runs per kind are left in a group here.
        ranked.groupBy("candidate_id")
        .agg(
            F.first("_prior").alias("_prior"),
            final_run.alias("_final"),
            spent_run.alias("_spent"),
            setup_runs.alias("_setup"),
        )
        .withColumn("end_run", F.least("_final", "_spent"))
        .select(
            "candidate_id",
            "end_run",
            (F.col("_spent") == F.col("end_run")).alias("exhausted"),
            (F.col("_prior") + counted).cast("int").alias("attempts"),
        )
    )


def settle(outcomes: DataFrame, ends: DataFrame) -> DataFrame:
    """Drop runs after a candidate was settled; a spent budget reads ``inconclusive``.

    ``ends`` comes from ``candidate_ends``.
    """
    kept = lookup(outcomes, ends, ["candidate_id"], ["run_id"]).filter(
        F.col("end_run").isNull() | (F.col("run_id") <= F.col("end_run"))
    )
    spent = F.coalesce(F.col("exhausted") & (F.col("run_id") == F.col("end_run")), F.lit(False))
    spent_reason = F.concat(
        F.lit("no evidence after "), F.col("attempts"), F.lit(" verification attempt(s)")
    )
    return kept.withColumns(
        {
            "outcome": F.when(spent, "inconclusive").otherwise(F.col("outcome")),
            "reason": F.when(spent, spent_reason).otherwise(F.col("reason")),
        }
    ).drop("exhausted", "attempts", "end_run")


def confirm(
    proven: DataFrame, confirmed: DataFrame | Sequence[DataFrame], start: int | None = None, buckets: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Insert proven bugs or ignore them when their evidence is known.

    ``proven`` has candidate_id, run_id, probe_path and evidence_key; ``confirmed`` holds the stored
    evidence_key and id, as one table or in runs that may be bucketed by key. Returns the new rows of the
    confirmed table and, for every proven row, its status (confirmed or duplicate) and the bug representing it.
    The lowest (run_id, candidate_id) wins a key. New ids begin at ``start``, by default after the stored ones.
    """
    order = ["run_id", "candidate_id"]
    runs = [confirmed] if isinstance(confirmed, DataFrame) else list(confirmed)
    if start is None:
        start = max((next_id(run) for run in runs), default=1)
    first = first_per_key(proven, ["evidence_key"], order)
    new = assign_ids(not_in(first, runs, ["evidence_key"], buckets), order, start=start)
    # Of the stored bugs only those met again are needed: at most one row a key of the batch.
    met = first.select("evidence_key")
    met = dealt(met, ["evidence_key"], buckets) if buckets else met
    nobody = (F.lit(None).cast("bigint").alias("_candidate"), F.lit(None).cast("int").alias("_run"))
    known = new.select(
        "evidence_key", F.col("id").alias("bug_id"), F.col("candidate_id").alias("_candidate"), F.col("run_id").cast("int").alias("_run")
    )
    for run in runs:
        stored = met.join(run.select("evidence_key", "id"), "evidence_key")
        known = known.unionByName(stored.select("evidence_key", F.col("id").alias("bug_id"), *nobody))
    resolved = lookup(proven, known, ["evidence_key"], order, how="inner")
    won = F.col("candidate_id").eqNullSafe(F.col("_candidate")) & F.col("run_id").eqNullSafe(F.col("_run"))
    resolved = resolved.withColumn("status", F.when(won, "confirmed").otherwise("duplicate"))
    bugs = new.select("id", "candidate_id", "probe_path", "evidence_key")
    return bugs, resolved.drop("_candidate", "_run")


# The candidate status an outcome leaves behind; other outcomes leave it pending.
STATUS_BY_OUTCOME = {
    "generator_refused": "rejected",
    "audit_rejected": "rejected",
    "rejected": "rejected",
    "inconclusive": "inconclusive",
    "confirmed": "confirmed",
    "duplicate": "duplicate",
}


def name_proven(settled: DataFrame, resolved: DataFrame) -> DataFrame:
    """Replace the outcome ``proven`` by confirmed or duplicate and add ``bug_id``."""
    found = resolved.select("candidate_id", "run_id", F.col("status").alias("_status"), "bug_id")
    joined = settled.join(found, ["candidate_id", "run_id"], "left")
    return joined.withColumn("outcome", F.coalesce("_status", "outcome")).drop("_status")


def status_updates(outcomes: DataFrame) -> DataFrame:
    """The candidate status set by each settled outcome (one row per candidate)."""
    return (
        outcomes.withColumn("status", _map(STATUS_BY_OUTCOME, F.col("outcome")))
        .filter(F.col("status").isNotNull())
        .select("candidate_id", "status", "reason")
    )


def apply_updates(candidates: DataFrame, updates: DataFrame, ends: DataFrame) -> DataFrame:
    """The next version of ``candidates``.

    ``updates`` sets status and, where it gives one, the reason; ``ends`` sets the attempt
    count. Both are unique per candidate.
    """
    change = updates.select(
        F.col("candidate_id").alias("id"),
        F.col("status").alias("_status"),
        F.col("reason").alias("_reason"),
    )
    count = ends.select(F.col("candidate_id").alias("id"), F.col("attempts").alias("_attempts"))
    return (
        candidates.join(change, "id", "left")
        .join(count, "id", "left")
        .withColumns(
            {
                "status": F.coalesce("_status", "status"),
                "reject_reason": F.coalesce("_reason", "reject_reason"),
                "verify_attempts": F.coalesce("_attempts", "verify_attempts"),
            }
        )
        .select(*candidates.columns)
    )
