"""Probe generation and audit: candidates to probes that may run, and the steps that led there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultgrain.functions.text import tail
from faultgrain.operators import contracts, prompts
from faultgrain.operators.complete import ClientFactory, complete
from faultgrain.operators.first_wins import latest_per_key
from faultgrain.operators.lifecycle import REWRITE_BUDGET, event_of, run_outcomes
from faultgrain.session import materialize

_PROBE = "interpreter array<string>, script string, reason string"
_AUDIT = "verdict string, feedback string"


def _steps(rows: DataFrame, run_id: int, step: int, kind: Column | str, detail: str) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select(
        F.col("id").alias("candidate_id"),
        F.lit(run_id).alias("run_id"),
        F.lit(step).alias("step"),
        kind.alias("kind"),
        F.col(detail).alias("detail"),
    )


def _generated(asked: DataFrame, factory: ClientFactory, overview: Column, retries: int) -> DataFrame:
    """``asked`` (candidates with feedback) and what the service wrote: ``kind``, script, note."""
    text = prompts.probe_prompt(overview, F.col("feedback")).alias("prompt")
    answers = complete(asked.select(F.col("id").alias("key"), text), factory, contracts.judge_probes, contracts.PROBE_SHAPE, retries)
    fields = answers.withColumn("_f", F.from_json("payload", _PROBE)).select(
        F.col("key").alias("id"), "ok", "_f.interpreter", "_f.script", F.coalesce("_f.reason", "failure", "error").alias("note")
    )
    kind = F.when(~F.col("ok"), "generate_failed").when(F.col("script").isNull(), "refused").otherwise("probe")
    written = materialize(fields.withColumn("kind", kind).drop("ok"), "probes")
    return asked.join(written, "id")


def _audited(written: DataFrame, files: DataFrame, factory: ClientFactory, overview: Column, retries: int) -> DataFrame:
    """Probes with the audit's ``kind`` and its note; without the target's source there is no audit."""
    shown = materialize(
        prompts.with_source(written, files).select("id", prompts.audit_prompt(overview).alias("prompt")), "audit-prompts"
    )
    asked = shown.filter("prompt IS NOT NULL").select(F.col("id").alias("key"), "prompt")
    answers = complete(asked, factory, contracts.judge_audits, contracts.AUDIT_SHAPE, retries)
    verdict = answers.withColumn("_f", F.from_json("payload", _AUDIT)).select(
        F.col("key").alias("id"),
        F.concat(F.lit("audit_"), F.col("_f.verdict")).alias("kind"),
        F.coalesce("_f.feedback", "failure", "error").alias("note"),
    )
    found = written.drop("kind", "note").join(verdict, "id", "left")
    return materialize(found.withColumn("kind", F.coalesce("kind", F.lit("audit_unavailable"))), "audits")


def make_probes(
    candidates: DataFrame,
    files: DataFrame,
    factory: ClientFactory,
    overview: str = "",
    run_id: int = 1,
    audit: bool = True,
    rewrites: int = REWRITE_BUDGET,
    retries: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """One run over ``candidates``: probes to be executed, and the attempt rows of all steps.

    Returns probes (candidate_id, step, interpreter, script), which ``latest_probes`` and the probe sink
    take, and steps (candidate_id, run_id, step, kind, detail), which go before the executed step
    of the run. A probe that the audit turns down is written anew with the audit's feedback, at most
    ``rewrites`` times. With ``audit`` off every valid probe is to be executed.
    """
    told = F.lit(overview)
    asked = candidates.withColumn("feedback", F.lit(""))
    probes, steps = [], []
    for attempt in range(rewrites + 1):
        step = 2 * attempt + 1
        written = materialize(_generated(asked, factory, told, retries), "written")
        steps.append(_steps(written.filter("kind != 'probe'"), run_id, step, F.col("kind"), "note"))
        valid = written.filter("kind = 'probe'").drop("feedback")
        if audit:
            judged = _audited(valid, files, factory, told, retries)
            steps.append(_steps(judged, run_id, step + 1, F.col("kind"), "note"))
            valid = judged.filter("kind = 'audit_ok'")
        chosen = valid.select(F.col("id").alias("candidate_id"), F.lit(step).alias("step"), "interpreter", "script")
        probes.append(chosen)
        if not audit:
            break
        turned_down = judged.filter("kind = 'audit_invalid'")
        if attempt == rewrites or turned_down.isEmpty():
            break
        asked = turned_down.withColumn("feedback", F.col("note")).select(*candidates.columns, "feedback")
    return prompts.latest_probes(reduce(DataFrame.unionByName, probes)), reduce(DataFrame.unionByName, steps)


# Fixed value: so much of an output is shown.
TAIL_CHARS = 4_000
MISSED = "The last probe set up but never reached the target. Its output ended with:\n"


def rewrite_unreachable(
    candidates: DataFrame,
    attempts: DataFrame,
    factory: ClientFactory,
    overview: str = "",
    rewrites: int = REWRITE_BUDGET,
    retries: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """New probes for the runs whose last executed probe missed the target, while their budget lasts.

    ``attempts`` are triaged steps (candidate_id, run_id, step, kind, detail, verdict and the run log). A run takes
    part if nothing has ended it and its last step is an unreachable one, so it has had at most ``rewrites`` of them.
    Returns probes (candidate_id, run_id, step, interpreter, script) that go to execution at the next step, without
    another audit, and the steps (candidate_id, run_id, step, kind, detail) of the rewrites that gave none.
    """
    open_runs = run_outcomes(attempts, rewrites).filter("end_step IS NULL").select("candidate_id", "run_id")
    last = latest_per_key(attempts, ["candidate_id", "run_id"], ["step"])
    missed = last.filter(event_of(F.col("kind"), F.col("verdict")) == "unreachable")
    output = tail(F.concat_ws("\n", "stdout", "stderr"), TAIL_CHARS)
    missed = missed.select("candidate_id", "run_id", (F.col("step") + 1).alias("step"), F.concat(F.lit(MISSED), output).alias("feedback"))
    missed = missed.join(open_runs, ["candidate_id", "run_id"], "left_semi")
    told = missed.join(candidates.withColumnRenamed("id", "candidate_id"), "candidate_id")
    asked = told.withColumn("id", F.concat_ws(":", "candidate_id", "run_id"))  # a candidate may have several runs
    written = materialize(_generated(materialize(asked, "missed"), factory, F.lit(overview), retries), "rewritten")
    probes = written.filter("kind = 'probe'").select("candidate_id", "run_id", "step", "interpreter", "script")
    none = written.filter("kind != 'probe'").select("candidate_id", "run_id", "step", "kind", F.col("note").alias("detail"))
    return probes, none
