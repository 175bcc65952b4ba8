"""Run logs to evidence and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.functions import evidence as ev
from faultgrain.functions.paths import base_name
from faultgrain.functions.text import decode_utf8

REASONS = {
    "setup_failure": "the run never printed its setup marker; its dependencies may be broken",
    "unreachable": "the run never printed its reached marker; the input may miss the target",
    "true_positive": "the oracle fired in a clean run of its own",
    "false_positive": "the run ended clean",
}


def collect_evidence(run_log: DataFrame, markers: ev.Markers = ev.Markers()) -> DataFrame:
    """Add what one run shows: marker flags, hits, frames, oracle and evidence key.

    Narrow: one pass over the log, no shuffle. ``stdout`` and ``stderr`` may be bytes,
    text or NULL.
    """
    run_path, workdir = F.col("probe_path"), F.col("workdir")
    return (
        run_log.withColumns({"stdout": decode_utf8(F.col("stdout")), "stderr": decode_utf8(F.col("stderr"))})
        .withColumn("normalized_stderr", ev.replace_path(F.col("stderr"), run_path, "$PROBE"))
        .withColumn("output", ev.combined_output(F.col("stdout"), F.col("normalized_stderr")))
        .withColumns(
            {
                "sanitizer_hits": ev.sanitizer_hits(F.col("output")),
                "setup_ok": F.contains("output", F.lit(markers.setup)),
                "reached": F.contains("output", F.lit(markers.reached)),
                "top_frames": ev.top_frames(F.col("normalized_stderr"), workdir),
            }
        )
        .withColumns(
            {
                "oracle_fired": ev.oracle_fired(
                    F.col("exit_code"), F.col("timed_out"), F.col("sanitizer_hits")
                ),
                "evidence_key": ev.evidence_key(
                    F.col("top_frames"), F.col("normalized_stderr"), workdir, base_name(run_path)
                ),
            }
        )
        .drop("normalized_stderr", "output")
    )


def route_verdicts(evidence: DataFrame) -> DataFrame:
    """Add ``verdict`` and ``reason``. The markers are asked before the oracle."""
    verdict = (
        F.when(~F.col("setup_ok"), "setup_failure")
        .when(~F.col("reached"), "unreachable")
        .when(F.col("oracle_fired"), "true_positive")
        .otherwise("false_positive")
    )
    reasons = F.create_map(*(F.lit(item) for pair in REASONS.items() for item in pair))
    return evidence.withColumn("verdict", verdict).withColumn(
        "reason", F.element_at(reasons, F.col("verdict"))
    )


def triage(run_log: DataFrame, markers: ev.Markers = ev.Markers()) -> DataFrame:
    """``collect_evidence`` then ``route_verdicts``."""
    return route_verdicts(collect_evidence(run_log, markers))
