import hashlib

import pytest

from faultgrain.functions.evidence import Markers
from faultgrain.operators.triage import collect_evidence, triage
from faultgrain.schemas import RUN_LOG

BOTH = "PROBE_SETUP_OK\nPROBE_REACHED\n"
TRACE = 'Traceback (most recent call last):\n  File "{p}", line 3, in <module>\n  File "{w}/target/mod.py", line 9, in f\nZeroDivisionError\n'


def log(spark, *runs):
    rows = []
    for i, run in enumerate(runs, 1):
        base = dict(code=0, timed_out=False, out="", err="", workdir="/tmp/w", probe=f"/tmp/w/probe_{i}") | run
        rows.append((i, 1, i, base["code"], base["timed_out"], base["out"], base["err"], base["workdir"], base["probe"]))
    return spark.createDataFrame(rows, RUN_LOG)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_verdicts(spark):
    runs = log(
        spark,
        dict(code=1, out=BOTH, err=TRACE.format(p="/tmp/w/probe_1", w="/tmp/w")),
        dict(out=BOTH),
        dict(code=1, err="ImportError"),
        dict(code=1, out="PROBE_SETUP_OK"),
        dict(code=-1, timed_out=True, out=BOTH),
        dict(code=-1, timed_out=True),
        dict(out=BOTH, err="x.c:3: runtime error: overflow"),
        dict(out="", err=BOTH),
    )
    got = [r.verdict for r in triage(runs).orderBy("candidate_id").collect()]
    assert got == [
        "true_positive", "false_positive", "setup_failure", "unreachable", "true_positive", "setup_failure",
        "true_positive", "false_positive",
    ]


def test_frames_are_stable_across_work_folders(spark):
    runs = log(
        spark,
        dict(err=TRACE.format(p="/tmp/xyz/probe_1", w="/tmp/xyz"), workdir="/tmp/xyz", probe="/tmp/xyz/probe_1"),
        dict(err=TRACE.format(p="/tmp/other/probe_2", w="/tmp/other"), workdir="/tmp/other", probe="/tmp/other/probe_2"),
    )
    first, second = collect_evidence(runs).orderBy("candidate_id").collect()
    assert first.top_frames == second.top_frames == ["$PROBE", "$WORK/target/mod.py"]
    assert first.evidence_key == second.evidence_key == sha("$PROBE|$WORK/target/mod.py")


def test_frame_patterns(spark):
    err = "\n".join(
        ["no place", "src/a.c:12:3: error x.c:9", 'at b.c:4 File "c.py", line 5', "é_ü/d.rs:٣", "late.c:1"]
    )
    (row,) = collect_evidence(log(spark, dict(err=err, workdir=""))).collect()
    assert row.top_frames == ["src/a.c:12", "c.py", "é_ü/d.rs:٣"]


@pytest.mark.parametrize("err", ["", " \n\t "])
def test_silent_crashes_keep_their_own_key(spark, err):
    rows = collect_evidence(log(spark, dict(code=1, err=err), dict(code=1, err=err))).orderBy("candidate_id").collect()
    assert [r.evidence_key for r in rows] == [sha("silent:probe_1"), sha("silent:probe_2")]


def test_error_text_key(spark):
    err = "  lost /tmp/w now " + "x" * 900 + "\n"
    (row,) = collect_evidence(log(spark, dict(err=err))).collect()
    assert row.evidence_key == sha(err.replace("/tmp/w", "$WORK").strip()[:500])


def test_hits_are_in_table_order_and_markers_are_parameters(spark):
    runs = log(spark, dict(out="LeakSanitizer AddressSanitizer", err="ready entered"))
    (row,) = triage(runs, Markers("ready", "entered")).collect()
    assert row.sanitizer_hits == ["AddressSanitizer", "LeakSanitizer"]
    assert (row.verdict, row.oracle_fired) == ("true_positive", True)


def test_triage_needs_no_shuffle_and_no_python(spark):
    plan = triage(log(spark, dict()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
