import json
import sys

import pytest
from pyspark import cloudpickle

from faultgrain.operators import report, tallies
from faultgrain.plans.explore import explore
from faultgrain.plans.verify import summarise, verify
from faultgrain.operators.complete import RuleClient
from faultgrain.schemas import CANDIDATES
from faultgrain.sources.ledger import Ledger, in_id_order
from faultgrain.streaming import attempts as stream
from faultgrain.streaming.attempts import finish_verification, start_verification
from faultgrain.streaming.intake import start_intake
from faultgrain.streaming.live_triage import first_evidence

# Workers cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILES = [
    ("calc.py", "def average(xs):\n    return sum(xs) / len(xs)\n"),
    ("text.py", "def shout(s):\n    return s.upper()\n"),
    ("sub/odd.py", "def odd(n):\n    return n % 2\n"),
    ("tests/test_calc.py", "def test(): pass\n"),
]
ISSUE = {"function": "average", "cwe_id": 369, "bug_category": "math", "description": "empty list", "trigger": "[]"}
REPORTS = json.dumps([ISSUE, ISSUE, {**ISSUE, "cwe_id": 20}])
ATTEMPT = (
    "candidate_id bigint, run_id int, step int, kind string, detail string, exit_code int, timed_out boolean, "
    "stdout string, stderr string, workdir string, probe_path string"
)
BOTH = "PROBE_SETUP_OK\nPROBE_REACHED\n"


def client():
    return RuleClient([("EXPLORE file calc.py", REPORTS), ("EXPLORE file sub/odd.py", "no idea")], default="[]")


def files(spark):
    return spark.createDataFrame(FILES, "path string, content string")


def counts(row):
    return row.files, row.files_skipped, row.candidates_new, row.candidates_dup, row.answer_failures


def run(candidate, run_id, step, out="", err="", code=0, kind="exec"):
    return (candidate, run_id, step, kind, "why", code, False, out, err, "/w", f"/w/probe_{candidate}")


def test_exploration_resumes_and_repeats_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert counts(explore(ledger, files(spark), client).first()) == (3, 0, 2, 1, 1)
    rows = in_id_order(ledger.candidates()).collect()
    assert [(r.id, r.file, r.cwe_id, r.status, r.verify_attempts) for r in rows] == [
        (1, "calc.py", 369, "pending", 0), (2, "calc.py", 20, "pending", 0),
    ]
    assert sorted(r.file for r in ledger.read("explored").collect()) == ["calc.py", "text.py"]
    # Only the failed file is asked about again.
    assert counts(explore(ledger, files(spark), client).first()) == (1, 2, 0, 0, 1)
    # With the explored set lost, findings already known stay single.
    ledger.commit(replace={"explored": ledger.read("explored").filter("false")})
    assert counts(explore(ledger, files(spark), client).first()) == (3, 0, 0, 3, 1)
    assert ledger.candidates().count() == 2


def test_scoped_runs_compose(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    quiet = lambda: RuleClient([], default="[]")
    assert counts(explore(ledger, files(spark), quiet, scope="sub").first())[:2] == (1, 0)
    assert counts(explore(ledger, files(spark), quiet).first())[:2] == (2, 1)


def test_a_broken_service_keeps_the_good_answers(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    mute = lambda: RuleClient([("calc", REPORTS)])
    with pytest.raises(RuntimeError):
        explore(ledger, files(spark), mute)
    assert ledger.candidates().count() == 2
    assert [r.file for r in ledger.read("explored").collect()] == ["calc.py"]
    assert counts(explore(ledger, files(spark), mute, fail_fast=False).first()) == (2, 1, 0, 0, 2)


def seeded(spark, root, count=6):
    ledger = Ledger(spark, str(root))
    rows = [(i, f"f{i}.c", "main", 369, "math", "d", "t", "pending", None, 0) for i in range(1, count + 1)]
    ledger.commit(append={"open": spark.createDataFrame(rows, CANDIDATES)})
    return ledger


def states(ledger):
    return {r.id: (r.status, r.verify_attempts) for r in ledger.candidates().collect()}


CRASH = 'File "/w/x.py", line 3'


def test_verification_changes_both_tables_at_once(spark, tmp_path):
    ledger = seeded(spark, tmp_path)
    log = [
        run(1, 1, 1, kind="audit_ok"), run(1, 1, 2, BOTH, CRASH, 1),
        run(2, 1, 1, BOTH, CRASH, 1),
        run(3, 1, 1, BOTH),
        run(4, 1, 1, "", "ImportError", 1),
        run(5, 1, 1, kind="refused"),
        run(6, 1, 1, kind="error"),
    ]
    final = verify(ledger, spark.createDataFrame(log, ATTEMPT), budget=2)
    tally = tallies.verify_tallies(final).first()
    assert (tally.probes, tally.confirmed_new, tally.duplicates, tally.rejected) == (3, 1, 1, 1)
    assert (tally.generator_refused, tally.setup_failures, tally.verify_failures) == (1, 1, 1)
    assert states(ledger) == {
        1: ("confirmed", 0), 2: ("duplicate", 0), 3: ("rejected", 0), 4: ("pending", 1), 5: ("rejected", 0), 6: ("pending", 0),
    }
    assert [(r.id, r.candidate_id) for r in ledger.read("confirmed").collect()] == [(1, 1)]
    later = [run(i, 2, 1, "", "", 1) for i in range(1, 5)]
    verify(ledger, spark.createDataFrame(later, ATTEMPT), budget=2)
    assert states(ledger)[4] == ("inconclusive", 2) and states(ledger)[1] == ("confirmed", 0)
    verify(ledger, spark.createDataFrame([run(4, 3, 1, BOTH, "y.c:3", 1)], ATTEMPT), budget=2)
    assert states(ledger)[4] == ("inconclusive", 2)
    bugs = report.confirmed_with_candidates(ledger.read("confirmed"), ledger.candidates())
    assert [(r.id, r.file) for r in bugs.collect()] == [(1, "f1.c")]
    summary = summarise(explore(ledger, files(spark), client, run_id=1), final).first()
    assert (summary.files, summary.probes, summary.run_id) == (3, 3, 1)


def test_a_run_may_be_cut_by_batches(spark, tmp_path):
    steps = [run(1, 1, n, kind="audit_invalid") for n in (1, 2, 3)] + [run(None, 1, 1), run(2, 1, 1, "", "", 1)]
    source = str(tmp_path / "attempts")
    ledger = seeded(spark, tmp_path / "ledger", 2)
    for batch in (steps[:2], steps[2:]):
        spark.createDataFrame(batch, ATTEMPT).coalesce(1).write.mode("append").parquet(source)
        attempts = spark.readStream.schema(ATTEMPT).parquet(source)
        start_verification(attempts, str(tmp_path / "ledger"), str(tmp_path / "ck")).awaitTermination()
        assert states(ledger)[1] == ("pending", 0)
    finish_verification(ledger)
    assert states(ledger) == {1: ("rejected", 0), 2: ("pending", 1)}


def test_streams(spark, tmp_path):
    """Attempts and answers arriving in batches leave the ledger one batch would."""
    log = [
        [run(1, 1, 1, "", "", 1), run(2, 1, 1, BOTH, CRASH, 1), run(3, 1, 1, BOTH, CRASH, 1)],
        [run(1, 2, 1, "", "", 1), run(2, 2, 1, BOTH, "new.c:1", 1)],
        [run(1, 3, 1, "", "", 1), run(4, 3, 1, BOTH)],
    ]
    source = str(tmp_path / "attempts")
    streamed, whole = seeded(spark, tmp_path / "streamed"), seeded(spark, tmp_path / "whole")
    for batch in log:
        spark.createDataFrame(batch, ATTEMPT).coalesce(1).write.mode("append").parquet(source)
        attempts = spark.readStream.schema(ATTEMPT).parquet(source)
        start_verification(attempts, str(tmp_path / "streamed"), str(tmp_path / "ck1")).awaitTermination()
    assert states(streamed)[1] == ("pending", 2)
    finish_verification(streamed)
    assert streamed.read("waiting").count() == 0
    verify(whole, spark.read.parquet(source))
    assert states(streamed) == states(whole) == {
        1: ("inconclusive", 3), 2: ("confirmed", 0), 3: ("duplicate", 0), 4: ("rejected", 0), 5: ("pending", 0), 6: ("pending", 0),
    }
    out = str(tmp_path / "evidence")
    found = first_evidence(spark.readStream.schema(ATTEMPT).parquet(source)).select("evidence_key")
    writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck2"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 2

    answers = str(tmp_path / "answers")
    for texts in ([("calc.py", REPORTS), ("bad.py", "?")], [("calc.py", REPORTS), ("text.py", "[]")]):
        spark.createDataFrame(texts, "file string, text string").coalesce(1).write.mode("append").parquet(answers)
        stream = spark.readStream.schema("file string, text string").parquet(answers)
        start_intake(stream, str(tmp_path / "intake"), str(tmp_path / "ck3")).awaitTermination()
    ledger = Ledger(spark, str(tmp_path / "intake"))
    assert [(r.id, r.cwe_id) for r in in_id_order(ledger.candidates()).collect()] == [(1, 369), (2, 20)]
    assert sorted(r.file for r in ledger.read("explored").collect()) == ["calc.py", "text.py"]


def test_steps_are_folded_as_they_lie(spark, tmp_path, monkeypatch):
    plans = []

    def watched(ledger, steps, *rest, **named):
        plans.append(steps._jdf.queryExecution().executedPlan().toString())
        return verify(ledger, steps, *rest, **named)

    monkeypatch.setattr(stream, "verify", watched)
    ledger, source = seeded(spark, tmp_path / "ledger", 2), str(tmp_path / "attempts")
    log = [run(1, 1, 1, BOTH), run(1, 2, 1), run(None, 1, 1), run(2, None, 1, BOTH), run(2, 4, 1, BOTH)]
    spark.createDataFrame(log, ATTEMPT).coalesce(1).write.parquet(source)
    start_verification(spark.readStream.schema(ATTEMPT).parquet(source), str(tmp_path / "ledger"), str(tmp_path / "ck")).awaitTermination()
    # The texts of a run's steps are read where they are: neither joined nor dealt before their triage.
    assert len(plans) == 1 and "Join" not in plans[0] and "Exchange" not in plans[0]
    assert states(ledger) == {1: ("rejected", 0), 2: ("pending", 0)}
    assert sorted((r.candidate_id, r.run_id) for r in ledger.read("waiting").collect()) == [(1, 2), (2, 4)]
