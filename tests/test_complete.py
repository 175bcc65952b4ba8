import json
import os
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from faultgrain.operators import complete as complete_module
from faultgrain.operators import contracts
from faultgrain.operators.complete import RuleClient, ask, complete
from faultgrain.operators.journal import Journal
from faultgrain.operators.rules import first_rule, match_or_fail

# Workers cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OK = '{"verdict":"ok","feedback":""}'


def prompts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "key int, prompt string")


class Scripted:
    """Good after ``needed`` corrections; counts how often a correction was added."""

    def complete(self, prompt):
        corrections = prompt.count("could not be used")
        if prompt.startswith("break"):
            raise ConnectionError("down")
        if prompt.startswith("never"):
            return f"attempt with {corrections} correction(s)"
        needs = int(prompt.split()[0])
        return OK if corrections >= needs else json.dumps({"seen": corrections})


def test_retries_feed_the_last_error_back(spark):
    answers = complete(
        prompts(spark, "0 x", "1 x", "2 x", "never", "break"), Scripted, contracts.judge_audits, contracts.AUDIT_SHAPE, retries=2
    )
    rows = {r.key: r for r in answers.collect()}
    assert (rows[0].attempts, rows[0].ok, rows[0].payload) == (1, True, OK)
    assert (rows[1].attempts, rows[1].ok) == (2, True)
    # A correction replaces the one before, so a prompt never holds two.
    assert (rows[2].attempts, rows[2].ok, rows[2].payload) == (3, False, None)
    assert (rows[3].attempts, rows[3].ok) == (3, False) and "not valid JSON" in rows[3].error
    assert (rows[4].attempts, rows[4].ok, rows[4].failure) == (1, False, "ConnectionError: down")


def test_fail_fast(spark):
    with pytest.raises(RuntimeError, match="down"):
        complete(prompts(spark, "0 x", "break"), Scripted, contracts.judge_audits, fail_fast=True)


def test_failures_can_be_retried_and_calls_limited(spark):
    answers = complete(
        prompts(spark, "break"), Scripted, contracts.judge_text, retries=1, retry_failures=True, parallel_calls=2
    )
    assert [(r.attempts, r.ok) for r in answers.collect()] == [(2, False)]


def test_rule_client_and_rule_expression_agree(spark):
    rules = [("ab", "one"), ("b", "two"), ("", "all")]
    texts = ["xaby", "b", "z", ""]
    rows = prompts(spark, *texts)
    said = [r.text for r in ask(rows, lambda: RuleClient(rules)).orderBy("key").collect()]
    tagged = [r.t for r in rows.orderBy("key").select(first_rule(F.col("prompt"), rules).alias("t")).collect()]
    assert said == tagged == ["one", "two", "all", "all"]


def test_no_matching_rule(spark):
    rows = prompts(spark, "z")
    assert [r.t for r in rows.select(first_rule(F.col("prompt"), [("a", "b")], "d").alias("t")).collect()] == ["d"]
    assert "LookupError" in ask(rows, lambda: RuleClient([])).first().failure
    with pytest.raises(Exception, match="no rule matches"):
        rows.select(match_or_fail(F.col("prompt"), [("a", "b")])).collect()


class Dying(Scripted):
    """Breaks on what a file says; notes every prompt it was asked."""

    def __init__(self, folder):
        self._folder = folder

    def complete(self, prompt):
        with open(f"{self._folder}/asked", "a") as notes:
            notes.write(prompt.replace("\n", " ") + "\n")
        if os.path.exists(f"{self._folder}/down") and prompt.startswith("0 late"):
            raise ConnectionError("down")
        return super().complete(prompt)


def test_a_journal_outlives_an_aborted_job(spark, tmp_path):
    folder = str(tmp_path)
    journal = Journal(spark, f"{folder}/journal", batch_bytes=40)
    rows = prompts(spark, *(f"0 {word}{n}" for n in range(12) for word in ("x", "late")), "0 x1", "1 corrected", None)

    def run():
        return complete(rows.filter("prompt IS NOT NULL"), lambda: Dying(folder), contracts.judge_audits, contracts.AUDIT_SHAPE, fail_fast=True, journal=journal, stage="audit")

    open(f"{folder}/down", "w").close()
    with pytest.raises(RuntimeError, match="down"):
        run()
    before = [line for line in open(f"{folder}/asked").read().splitlines() if not line.startswith("0 late")]
    os.remove(f"{folder}/down")
    answers = {r.key: r for r in run().collect()}
    assert len(answers) == 26 and all(r.ok for r in answers.values())
    assert answers[25].attempts == 2 and answers[24].payload == answers[2].payload
    lines = open(f"{folder}/asked").read().splitlines()
    good = [line for line in lines if not line.startswith("0 late")]
    assert len(good) == len(set(good)) and set(before) <= set(good)  # a prompt with an answer is not asked again
    count = len(lines)
    assert {r.key for r in run().collect()} == set(answers) and len(open(f"{folder}/asked").read().splitlines()) == count
    assert journal.ask(rows.limit(0), lambda part: ask(part, lambda: Dying(folder))).count() == 0


def test_short_answers_share_batches_and_long_ones_do_not(spark, monkeypatch):
    rows = [(k, f"0 x{k}") for k in range(300)]
    asked = spark.createDataFrame(rows, "key int, prompt string")

    def handed_on():
        """What the operator's function yields, batch by batch."""
        seen = []

        class Recorder:
            def select(self, *names):
                return self

            dtypes = [("key", "int")]

            def mapInArrow(self, run, layout):
                keys = pa.array([k for k, _ in rows], pa.int32())
                seen.extend(run(iter([pa.RecordBatch.from_arrays([keys, pa.array([p for _, p in rows])], names=["key", "prompt"])])))

        ask(Recorder(), Scripted)
        return [b.num_rows for b in seen]

    assert handed_on() == [300]
    monkeypatch.setattr(complete_module, "CHARS_AT_ONCE", 3 * len(OK))
    assert handed_on() == [3] * 100
    assert {r.key for r in ask(asked, Scripted).filter("text IS NOT NULL").collect()} == set(range(300))
