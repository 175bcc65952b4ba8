"""What jobs keep for the next one: overviews, and new probes for runs that missed their target."""

import sys

import pytest
from pyspark import cloudpickle

from faultgrain.operators.complete import RuleClient
from faultgrain.operators.triage import triage
from faultgrain.plans.explore import explore
from faultgrain.plans.overview import stored_overviews
from faultgrain.plans.probe import MISSED, rewrite_unreachable
from faultgrain.sources.ledger import Ledger
from test_jobs import ATTEMPT, BOTH, run

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SETUP = "PROBE_SETUP_OK\n"


class Noting:
    """Writes an overview, or no issues; notes what it was asked."""

    def __init__(self, place):
        self._place = place

    def complete(self, prompt):
        with open(self._place, "a") as notes:
            notes.write(prompt.replace("\n", " ") + "\n")
        return "[]" if prompt.startswith("EXPLORE") else "about " + prompt.split("- ")[1].split("/")[0]


def test_an_exploration_makes_overviews_once(spark, tmp_path):
    files = spark.createDataFrame([("one/a.c", "int f(int a) {\n}\n"), ("two/b.c", ""), ("two/c.c", "x")], "path string, content string")
    ledger, place = Ledger(spark, str(tmp_path / "ledger"), buckets=2), str(tmp_path / "asked")
    client = lambda: Noting(place)
    explore(ledger, files.filter("path < 'two/c'"), client, overview=client).collect()
    asked = open(place).read().splitlines()
    assert sum(not a.startswith("EXPLORE") for a in asked) == 2
    assert any("about one" in a and "one/a.c" in a for a in asked) and any("about two" in a and "two/b.c" in a for a in asked)
    explore(ledger, files, client, overview=client).collect()
    new = open(place).read().splitlines()[len(asked) :]
    assert len(new) == 1 and new[0].startswith("EXPLORE") and "about two" in new[0]
    assert {r.corpus_id: r.overview for r in ledger.read("overviews").collect()} == {"one": "about one", "two": "about two"}


def test_a_corpus_without_overview_fails_after_the_others_are_stored(spark, tmp_path):
    layout = "path string, language string, line_count int, functions array<struct<start:int,end:int,name:string>>"
    index = spark.createDataFrame([("a/x.c", "c", 1, None), ("b/y.c", "c", 1, [])], layout)
    ledger = Ledger(spark, str(tmp_path))
    with pytest.raises(RuntimeError, match="corpus b"):
        stored_overviews(ledger, index, lambda: RuleClient([("a/x", "good")]))
    assert [r.corpus_id for r in stored_overviews(ledger, index, lambda: RuleClient([]), fail_fast=False).collect()] == ["a"]


class Writer:
    def complete(self, prompt):
        if "file f3.c" in prompt:
            return '{"refuse":true,"reason":"no way"}'
        told = MISSED.strip() in prompt and "stuck" in prompt
        return '{"interpreter":["sh"],"script":"PROBE_SETUP_OK PROBE_REACHED %s"}' % told


def test_only_open_runs_that_missed_are_rewritten(spark):
    steps = [
        run(1, 1, 1, SETUP, "stuck"),  # missed once
        run(1, 2, 1, SETUP, "stuck"), run(1, 2, 2, SETUP, "stuck"),  # twice, the budget lasts
        run(2, 1, 1, SETUP, "stuck"), run(2, 1, 2, SETUP, "stuck"), run(2, 1, 3, SETUP, "stuck"),  # spent
        run(2, 2, 1, SETUP, "stuck"), run(2, 2, 2, BOTH),  # ended by the next probe
        run(2, 3, 1, SETUP, "stuck"), run(2, 3, 2, kind="audit_ok"),  # not its last step
        run(3, 1, 4, SETUP, "stuck"),
    ]
    attempts = triage(spark.createDataFrame(steps, ATTEMPT))
    candidates = spark.createDataFrame(
        [(i, f"f{i}.c", "f", 369, "m", "d", "t") for i in (1, 2, 3)],
        "id bigint, file string, function string, cwe_id int, bug_category string, description string, trigger string",
    )
    probes, none = rewrite_unreachable(candidates, attempts, Writer)
    assert sorted((r.candidate_id, r.run_id, r.step, r.script) for r in probes.collect()) == [
        (1, 1, 2, "PROBE_SETUP_OK PROBE_REACHED True"), (1, 2, 3, "PROBE_SETUP_OK PROBE_REACHED True"),
    ]
    assert [(r.candidate_id, r.run_id, r.step, r.kind, r.detail) for r in none.collect()] == [(3, 1, 5, "refused", "no way")]
