"""Streams with keyed state against the batch rules."""

import random
import time

import pytest

from faultgrain.operators import lifecycle
from faultgrain.operators.triage import triage
from faultgrain.sources.ledger import Ledger
from faultgrain.streaming import keyed_state
from faultgrain.streaming.live_triage import STATE_STORE, keep_state_on_disk
from test_jobs import ATTEMPT, BOTH, CRASH, run


@pytest.fixture
def on_disk(spark):
    before = spark.conf.get(STATE_STORE)
    keep_state_on_disk(spark)
    yield
    spark.conf.set(STATE_STORE, before)


def kinds(pick, candidate, run_id, step):
    kind = pick.choice(["audit_invalid", "audit_invalid", "unreachable", "setup", "generate_failed", "audit_ok", "clean", "refused", "crash"])
    if kind == "unreachable":
        return run(candidate, run_id, step, "PROBE_SETUP_OK")
    if kind == "setup":
        return run(candidate, run_id, step, "", "", 1)
    if kind == "clean":
        return run(candidate, run_id, step, BOTH)
    if kind == "crash":
        return run(candidate, run_id, step, BOTH, CRASH, 1)
    return run(candidate, run_id, step, kind=kind)


def test_shuffled_and_split_batches_equal_the_batch_fold(spark, tmp_path, on_disk):
    pick, steps = random.Random(7), []
    for candidate in range(1, 25):
        for run_id in range(1, pick.randint(2, 6)):
            steps += [kinds(pick, candidate, run_id, step) for step in range(1, pick.randint(2, 7))]
    steps += [kinds(pick, 99, run_id, step) for run_id in range(1, 4) for step in range(1, 60)]
    pick.shuffle(steps)
    steps += steps[:40]  # some arrive twice
    source, out = str(tmp_path / "attempts"), str(tmp_path / "states")
    for part in range(3):
        spark.createDataFrame(steps[part::3], ATTEMPT).coalesce(2).write.mode("append").parquet(source)
        attempts = spark.readStream.schema(ATTEMPT).parquet(source)
        keyed_state.start_attempt_states(attempts, out, str(tmp_path / "ck")).awaitTermination()
    outcomes = lifecycle.run_outcomes(triage(spark.read.parquet(source).distinct()))
    ends = lifecycle.candidate_ends(outcomes)
    final = lifecycle.settle(outcomes, ends)
    status = {r.candidate_id: r.outcome for r in final.collect() if r.outcome in (*lifecycle.FINAL_OUTCOMES, "inconclusive")}
    want = {r.candidate_id: (lifecycle.STATUS_BY_OUTCOME.get(status.get(r.candidate_id), status.get(r.candidate_id, "pending")), r.attempts, r.end_run) for r in ends.collect()}
    got = {r.candidate_id: (r.status, r.attempts, r.end_run) for r in keyed_state.attempt_states(spark, out).collect()}
    assert got == want and len({s for s, *_ in got.values()}) >= 3


def evidence(spark, tmp_path, batch, ledger, remember):
    source = str(tmp_path / "log")
    spark.createDataFrame(batch, ATTEMPT).coalesce(1).write.mode("append").parquet(source)
    log = spark.readStream.schema(ATTEMPT).parquet(source)
    keyed_state.start_first_evidence(log, str(tmp_path / ledger), str(tmp_path / "ck"), remember, salts=2).awaitTermination()
    return [(b.id, b.evidence_key) for b in Ledger(spark, str(tmp_path / ledger)).read("confirmed").orderBy("id").collect()]


def test_an_expired_key_that_comes_again_is_one_bug(spark, tmp_path, on_disk):
    known = [run(2, 1, 1, BOTH, CRASH, 1), run(1, 1, 1, BOTH, CRASH, 1), run(3, 1, 1, BOTH)]
    first = evidence(spark, tmp_path, known, "ledger", "1 second")
    assert [n for n, _ in first] == [1]
    time.sleep(2.5)
    both = evidence(spark, tmp_path, [run(5, 2, 1, BOTH, "new.c:1", 1)], "ledger", "1 second")
    assert both[:1] == first and [n for n, _ in both] == [1, 2] and len(dict(map(reversed, both))) == 2
    time.sleep(0.5)
    again = [run(k, 3, 1, BOTH, CRASH, 1) for k in range(6, 12)]
    assert evidence(spark, tmp_path, again, "ledger", "1 second") == both


def test_state_forgets_and_state_remembers(spark, tmp_path, on_disk):
    """Each batch has a ledger of its own, so only the state can know the key."""
    for remember, places in (("1 second", "short"), ("1 hour", "long")):
        root = tmp_path / places
        assert len(evidence(spark, root, [run(1, 1, 1, BOTH, CRASH, 1)], "one", remember)) == 1
        time.sleep(2.5)
        evidence(spark, root, [run(5, 2, 1, BOTH, "new.c:1", 1)], "two", remember)
        found = evidence(spark, root, [run(1, 1, 1, BOTH, CRASH, 1)], "three", remember)
        assert len(found) == (1 if places == "short" else 0)
