import random

from pyspark.sql import functions as F

from faultgrain.operators import lifecycle
from faultgrain.schemas import CANDIDATES, CONFIRMED

LOG = "candidate_id bigint, run_id int, step int, kind string, verdict string, detail string"
EVENTS = [
    ("generate_failed", None), ("refused", None), ("audit_ok", None), ("audit_invalid", None), ("audit_invalid", None),
    ("audit_unavailable", None), ("exec", "unreachable"), ("exec", "unreachable"), ("exec", "setup_failure"),
    ("exec", "setup_failure"), ("exec", "true_positive"), ("exec", "false_positive"), ("error", None), ("audit_ok", None),
]


def history(spark, candidate, *runs):
    rows = []
    for run, events in enumerate(runs, 1):
        for step, event in enumerate(events.split(), 1):
            executed = event in ("unreachable", "setup_failure", "true_positive", "false_positive")
            rows.append((candidate, run, step, "exec" if executed else event, event if executed else None, f"why {step}"))
    return spark.createDataFrame(rows, LOG)


def settle(attempts, rewrites=2, budget=3, prior=None):
    outcomes = lifecycle.run_outcomes(attempts, rewrites)
    ends = lifecycle.candidate_ends(outcomes, budget, prior)
    rows = lifecycle.settle(outcomes, ends).orderBy("candidate_id", "run_id").collect()
    return [(r.candidate_id, r.run_id, r.outcome, r.reason) for r in rows], {
        r.candidate_id: r.attempts for r in ends.collect()
    }


def test_single_runs(spark):
    cases = {
        "refused audit_ok": ("generator_refused", "why 1"),
        "audit_invalid audit_ok true_positive": ("proven", None),
        "audit_invalid audit_invalid audit_invalid true_positive": ("audit_rejected", "why 3"),
        "audit_invalid audit_invalid refused": ("generator_refused", "why 3"),
        "audit_unavailable true_positive": ("pending", None),
        "audit_ok unreachable unreachable true_positive": ("proven", None),
        "audit_ok unreachable unreachable unreachable": ("rejected", "no run reached the target path after 2 rewrites"),
        "audit_invalid audit_invalid audit_ok unreachable unreachable false_positive": ("rejected", lifecycle.CLEAN_RUN),
        "audit_ok setup_failure": ("setup_failure", None),
        "audit_ok error": ("failure", None),
        "audit_ok": ("pending", None),
    }
    logs = None
    for i, events in enumerate(cases):
        log = history(spark, i, events)
        logs = log if logs is None else logs.unionByName(log)
    settled, _ = settle(logs)
    assert [(outcome, reason) for _, _, outcome, reason in settled] == list(cases.values())


def test_attempt_budget_across_runs(spark):
    log = history(spark, 1, "setup_failure", "setup_failure", "true_positive")
    settled, attempts = settle(log, budget=2)
    assert [(run, outcome) for _, run, outcome, _ in settled] == [(1, "setup_failure"), (2, "inconclusive")]
    assert settled[1][3] == "no evidence after 2 verification attempt(s)" and attempts == {1: 2}
    prior = spark.createDataFrame([(1, 1)], "candidate_id bigint, verify_attempts int")
    settled, attempts = settle(log, budget=2, prior=prior)
    assert [(run, outcome) for _, run, outcome, _ in settled] == [(1, "inconclusive")] and attempts == {1: 2}


def fold(events, rewrites, budget):
    """The same rules read one event after the other."""
    settled, failures = [], 0
    for run, steps in events:
        bad = missed = 0
        outcome = "pending"
        for kind, verdict in steps:
            event = verdict or kind
            bad += event == "audit_invalid"
            missed += event == "unreachable"
            ends = (
                bad > rewrites if event == "audit_invalid" else missed > rewrites if event == "unreachable" else event != "audit_ok"
            )
            if ends:
                outcome = lifecycle.OUTCOME_BY_EVENT[event]
                break
        failures += outcome == "setup_failure"
        if outcome == "setup_failure" and failures >= budget:
            outcome = "inconclusive"
        settled.append((run, outcome))
        if outcome in (*lifecycle.FINAL_OUTCOMES, "inconclusive"):
            break
    return settled, failures


def test_random_histories_agree_with_a_step_by_step_fold(spark):
    rng = random.Random(11)
    rows, expected, failures = [], [], {}
    rewrites, budget = 1, 3
    for candidate in range(200):
        runs = [(run, [rng.choice(EVENTS) for _ in range(rng.randint(1, 8))]) for run in range(1, rng.randint(2, 8))]
        for run, steps in runs:
            rows += [(candidate, run, step, kind, verdict, "d") for step, (kind, verdict) in enumerate(steps)]
        settled, failures[candidate] = fold(runs, rewrites, budget)
        expected += [(candidate, run, outcome) for run, outcome in settled]
    settled, attempts = settle(spark.createDataFrame(rows, LOG).repartition(4), rewrites, budget)
    assert [row[:3] for row in settled] == expected
    assert attempts == failures


def test_a_busy_candidate_is_cut_down_before_the_shuffle(spark):
    log = history(spark, 1, "unreachable")
    plan = lifecycle.run_outcomes(log)._jdf.queryExecution().executedPlan().toString()
    # From the root down: aggregate, final limit, shuffle, first limit.
    assert plan.index("WindowGroupLimit") < plan.rindex("Exchange") < plan.rindex("WindowGroupLimit")
    assert "collect_list" not in plan


def proven(spark, *rows):
    return spark.createDataFrame(rows, "candidate_id bigint, run_id int, probe_path string, evidence_key string")


def test_confirm(spark):
    stored = spark.createDataFrame([(5, 90, "p90", "old")], CONFIRMED)
    rows = proven(spark, (1, 1, "p1", "k"), (2, 1, "p2", "k"), (3, 1, "p3", "old"), (4, 2, "p4", "z"), (9, 1, "p9", "y"))
    bugs, resolved = lifecycle.confirm(rows.repartition(3), stored)
    assert sorted(tuple(r) for r in bugs.collect()) == [(6, 1, "p1", "k"), (7, 9, "p9", "y"), (8, 4, "p4", "z")]
    got = {r.candidate_id: (r.status, r.bug_id) for r in resolved.collect()}
    assert got == {1: ("confirmed", 6), 2: ("duplicate", 6), 3: ("duplicate", 5), 4: ("confirmed", 8), 9: ("confirmed", 7)}
    again, resolved = lifecycle.confirm(rows, stored.unionByName(bugs))
    assert again.count() == 0 and {r.status for r in resolved.collect()} == {"duplicate"}


def test_updates_keep_a_reason_when_none_is_given(spark):
    base = ("f", "g", 1, "c", "d", "t", "pending")
    candidates = spark.createDataFrame([(1, *base, "old", 1), (2, *base, None, 0), (3, *base, "old", 2)], CANDIDATES)
    updates = spark.createDataFrame([(1, "rejected", None), (2, "rejected", "new")], "candidate_id bigint, status string, reason string")
    ends = spark.createDataFrame([(3, 3)], "candidate_id bigint, attempts int")
    rows = lifecycle.apply_updates(candidates, updates, ends).orderBy("id").collect()
    assert [(r.status, r.reject_reason, r.verify_attempts) for r in rows] == [
        ("rejected", "old", 1), ("rejected", "new", 0), ("pending", "old", 3),
    ]
