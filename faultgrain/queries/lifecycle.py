"""Attempt-history queries: run outcomes, budgets, confirmation, tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultgrain.bindings import view
from faultgrain.operators import call_budget, lifecycle as ops, tallies
from faultgrain.operators.first_wins import first_per_key
from faultgrain.operators.triage import triage
from faultgrain.queries.registry import query
from faultgrain.queries.triage import VERDICT_SQL
from faultgrain.session import materialize

# The folds in SQL: running counts, then the first step or run that ends the history.
_RUNS = f"""
SELECT candidate_id, run_id, coalesce(arg_min(outcome, step) FILTER (WHERE outcome IS NOT NULL), 'pending') AS outcome,
  arg_min(coalesce(reason, ''), step) FILTER (WHERE outcome IS NOT NULL) AS reason,
  arg_min(evidence_key, step) FILTER (WHERE outcome IS NOT NULL) AS evidence_key,
  arg_min(probe_path, step) FILTER (WHERE outcome IS NOT NULL) AS probe_path,
  coalesce(min(step) FILTER (WHERE outcome IS NOT NULL), -1) AS end_step
FROM (
  SELECT *, CASE WHEN event IN ('generate_failed', 'audit_unavailable') THEN 'pending'
      WHEN event = 'refused' THEN 'generator_refused' WHEN event = 'audit_invalid' AND bad = @n THEN 'audit_rejected'
      WHEN event = 'unreachable' AND missed = @n THEN 'rejected' WHEN event = 'setup_failure' THEN event
      WHEN event = 'true_positive' THEN 'proven' WHEN event = 'false_positive' THEN 'rejected'
      WHEN event = 'error' THEN 'failure' END AS outcome,
    CASE WHEN event IN ('refused', 'audit_invalid') THEN detail WHEN event = 'false_positive' THEN '{ops.CLEAN_RUN}'
      WHEN event = 'unreachable' THEN concat('no run reached the target path after ', @n - 1, ' rewrites') END AS reason
  FROM (
    SELECT *, sum(CASE WHEN event = 'audit_invalid' THEN 1 ELSE 0 END) OVER w AS bad,
      sum(CASE WHEN event = 'unreachable' THEN 1 ELSE 0 END) OVER w AS missed
    FROM (SELECT a.candidate_id, a.run_id, a.step, a.detail, v.evidence_key, v.probe_path,
            CASE WHEN a.kind = 'exec' THEN v.verdict ELSE a.kind END AS event
          FROM ($attempts) a JOIN ({VERDICT_SQL}) v ON a.event_id = v.event_id) t
    WINDOW w AS (PARTITION BY candidate_id, run_id ORDER BY step)) c) e
GROUP BY candidate_id, run_id
"""
_PRIOR = "SELECT DISTINCT user_id AS candidate_id, CAST(user_id % 2 AS INT) AS verify_attempts FROM ($ev) e"
_SETTLED = f"""
SELECT candidate_id, run_id, evidence_key, probe_path, fails,
  CASE WHEN spent THEN 'inconclusive' ELSE outcome END AS outcome,
  CASE WHEN spent THEN concat('no evidence after ', fails, ' verification attempt(s)') ELSE reason END AS reason
FROM (
  SELECT *, coalesce(sum(CASE WHEN spent OR outcome IN ('generator_refused', 'audit_rejected', 'rejected', 'proven')
      THEN 1 ELSE 0 END) OVER (PARTITION BY candidate_id ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
  FROM (SELECT *, outcome = 'setup_failure' AND fails = 3 AS spent
        FROM (SELECT o.*, p.verify_attempts * @prior + sum(CASE WHEN outcome = 'setup_failure' THEN 1 ELSE 0 END)
                OVER (PARTITION BY o.candidate_id ORDER BY run_id) AS fails
              FROM ({_RUNS.replace("@n", "3")}) o JOIN ({_PRIOR}) p ON o.candidate_id = p.candidate_id) s) f) g
WHERE ended = 0
"""
_SETTLED_FRESH = _SETTLED.replace("@prior", "0")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage(view(spark, sf_dir, "attempts"))


def _run_outcomes(spark: SparkSession, sf_dir: str, rewrites: int) -> DataFrame:
    found = ops.run_outcomes(_attempts(spark, sf_dir), rewrites)
    return found.select(
        "candidate_id",
        "run_id",
        "outcome",
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce("end_step", F.lit(-1)).alias("end_step"),
    )


def _runs_sql(rewrites: int) -> str:
    runs = _RUNS.replace("@n", str(rewrites + 1))
    return f"SELECT candidate_id, run_id, outcome, coalesce(reason, '') AS reason, end_step FROM ({runs}) r"


@query(_runs_sql(2))
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ended each run of each candidate, two rewrites allowed."""
    return _run_outcomes(spark, sf_dir, 2)


@query(_runs_sql(0))
def run_outcomes_no_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without any rewrite: the first invalid audit or missed target ends a run."""
    return _run_outcomes(spark, sf_dir, 0)


@query(
    "SELECT run_id, count(*) FILTER (WHERE outcome = 'audit_rejected') AS audit_rejected, "
    "count(*) FILTER (WHERE outcome = 'generator_refused') AS refused, "
    "count(*) FILTER (WHERE outcome = 'pending') AS pending "
    f"FROM ({_RUNS.replace('@n', '2')}) r GROUP BY run_id"
)
def audit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: candidates turned down by the audit after one rewrite, refused, left pending."""
    found = ops.run_outcomes(_attempts(spark, sf_dir), rewrites=1)
    return found.groupBy("run_id").agg(
        tallies.outcome_count("audit_rejected").alias("audit_rejected"),
        tallies.outcome_count("generator_refused").alias("refused"),
        tallies.outcome_count("pending").alias("pending"),
    )


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ("evidence_key", "probe_path")
    return materialize(ops.run_outcomes(_attempts(spark, sf_dir), keep=kept), "outcomes")


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _outcomes(spark, sf_dir)
    return ops.settle(found, ops.candidate_ends(found))


@query(
    f"SELECT candidate_id, run_id, outcome, coalesce(reason, '') AS reason FROM ({_SETTLED_FRESH}) s"
)
def settled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs up to the one that settled a candidate; a spent attempt budget is inconclusive."""
    return _settled(spark, sf_dir).select(
        "candidate_id", "run_id", "outcome", F.coalesce("reason", F.lit("")).alias("reason")
    )


@query(
    "SELECT candidate_id, CAST(max(fails) AS INT) AS attempts, "
    "coalesce(max(run_id) FILTER (WHERE outcome IN ('generator_refused', 'audit_rejected', 'rejected', 'proven', "
    "'inconclusive')), -1) AS end_run, "
    f"max(outcome = 'inconclusive') AS exhausted FROM ({_SETTLED.replace('@prior', '1')}) s GROUP BY candidate_id"
)
def attempt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts counted on top of earlier ones, and the run that used the budget up."""
    found = _outcomes(spark, sf_dir)
    prior = view(spark, sf_dir, "ev").select(
        F.col("user_id").alias("candidate_id"), (F.col("user_id") % 2).cast("int").alias("verify_attempts")
    )
    ends = ops.candidate_ends(found, prior=prior.distinct())
    return ends.select(
        "candidate_id",
        "attempts",
        F.coalesce("end_run", F.lit(-1)).alias("end_run"),
        F.coalesce("exhausted", F.lit(False)).alias("exhausted"),
    )


# Bugs stored before: the first run per evidence key among purchases.
_STORED = f"""
SELECT event_id + 1 AS id, candidate_id, probe_path, evidence_key FROM (
  SELECT *, row_number() OVER (PARTITION BY evidence_key ORDER BY event_id) AS seen
  FROM ({VERDICT_SQL}) v WHERE verdict = 'true_positive' AND event_type = 'purchase') s WHERE seen = 1
"""
_PROVEN = f"SELECT * FROM ({_SETTLED_FRESH}) s WHERE outcome = 'proven'"
_NEW_BUGS = f"""
SELECT row_number() OVER (ORDER BY run_id, candidate_id) + (SELECT max(id) FROM ({_STORED}) m) AS id,
  candidate_id, run_id, probe_path, evidence_key
FROM (SELECT *, row_number() OVER (PARTITION BY evidence_key ORDER BY run_id, candidate_id) AS seen FROM ({_PROVEN}) p) q
WHERE seen = 1 AND evidence_key NOT IN (SELECT evidence_key FROM ({_STORED}) st)
"""
_RESOLVED = f"""
SELECT p.candidate_id, p.run_id, p.evidence_key,
  CASE WHEN n.id IS NOT NULL AND n.candidate_id = p.candidate_id AND n.run_id = p.run_id THEN 'confirmed' ELSE 'duplicate' END AS status,
  CAST(coalesce(n.id, st.id) AS BIGINT) AS bug_id
FROM ({_PROVEN}) p LEFT JOIN ({_NEW_BUGS}) n ON n.evidence_key = p.evidence_key
  LEFT JOIN ({_STORED}) st ON st.evidence_key = p.evidence_key
"""


def stored_bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    proven = triage(view(spark, sf_dir, "run_log")).filter(
        "verdict = 'true_positive' AND event_type = 'purchase'"
    )
    first = first_per_key(proven, ["evidence_key"], ["event_id"])
    bugs = first.select((F.col("event_id") + 1).alias("id"), "candidate_id", "probe_path", "evidence_key")
    return materialize(bugs, "stored-bugs")


def _confirmation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    settled = materialize(_settled(spark, sf_dir), "settled")
    proven = settled.filter("outcome = 'proven'")
    return settled, *ops.confirm(proven, stored_bugs(spark, sf_dir))


@query(f"SELECT CAST(id AS BIGINT) AS id, candidate_id, probe_path, evidence_key FROM ({_NEW_BUGS}) n")
def new_bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bugs added to the stored ones, numbered on in (run, candidate) order."""
    return _confirmation(spark, sf_dir)[1]


@query(f"SELECT * FROM ({_RESOLVED}) r")
def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every proven candidate: confirmed or duplicate, and the bug standing for it."""
    resolved = _confirmation(spark, sf_dir)[2]
    return resolved.select("candidate_id", "run_id", "evidence_key", "status", "bug_id")


_CHAIN = f"""
SELECT s.candidate_id, s.run_id, coalesce(r.status, s.outcome) AS outcome, coalesce(s.reason, '') AS reason,
  coalesce(r.bug_id, 0) AS bug_id
FROM ({_SETTLED_FRESH}) s LEFT JOIN ({_RESOLVED}) r ON r.candidate_id = s.candidate_id AND r.run_id = s.run_id
"""


@query(_CHAIN)
def chain_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole verification: triage, folds, budgets and evidence deduplication."""
    settled, _, resolved = _confirmation(spark, sf_dir)
    return ops.name_proven(settled, resolved).select(
        "candidate_id",
        "run_id",
        "outcome",
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce("bug_id", F.lit(0)).alias("bug_id"),
    )


_COUNTS = {
    "probes": "'confirmed', 'rejected', 'duplicate'",
    "audit_rejected": "'audit_rejected'",
    "generator_refused": "'generator_refused'",
    "confirmed_new": "'confirmed'",
    "rejected": "'rejected'",
    "duplicates": "'duplicate'",
    "pending": "'pending'",
    "setup_failures": "'setup_failure'",
    "inconclusive": "'inconclusive'",
    "verify_failures": "'failure'",
}
VERIFY_TALLIES_SQL = (
    "SELECT run_id, "
    + ", ".join(f"count(*) FILTER (WHERE outcome IN ({names})) AS {column}" for column, names in _COUNTS.items())
    + f" FROM ({_CHAIN}) c GROUP BY run_id"
)


@query(VERIFY_TALLIES_SQL)
def verify_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.verify_tallies(chain_outcomes(spark, sf_dir))


@query(f"SELECT bug_id, count(*) AS candidates FROM ({_RESOLVED}) r GROUP BY bug_id")
def duplicate_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.duplicate_density(_confirmation(spark, sf_dir)[2])


_WAIT = "least(5 * power(2, nth - 1), CASE WHEN kind = 'rate_limited' THEN 300 ELSE 60 END)"


def _calls_sql(rate: int, transient: int) -> str:
    return f"""
SELECT request_id, coalesce(arg_min(CASE WHEN kind IN ('rate_limited', 'transient') THEN concat(kind, '_exhausted') ELSE kind END, seq)
    FILTER (WHERE ends), 'open') AS outcome,
  CAST(count(*) FILTER (WHERE before = 0) AS INT) AS calls,
  CAST(coalesce(sum({_WAIT}) FILTER (WHERE before = 0 AND NOT ends), 0) AS BIGINT) AS waited
FROM (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT *, kind IN ('ok', 'rejected') OR (kind = 'rate_limited' AND nth = {rate + 1})
          OR (kind = 'transient' AND nth = {transient + 1}) AS ends
    FROM (SELECT *, row_number() OVER (PARTITION BY request_id, kind ORDER BY seq) AS nth
      FROM (SELECT *, CASE WHEN status = 'ok' THEN 'ok' WHEN status = '429' THEN 'rate_limited'
              WHEN status = '400' THEN 'rejected' ELSE 'transient' END AS kind FROM ($calls) c) k) n) e) b
GROUP BY request_id
"""


@query(_calls_sql(10, 5))
def call_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each service request replayed against the default retry budgets."""
    return call_budget.replay(view(spark, sf_dir, "calls"))


@query(_calls_sql(1, 0))
def call_budgets_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one rate-limit retry and no other, so most budgets run out."""
    return call_budget.replay(view(spark, sf_dir, "calls"), rate_limit_retries=1, transient_retries=0)
