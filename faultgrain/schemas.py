"""Table layouts as DDL. Every table is read with its layout, never inferred."""

from __future__ import annotations

_SPAN = "STRUCT<start: INT, end: INT, name: STRING>"

FILES = "path STRING, content STRING"
SNAPSHOT = f"{FILES}, digest STRING, language STRING"
FILE_INDEX = (
    f"path STRING, language STRING, line_count INT, functions ARRAY<{_SPAN}>"
)
CANDIDATES = (
    "id BIGINT, file STRING, function STRING, cwe_id INT, bug_category STRING, "
    "description STRING, trigger STRING, status STRING, reject_reason STRING, verify_attempts INT"
)
CONFIRMED = (
    "id BIGINT, candidate_id BIGINT, probe_path STRING, evidence_key STRING"
)
EXPLORED = "file STRING"
PROBES = "candidate_id BIGINT, interpreter ARRAY<STRING>, script STRING"
RUN_LOG = (
    "candidate_id BIGINT, run_id INT, step INT, exit_code INT, timed_out BOOLEAN, "
    "stdout STRING, stderr STRING, workdir STRING, probe_path STRING"
)
ATTEMPTS = (
    "candidate_id BIGINT, run_id INT, step INT, kind STRING, detail STRING"
)
LOGGED_ATTEMPTS = (
    f"{ATTEMPTS}, exit_code INT, timed_out BOOLEAN, "
    "stdout STRING, stderr STRING, workdir STRING, probe_path STRING"
)
CALLS = "request_id BIGINT, seq INT, status STRING"

# The life of a candidate.
CANDIDATE_STATUSES = ("pending", "rejected", "confirmed", "duplicate", "inconclusive")

# Candidates are kept in two tables: pending ones, which a verification rewrites, and
# settled ones, which only grow.
# ``waiting`` holds the steps of runs that a stream has not seen the end of.
# The key tables say which keys are taken, whatever becomes of the rows.
LEDGER_TABLES = {
    "open": CANDIDATES,
    "closed": CANDIDATES,
    "confirmed": CONFIRMED,
    "explored": EXPLORED,
    "waiting": LOGGED_ATTEMPTS,
    "candidate_keys": "file STRING, function STRING, cwe_id INT",
    "evidence_keys": "evidence_key STRING, id BIGINT",
    "overviews": "corpus_id STRING, overview STRING",
}
# Tables stored in buckets of these columns, which only grow.
LEDGER_KEYS = {
    "explored": ("file",),
    "candidate_keys": ("file", "function", "cwe_id"),
    "evidence_keys": ("evidence_key",),
}
# The key table that rows added to a table are entered in as well.
LEDGER_ENTERED = {"open": "candidate_keys", "confirmed": "evidence_keys"}
