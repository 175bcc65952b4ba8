"""Ledger queries: inserts, ids, updates, joins, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultgrain.bindings import table, view
from faultgrain.functions import weakness
from faultgrain.operators import contracts, first_wins, lifecycle, report as rep, tallies
from faultgrain.operators.ids import assign_ids
from faultgrain.operators.triage import triage
from faultgrain.plans.explore import store_findings
from faultgrain.queries.lifecycle import VERIFY_TALLIES_SQL, verify_tallies
from faultgrain.queries.registry import query
from faultgrain.queries.triage import VERDICT_SQL
from faultgrain.schemas import CONFIRMED
from faultgrain.session import materialize, scratch_path
from faultgrain.sources import sinks
from faultgrain.sources.ledger import Ledger, by_id, in_id_order, pending, split_by_status

_LABELS = " ".join(f"WHEN {i} THEN '{n.replace(chr(39), chr(39) * 2)}'" for i, n, _ in weakness.WEAKNESSES)
_NOTES = " ".join(f"WHEN {i} THEN '{d.replace(chr(39), chr(39) * 2)}'" for i, _, d in weakness.WEAKNESSES)
_KNOWN = ", ".join(str(i) for i in weakness.WEAKNESS_IDS)
LABEL_SQL = f"concat('CWE-', cwe_id, coalesce(concat(': ', CASE cwe_id {_LABELS} END), ''))".replace(
    "coalesce(concat(': ', CASE", "CASE WHEN cwe_id IN (" + _KNOWN + ") THEN concat(': ', CASE"
).replace("END), '')", "END) ELSE '' END")


@query(
    "SELECT pos, concat(CASE WHEN trigger IS NULL THEN 'trigger is missing' WHEN status <> 'pending' THEN "
    "'status is unknown' ELSE 'accepted' END) AS result FROM ($findings) f"
)
def constraint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings the ledger accepts, and the rest with the constraint they break."""
    accepted, refused = first_wins.split_by_constraints(view(spark, sf_dir, "findings"))
    return accepted.select("pos", F.lit("accepted").alias("result")).unionByName(
        refused.select("pos", F.col("violation").alias("result"))
    )


_STORED_KEYS = "SELECT file, function, cwe_id FROM ($candidates) c WHERE status = 'confirmed'"
_INSERTED = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, function, cwe_id ORDER BY pos) AS seen
  FROM ($findings) f WHERE trigger IS NOT NULL AND status = 'pending') g
WHERE seen = 1 AND (file, function, cwe_id) NOT IN ({_STORED_KEYS})
"""


def _inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = view(spark, sf_dir, "candidates").filter("status = 'confirmed'")
    return first_wins.new_candidates(view(spark, sf_dir, "findings"), stored, order=["pos"])


@query(
    "SELECT pos, file, function, cwe_id, bug_category, description, trigger, status, '' AS reject_reason, "
    f"CAST(0 AS INT) AS verify_attempts FROM ({_INSERTED}) i"
)
def candidate_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-or-ignore by (file, function, cwe_id) against the batch and the stored table."""
    return _inserted(spark, sf_dir).withColumn("reject_reason", F.coalesce("reject_reason", F.lit("")))


@query(f"SELECT pos, CAST(row_number() OVER (ORDER BY file, pos) + 100 AS BIGINT) AS id FROM ({_INSERTED}) i")
def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gapless ids in (file, position) order, continuing after 100."""
    return assign_ids(_inserted(spark, sf_dir), ["file", "pos"], start=101).select("pos", "id")


@query(
    "SELECT event_id, evidence_key FROM (SELECT *, row_number() OVER (PARTITION BY evidence_key ORDER BY event_id) AS seen "
    f"FROM ({VERDICT_SQL}) v WHERE verdict = 'true_positive') s WHERE seen = 1"
)
def evidence_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-or-ignore of proven runs by evidence key into an empty table."""
    proven = triage(view(spark, sf_dir, "run_log")).filter("verdict = 'true_positive'")
    none = spark.createDataFrame([], CONFIRMED)
    return first_wins.insert_or_ignore(proven, none, ["evidence_key"], ["event_id"]).select(
        "event_id", "evidence_key"
    )


_UPDATES = """
SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'rejected' WHEN 'click' THEN 'inconclusive'
    WHEN 'error' THEN 'duplicate' END AS status, CASE WHEN k % 2 = 0 THEN concat('note ', k) END AS reason,
  CASE WHEN event_type = 'click' THEN k % 4 END AS attempts
FROM ($ev) e
"""


@query(
    "SELECT c.id, coalesce(u.status, c.status) AS status, "
    "coalesce(CASE WHEN u.status IS NOT NULL THEN u.reason END, c.reject_reason, '') AS reject_reason, "
    "CAST(coalesce(u.attempts, c.verify_attempts) AS INT) AS verify_attempts "
    f"FROM ($candidates) c LEFT JOIN ({_UPDATES}) u ON u.id = c.id"
)
def status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New status, reason only where one is given, new attempt counts."""
    event = view(spark, sf_dir, "ev").withColumnRenamed("event_id", "candidate_id")
    status = (
        F.when(F.col("event_type") == "view", "rejected")
        .when(F.col("event_type") == "click", "inconclusive")
        .when(F.col("event_type") == "error", "duplicate")
    )
    reason = F.when(F.col("k") % 2 == 0, F.concat(F.lit("note "), F.col("k")))
    updates = event.select("candidate_id", status.alias("status"), reason.alias("reason")).filter("status IS NOT NULL")
    counts = event.filter("event_type = 'click'").select("candidate_id", (F.col("k") % 4).alias("attempts"))
    updated = lifecycle.apply_updates(view(spark, sf_dir, "candidates"), updates, counts)
    return updated.select(
        "id", "status", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"), "verify_attempts"
    )


@query(
    "SELECT candidate_id, step, script FROM (SELECT candidate_id, event_id AS step, "
    "concat('print(''PROBE_SETUP_OK''); print(''PROBE_REACHED''); run(', k, ')') AS script, "
    "row_number() OVER (PARTITION BY candidate_id ORDER BY event_id DESC) AS seen "
    "FROM ($probe_answers) p WHERE event_type = 'click') s WHERE seen = 1"
)
def latest_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last valid script per candidate, written to and read from the probe sink."""
    judged = contracts.judge_probes(view(spark, sf_dir, "probe_answers")).filter("kind = 'probe'")
    latest = first_wins.latest_per_key(judged, ["candidate_id"], ["event_id"])
    folder = scratch_path(spark, "probes")
    sinks.write_probes(latest.withColumnRenamed("event_id", "step"), folder, "step")
    return spark.read.parquet(folder).select("candidate_id", "step", "script")


@query("SELECT id, cwe_id, status FROM ($candidates) c WHERE id = (SELECT max(id) FROM ($candidates) m)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate by id, and an id nothing has."""
    candidates = view(spark, sf_dir, "candidates")
    last = candidates.agg(F.max("id")).first()[0]
    found = by_id(candidates, last).unionByName(by_id(candidates, last + 1))
    return found.select("id", "cwe_id", "status")


@query("SELECT id, file, function, cwe_id FROM ($candidates) c WHERE status = 'pending'")
def pending_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = in_id_order(pending(view(spark, sf_dir, "candidates")))
    return found.select("id", "file", "function", "cwe_id")


@query("SELECT *, CAST(2 AS INT) AS version FROM ($candidates) c")
def ledger_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates through the versioned ledger: append, move the settled, read in id order."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    ledger.commit(append={"open": view(spark, sf_dir, "candidates")})
    still_open, closed = split_by_status(ledger.read("open"))
    ledger.commit(append={"closed": closed}, replace={"open": still_open})
    return in_id_order(ledger.candidates()).withColumn("version", F.lit(ledger.version))


@query(
    "SELECT 1 AS run, count(*) AS candidates, count(DISTINCT file) AS files FROM (SELECT DISTINCT file, k % 15, 79 "
    "FROM ($answers) a WHERE event_type IN ('click', 'error') OR (event_type = 'view' AND k % 4 = 2) "
    "OR (event_type = 'signup' AND k % 5 = 4)) d "
    "UNION ALL SELECT 2, count(*), count(DISTINCT file) FROM (SELECT DISTINCT file, k % 15, 79 "
    "FROM ($answers) a WHERE event_type IN ('click', 'error') OR (event_type = 'view' AND k % 4 = 2) "
    "OR (event_type = 'signup' AND k % 5 = 4)) d"
)
def rerun_adds_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers stored twice: the second run leaves the ledger as it was."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    judged = materialize(contracts.judge_issues(view(spark, sf_dir, "answers")), "judged")
    counts = None
    for run in (1, 2):
        store_findings(ledger, judged)
        after = ledger.candidates().agg(
            F.count("*").alias("candidates"), F.count_distinct("file").alias("files")
        )
        after = after.withColumn("run", F.lit(run))
        counts = after if counts is None else counts.unionByName(after)
    return counts


_FOUND = (
    "SELECT DISTINCT file, concat('fn', k % 15) AS function, event_id % 5 AS batch FROM ($answers) a "
    "WHERE event_type IN ('click', 'error') OR (event_type = 'view' AND k % 4 = 2) OR (event_type = 'signup' AND k % 5 = 4)"
)


@query(
    "SELECT row_number() OVER (ORDER BY batch, file, function) AS id, file, function FROM "
    f"(SELECT file, function, min(batch) AS batch FROM ({_FOUND}) f GROUP BY file, function) g"
)
def ledger_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers stored in five batches: each finds its new keys in the bucketed key tables and goes on with the ids."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    # One finding a file and function, so that ids follow file and function inside a batch.
    judged = materialize(contracts.judge_issues(view(spark, sf_dir, "answers")).filter("ok"), "judged")
    for batch in range(5):
        arrived = judged.filter(F.col("event_id") % 5 == batch)
        offered = contracts.explode_issues(arrived).filter("pos = 0")
        offered = first_wins.first_per_key(offered, ["file", "function"], ["function"])
        new = first_wins.new_candidates(offered, ledger.runs("candidate_keys"), ["function"], ledger.buckets)
        ledger.commit(append={"open": assign_ids(new, ["file", "function"], start=ledger.next_id("open"))})
    return ledger.candidates().select("id", "file", "function")


_BUGS = """
SELECT CAST(id * 3 AS BIGINT) AS id, id AS candidate_id, concat('probe_', id) AS probe_path, concat('key', id) AS evidence_key
FROM ($candidates) c WHERE status = 'confirmed'
"""


def _bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    confirmed = view(spark, sf_dir, "candidates").filter("status = 'confirmed'")
    return confirmed.select(
        (F.col("id") * 3).alias("id"),
        F.col("id").alias("candidate_id"),
        F.concat(F.lit("probe_"), F.col("id")).alias("probe_path"),
        F.concat(F.lit("key"), F.col("id")).alias("evidence_key"),
    )


@query(
    "SELECT b.id, b.candidate_id, b.evidence_key, c.file, c.function, c.cwe_id, c.description "
    f"FROM ({_BUGS}) b JOIN ($candidates) c ON c.id = b.candidate_id"
)
def confirmed_with_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = rep.confirmed_with_candidates(_bugs(spark, sf_dir), view(spark, sf_dir, "candidates"))
    return joined.select("id", "candidate_id", "evidence_key", "file", "function", "cwe_id", "description")


@query(
    "SELECT event_id AS id, user_id AS candidate_id FROM ($ev) e "
    "WHERE user_id NOT IN (SELECT id FROM ($candidates) c)"
)
def orphan_bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bugs that point at no candidate: a load must refuse them."""
    bugs = view(spark, sf_dir, "ev").select(F.col("event_id").alias("id"), F.col("user_id").alias("candidate_id"))
    return rep.orphans(bugs, view(spark, sf_dir, "candidates"))


@query(f"SELECT pos, cwe_id IN ({_KNOWN}) AS known FROM ($findings) f")
def vocabulary_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "findings").select("pos", weakness.is_known(F.col("cwe_id")).alias("known"))


@query(
    f"SELECT id, coalesce(CASE cwe_id {_LABELS} END, '?') AS name, coalesce(CASE cwe_id {_NOTES} END, '?') AS note, "
    f"{LABEL_SQL} AS label FROM ($candidates) c"
)
def weakness_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, note and display label of each candidate's weakness."""
    cwe_id = F.col("cwe_id")
    return view(spark, sf_dir, "candidates").select(
        "id",
        F.coalesce(weakness.name_of(cwe_id), F.lit("?")).alias("name"),
        F.coalesce(weakness.describe(cwe_id), F.lit("?")).alias("note"),
        weakness.label(cwe_id).alias("label"),
    )


@query("SELECT status, count(*) AS n FROM ($candidates) c GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.status_counts(view(spark, sf_dir, "candidates"))


# Valid answers and the issue rows they report.
_VALID = (
    "(event_type IN ('click', 'error') OR (event_type = 'view' AND k % 4 IN (0, 2)) "
    "OR (event_type = 'signup' AND k % 5 = 4))"
)
_OFFERED = f"""
SELECT run_id, event_id, file, concat('fn', k % 15) AS function FROM ($answers) a
WHERE {_VALID} AND NOT (event_type = 'view' AND k % 4 = 0)
UNION ALL SELECT run_id, event_id, file, concat('fn', k % 15) FROM ($answers) a WHERE event_type = 'view' AND k % 4 = 2
"""
EXPLORATION_TALLIES_SQL = f"""
SELECT run_id, count(*) FILTER (WHERE what = 'todo') AS files, count(*) FILTER (WHERE what = 'skipped') AS files_skipped,
  count(*) FILTER (WHERE what = 'new') AS candidates_new,
  count(*) FILTER (WHERE what = 'offered') - count(*) FILTER (WHERE what = 'new') AS candidates_dup,
  count(*) FILTER (WHERE what = 'failed') AS answer_failures
FROM (
  SELECT CAST(doc_id % 30 + 1 AS INT) AS run_id,
    CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skipped' ELSE 'todo' END AS what FROM documents
  UNION ALL SELECT run_id, 'failed' FROM ($answers) a WHERE NOT {_VALID}
  UNION ALL SELECT run_id, 'offered' FROM ({_OFFERED}) o
  UNION ALL SELECT min(run_id), 'new' FROM ({_OFFERED}) o GROUP BY file, function) w
GROUP BY run_id
"""


@query(EXPLORATION_TALLIES_SQL)
def exploration_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tasks, labelled ones as explored; findings of the answers per run."""
    tasks = table(spark, sf_dir, "documents").withColumn("run_id", (F.col("doc_id") % 30 + 1).cast("int"))
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    judged = materialize(contracts.judge_issues(view(spark, sf_dir, "answers")), "judged")
    by_run = judged.select("run_id", "event_id", "ok", "json", F.concat_ws("#", "run_id", "event_id", "file").alias("file"))
    offered = contracts.explode_issues(by_run)
    source = F.split("file", "#")
    offered = offered.select(
        source[0].cast("int").alias("run_id"),
        source[1].cast("bigint").alias("event_id"),
        source[2].alias("file"),
        "pos", "function", "cwe_id", "bug_category", "description", "trigger", "status",
    )
    none = view(spark, sf_dir, "candidates").filter("id < 0")
    new = first_wins.new_candidates(offered, none, order=["run_id", "event_id", "pos"])
    return tallies.exploration_tallies(
        tasks.join(labelled, "doc_id", "left_anti"),
        tasks.join(labelled, "doc_id", "left_semi"),
        judged.filter("NOT ok"),
        offered,
        new,
    )


_SUMMED = (
    "files files_skipped candidates_new candidates_dup answer_failures probes audit_rejected generator_refused "
    "confirmed_new rejected duplicates pending setup_failures inconclusive verify_failures"
).split()


@query(
    "SELECT coalesce(e.run_id, v.run_id) AS run_id, "
    + ", ".join(f"coalesce({column}, 0) AS {column}" for column in _SUMMED)
    + f" FROM ({EXPLORATION_TALLIES_SQL}) e FULL JOIN ({VERIFY_TALLIES_SQL}) v ON v.run_id = e.run_id"
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.run_summary(exploration_tallies(spark, sf_dir), verify_tallies(spark, sf_dir))


_UNRESOLVED = "SELECT * FROM ($candidates) c WHERE status IN ('inconclusive', 'rejected')"


@query(f"SELECT id, file, function, status FROM ({_UNRESOLVED}) u")
def unresolved_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rep.unresolved(view(spark, sf_dir, "candidates")).select("id", "file", "function", "status")


_LF = "chr(10)"


def _line_sql(*cells: str) -> str:
    shown = [f"replace(regexp_replace(coalesce(CAST({c} AS VARCHAR), ''), '[\\r\\n]+', ' ', 'g'), '|', '\\|')" for c in cells]
    return "concat('| ', " + ", ' | ', ".join(shown) + ", ' |')"


def _head_sql(columns: tuple[str, ...]) -> str:
    return ", ".join(f"'{line}'" for line in rep.table_head(columns).split("\n")).replace("', '", f"', {_LF}, '")


_BUG_ROWS = f"({_BUGS}) b JOIN ($candidates) c ON c.id = b.candidate_id"
_BUG_GROUPS = f"(SELECT DISTINCT c.cwe_id FROM {_BUG_ROWS}) g"
_BUG_BLOCKS = f"""
SELECT 1 AS section, cwe_id AS grp, 0 AS kind, '' AS first, '' AS second, 0 AS id,
  concat('## ', {LABEL_SQL}, {_LF}, {_LF}, {_head_sql(rep.BUG_COLUMNS)}) AS text FROM {_BUG_GROUPS}
UNION ALL SELECT 1, cwe_id, 1, function, '', b.id,
  {_line_sql("b.id", "function", "file", "bug_category", "description", "trigger", "probe_path", "evidence_key")} FROM {_BUG_ROWS}
UNION ALL SELECT 1, cwe_id, 2, '', '', 0, '' FROM {_BUG_GROUPS}
"""
_APPENDIX_BLOCKS = f"""
SELECT 2 AS section, 0 AS grp, 0 AS kind, '' AS first, '' AS second, 0 AS id,
  concat('{rep.OPEN_TITLE}', {_LF}, {_LF}, {_head_sql(rep.OPEN_COLUMNS)}) AS text
FROM (SELECT count(*) AS n FROM ({_UNRESOLVED}) u) a WHERE n > 0
UNION ALL SELECT 3, CASE status WHEN 'inconclusive' THEN 0 ELSE 1 END, 1, file, function, id,
  {_line_sql("status", "file", "function", LABEL_SQL, "verify_attempts", "reject_reason")} FROM ({_UNRESOLVED}) u
"""
_REPORT_BLOCKS = (
    f"SELECT 0 AS section, 0 AS grp, 0 AS kind, '' AS first, '' AS second, 0 AS id, concat('{rep.TITLE.strip()}', {_LF}) AS text "
    f"UNION ALL SELECT * FROM ({_BUG_BLOCKS}) b UNION ALL SELECT * FROM ({_APPENDIX_BLOCKS}) a"
)


@query(_BUG_BLOCKS)
def report_bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings per weakness and entries per bug, with their sort keys."""
    bugs = rep.confirmed_with_candidates(_bugs(spark, sf_dir), view(spark, sf_dir, "candidates"))
    return rep.bug_blocks(bugs)


@query(_APPENDIX_BLOCKS)
def report_appendix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rep.appendix_blocks(view(spark, sf_dir, "candidates"))


@query(f"SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, {_LF})) AS line FROM ({_REPORT_BLOCKS}) t) l GROUP BY line")
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report written as ordered text and read back, counted by line."""
    folder = scratch_path(spark, "report")
    sinks.write_report(rep.report(_bugs(spark, sf_dir), view(spark, sf_dir, "candidates")), folder)
    return spark.read.text(folder).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(
    "SELECT CAST(generate_subscripts(lines, 1) AS BIGINT) AS position, unnest(lines) AS line FROM "
    f"(SELECT string_split(string_agg(text, {_LF} ORDER BY section, grp, kind, first, second, id), {_LF}) AS lines FROM ({_REPORT_BLOCKS}) b) l"
)
def report_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report published, then another in its place: what readers see, line by line in its order."""
    folder, candidates = scratch_path(spark, "report"), view(spark, sf_dir, "candidates")
    bugs = _bugs(spark, sf_dir)
    sinks.publish_report(rep.report(bugs.filter("id % 2 = 0"), candidates), folder)
    sinks.publish_report(rep.report(bugs, candidates), folder)
    return sinks.read_report(spark, folder)


@query("SELECT row_number() OVER (ORDER BY id) AS place, id, file FROM ($candidates) c WHERE status = 'pending'")
def pending_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending candidates in id order, by the place where a reader of the written rows finds them."""
    found = in_id_order(pending(view(spark, sf_dir, "candidates"))).select("id", "file")
    return _placed(spark, found, "place")


@query("SELECT row_number() OVER (ORDER BY id) AS place, id, status FROM ($candidates) c")
def ledger_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of a ledger in id order, settled ones apart from pending ones, by their written place."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    still_open, closed = split_by_status(view(spark, sf_dir, "candidates"))
    ledger.commit(append={"closed": closed, "open": still_open})
    return _placed(spark, in_id_order(ledger.candidates()).select("id", "status"), "place")


def _placed(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written as they come, with the place from 1 at which each one stands in the files."""
    folder = scratch_path(spark, "ordered")
    rows.write.parquet(folder)
    written = spark.read.schema(rows.schema).parquet(folder).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return assign_ids(written, ["_file", "_row"], column=name).select(name, *rows.columns)
