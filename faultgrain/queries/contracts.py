"""Answer-contract queries. Each answer is built from a known class, so SQL states the judgement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultgrain.bindings import table, view
from faultgrain.operators import contracts as ops
from faultgrain.operators.rule_table import first_rule_of_table
from faultgrain.operators.rules import first_rule
from faultgrain.queries.registry import query

_ITEM = """concat('{"function":"fn', k % 15, '","cwe_id":79,"bug_category":"', event_type, '","description":"seen","trigger":"input ', k, '"}')"""
_DOCUMENT = f"""CASE event_type
    WHEN 'view' THEN CASE k % 4 WHEN 0 THEN '[]' WHEN 1 THEN NULL WHEN 2 THEN concat('[', item, ',', item, ']')
      ELSE concat('{{"issues":[', item, ']}}') END
    WHEN 'signup' THEN CASE k % 5 WHEN 1 THEN item WHEN 4 THEN concat('[', item, ']') END
    WHEN 'purchase' THEN text ELSE concat('[', item, ']') END"""
_SCAN_ERROR = """CASE WHEN event_type = 'view' AND k % 4 = 1 THEN 'not valid JSON: Expecting value: line 1 column 1 (char 0)'
    WHEN event_type = 'signup' AND k % 5 = 0 THEN 'several JSON values'
    WHEN event_type = 'signup' AND k % 5 IN (2, 3) THEN 'neither a JSON object nor an array' END"""
_SCANNED = f"""
SELECT event_id, event_type, run_id, file, k, {_DOCUMENT} AS json, {_SCAN_ERROR} AS scan_error
FROM (SELECT *, {_ITEM} AS item FROM ($answers) a) i
"""


@query(f"SELECT event_id, coalesce(json, '') AS json, coalesce(scan_error, '') AS error FROM ({_SCANNED}) s")
def single_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one JSON document of each answer, or why there is none."""
    none = F.lit("")
    return ops.extract(view(spark, sf_dir, "answers")).select(
        "event_id", F.coalesce("json", none).alias("json"), F.coalesce("error", none).alias("error")
    )


_ISSUE_ERROR = """coalesce(scan_error, CASE
    WHEN event_type = 'view' AND k % 4 = 3 OR event_type = 'signup' AND k % 5 = 1 THEN 'expected a JSON array of issues'
    WHEN event_type = 'purchase' THEN CASE WHEN k % 7 IN (3, 4) THEN
        'an issue needs exactly the keys function, cwe_id, bug_category, description, trigger'
      WHEN k % 7 = 5 THEN 'issue texts must not be blank' ELSE 'cwe_id must be an integer from the list' END END)"""
_JUDGED = f"SELECT *, {_ISSUE_ERROR} AS error FROM ({_SCANNED}) s"


@query(f"SELECT event_id, error IS NULL AS ok, coalesce(error, '') AS error FROM ({_JUDGED}) j")
def issue_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue reports judged as a whole: one bad issue fails its report."""
    judged = ops.judge_issues(view(spark, sf_dir, "answers"))
    return judged.select("event_id", "ok", F.coalesce("error", F.lit("")).alias("error"))



@query(
    "SELECT event_id, CAST(pos AS INT) AS pos, file, json_extract_string(issue, '/function') AS function, "
    "CAST(json_extract(issue, '/cwe_id') AS INT) AS cwe_id, json_extract_string(issue, '/bug_category') AS bug_category, "
    "json_extract_string(issue, '/description') AS description, json_extract_string(issue, '/trigger') AS trigger "
    "FROM (SELECT event_id, file, pos, json_extract(json, concat('/', pos)) AS issue FROM "
    f"(SELECT *, unnest(range(0, json_array_length(json)::BIGINT)) AS pos FROM ({_JUDGED}) j WHERE error IS NULL) u) x"
)
def issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rows of the valid reports, with file and position."""
    judged = ops.judge_issues(view(spark, sf_dir, "answers"))
    tagged = judged.withColumn("file", F.concat_ws("#", "event_id", "file"))
    rows = ops.explode_issues(tagged).drop("status")
    source = F.split("file", "#")
    return rows.withColumn("event_id", source[0].cast("bigint")).withColumn("file", source[1])


@query(
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'refusal' WHEN 'click' THEN 'probe' ELSE 'invalid' END AS kind,
  CASE event_type WHEN 'click' THEN 'python3 -u' ELSE '' END AS command,
  CASE event_type WHEN 'click' THEN concat('print(''PROBE_SETUP_OK''); print(''PROBE_REACHED''); run(', k, ')') ELSE '' END AS script,
  CASE event_type WHEN 'view' THEN concat('no entry point ', k) ELSE '' END AS reason,
  CASE event_type WHEN 'error' THEN 'interpreter must be a non-empty array of non-empty texts'
    WHEN 'signup' THEN CASE WHEN k % 3 = 1 THEN 'a refusal needs a reason' ELSE 'refuse must be true' END
    WHEN 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'script must print PROBE_REACHED'
      ELSE 'expected the keys interpreter and script, or refuse and reason' END ELSE '' END AS error
FROM ($probe_answers) p"""
)
def probe_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes and refusals."""
    judged = ops.judge_probes(view(spark, sf_dir, "probe_answers"))
    texts = {name: F.coalesce(name, F.lit("")) for name in ("script", "reason", "error")}
    command = F.coalesce(F.array_join("interpreter", " "), F.lit(""))
    return judged.select(
        "event_id", "kind", command.alias("command"), *(text.alias(name) for name, text in texts.items())
    )


@query(
    """SELECT event_id, CASE WHEN event_type = 'view' OR event_type = 'purchase' AND k % 2 = 1 THEN 'audit_ok'
    WHEN event_type = 'click' THEN 'audit_invalid' ELSE 'audit_unavailable' END AS audit_kind,
  CASE event_type WHEN 'click' THEN concat('expects the bug ', k) WHEN 'purchase' THEN CASE WHEN k % 2 = 1 THEN 'x' ELSE '' END
    ELSE '' END AS feedback,
  CASE event_type WHEN 'error' THEN 'invalid needs feedback'
    WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'verdict must be ok or invalid' ELSE 'feedback must be text' END
    WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'expected exactly the keys verdict and feedback' ELSE '' END
    ELSE '' END AS error
FROM ($audit_answers) a"""
)
def audit_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ops.judge_audits(view(spark, sf_dir, "audit_answers"))
    return judged.select(
        "event_id",
        "audit_kind",
        F.coalesce("feedback", F.lit("")).alias("feedback"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query(f"SELECT run_id, error IS NULL AS ok, count(*) AS n FROM ({_JUDGED}) j GROUP BY ALL")
def reports_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and failed reports per run."""
    judged = ops.judge_issues(view(spark, sf_dir, "answers"))
    return judged.groupBy("run_id", "ok").agg(F.count("*").alias("n"))


_RULES = (("que que", "doubled"), ("http", "link"), ("tion", "suffix"), ("the ", "english"), (" de ", "romance"))
_RULE_SQL = (
    "CASE " + " ".join(f"WHEN contains(text, '{m}') THEN '{v}'" for m, v in _RULES) + " ELSE 'other' END"
)


@query(
    f"SELECT 'd' AS src, doc_id AS id, {_RULE_SQL} AS tag FROM documents UNION ALL "
    f"SELECT 'c', conv_id * 1000 + turn, {_RULE_SQL} FROM conversations"
)
def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of five ordered rules found in each document and turn."""
    tag = first_rule(F.col("text"), _RULES, "other").alias("tag")
    turns = table(spark, sf_dir, "conversations")
    return table(spark, sf_dir, "documents").select(F.lit("d").alias("src"), F.col("doc_id").alias("id"), tag).unionByName(
        turns.select(F.lit("c").alias("src"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), tag)
    )


_MARKERS = (
    "SELECT item_id AS ord, substr(text, 1, 14) AS marker, concat('item ', item_id) AS value FROM benchmark "
    "UNION ALL SELECT 100000 + p_partkey, concat('f', p_partkey), concat('part ', p_partkey) FROM part"
)


@query(
    f"SELECT doc_id, coalesce(value, '') AS value FROM (SELECT d.doc_id, r.value, row_number() OVER (PARTITION BY d.doc_id ORDER BY r.ord, r.marker) AS n "
    f"FROM documents d LEFT JOIN ({_MARKERS}) r ON contains(d.text, r.marker)) j WHERE n = 1"
)
def rule_table_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule of a table that each document contains: beginnings of benchmark items, then part numbers."""
    items, parts = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "part")
    rules = items.select(F.col("item_id").cast("long").alias("ord"), F.substring("text", 1, 14).alias("marker"), F.concat(F.lit("item "), "item_id").alias("value"))
    numbers = F.col("p_partkey").cast("long")
    more = parts.select((numbers + 100000).alias("ord"), F.concat(F.lit("f"), numbers).alias("marker"), F.concat(F.lit("part "), numbers).alias("value"))
    found = first_rule_of_table(table(spark, sf_dir, "documents").select("doc_id", "text"), rules.unionByName(more), block_bytes=1 << 12)
    return found.select("doc_id", F.coalesce("value", F.lit("")).alias("value"))
