"""Run-log triage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultgrain.bindings import table, view
from faultgrain.functions import evidence as ev
from faultgrain.functions.text import decode_utf8, not_blank, strip, tail
from faultgrain.operators import triage as ops
from faultgrain.queries.registry import query

# The engine's classes of word characters and white space in RE2 spelling.
_W = r"\p{L}\p{N}_"
_S = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# The evidence of a run in SQL, one step per row fact.
_NORMALIZED = """
SELECT *, replace(stderr, probe_path, '$PROBE') AS err,
  concat(stdout, chr(10), replace(stderr, probe_path, '$PROBE')) AS output FROM ($run_log) r
""".replace("'$PROBE'", "concat(chr(36), 'PROBE')")
_FRAMES = f"""
SELECT *, list_transform(list_filter(list_transform(string_split(err, chr(10)), lambda line:
    coalesce(nullif(regexp_extract(line, 'File "([^"]+)", line [0-9]+', 1), ''),
             nullif(regexp_extract(line, '([{_W}./-]+:[0-9]+)', 1), ''))),
    lambda loc: loc IS NOT NULL)[1:3], lambda loc: replace(loc, workdir, concat(chr(36), 'WORK'))) AS frames
FROM ({_NORMALIZED}) n
"""
_MARKERS = (
    "AddressSanitizer", "UndefinedBehaviorSanitizer", "ThreadSanitizer", "MemorySanitizer",
    "LeakSanitizer", "runtime error:", "Traceback (most recent call last)",
)
_HITS = "list_filter([" + ", ".join(f"'{m}'" for m in _MARKERS) + "], lambda m: contains(output, m))"
_BLANKLESS = f"regexp_replace(replace(err, workdir, concat(chr(36), 'WORK')), '^[{_S}]+|[{_S}]+$', '', 'g')"
EVIDENCE_SQL = f"""
SELECT event_id, candidate_id, run_id, step, exit_code, timed_out, probe_path, k, event_type,
  array_to_string({_HITS}, '; ') AS hits,
  contains(output, 'PROBE_SETUP_OK') AS setup_ok, contains(output, 'PROBE_REACHED') AS reached,
  array_to_string(frames, '|') AS top_frames,
  exit_code <> 0 OR timed_out OR len({_HITS}) > 0 AS oracle_fired,
  sha256(CASE WHEN len(frames) > 0 THEN array_to_string(frames, '|')
    WHEN {_BLANKLESS} <> '' THEN substr({_BLANKLESS}, 1, 500)
    ELSE concat('silent:probe_', candidate_id) END) AS evidence_key
FROM ({_FRAMES}) f
"""
VERDICT_SQL = f"""
SELECT *, CASE WHEN NOT setup_ok THEN 'setup_failure' WHEN NOT reached THEN 'unreachable'
    WHEN oracle_fired THEN 'true_positive' ELSE 'false_positive' END AS verdict
FROM ({EVIDENCE_SQL}) e
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "run_log")


@query(f"SELECT event_id, err AS stderr, output FROM ({_NORMALIZED}) n")
def combined_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run paths replaced in the error text; both streams as one output."""
    stderr = ev.replace_path(F.col("stderr"), F.col("probe_path"), "$PROBE")
    return _log(spark, sf_dir).select(
        "event_id",
        stderr.alias("stderr"),
        ev.combined_output(F.col("stdout"), stderr).alias("output"),
    )


@query(f"SELECT event_id, array_to_string({_HITS}, '; ') AS hits FROM ({_NORMALIZED}) n")
def sanitizer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = ev.combined_output(F.col("stdout"), F.col("stderr"))
    return _log(spark, sf_dir).select(
        "event_id", F.array_join(ev.sanitizer_hits(output), "; ").alias("hits")
    )


@query(f"SELECT event_id, setup_ok, reached FROM ({EVIDENCE_SQL}) e")
def probe_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.collect_evidence(_log(spark, sf_dir)).select("event_id", "setup_ok", "reached")


@query(f"SELECT event_id, array_to_string(frames, '|') AS frames FROM ({_FRAMES}) f")
def top_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.collect_evidence(_log(spark, sf_dir))
    return found.select("event_id", F.array_join("top_frames", "|").alias("frames"))


@query(f"SELECT event_id, evidence_key FROM ({EVIDENCE_SQL}) e")
def evidence_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.collect_evidence(_log(spark, sf_dir)).select("event_id", "evidence_key")


@query(f"SELECT oracle_fired, exit_code, timed_out, count(*) AS n FROM ({EVIDENCE_SQL}) e GROUP BY ALL")
def oracle_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.collect_evidence(_log(spark, sf_dir))
    return found.groupBy("oracle_fired", "exit_code", "timed_out").agg(F.count("*").alias("n"))


@query(
    "SELECT event_id, candidate_id, exit_code, timed_out, hits, setup_ok, reached, top_frames, oracle_fired, "
    f"evidence_key FROM ({EVIDENCE_SQL}) e"
)
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of each run."""
    return ops.collect_evidence(_log(spark, sf_dir)).select(
        "event_id",
        "candidate_id",
        "exit_code",
        "timed_out",
        F.array_join("sanitizer_hits", "; ").alias("hits"),
        "setup_ok",
        "reached",
        F.array_join("top_frames", "|").alias("top_frames"),
        "oracle_fired",
        "evidence_key",
    )


_REASON_SQL = "CASE verdict " + " ".join(f"WHEN '{v}' THEN '{r}'" for v, r in ops.REASONS.items()) + " END"


@query(f"SELECT event_id, verdict, {_REASON_SQL} AS reason FROM ({VERDICT_SQL}) v")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.triage(_log(spark, sf_dir)).select("event_id", "verdict", "reason")


@query("SELECT doc_id, right(text, 4000) AS error_tail FROM documents")
def error_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 4,000 characters of each document."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", tail(F.col("text"), 4000).alias("error_tail")
    )


@query(
    "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat(text, chr(65533), 'z') END AS text FROM documents"
)
def tolerant_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document bytes with a bad byte inside, and missing ones."""
    raw = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF7A")))
    raw = F.when(F.col("doc_id") % 5 != 0, raw)
    return table(spark, sf_dir, "documents").select("doc_id", decode_utf8(raw).alias("text"))




@query(
    "SELECT conv_id, turn, text AS stripped, TRUE AS text_left, FALSE AS blank_left FROM "
    f"(SELECT conv_id, turn, regexp_replace(text, '^[{_S}]+|[{_S}]+$', '', 'g') AS text FROM conversations) c"
)
def strip_and_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts padded with unusual white space: stripped, and asked whether anything is left."""
    pad = F.when(F.col("turn") % 4 == 0, " ").when(F.col("turn") % 4 == 1, "\u2003")
    pad = pad.when(F.col("turn") % 4 == 2, "\x1c").otherwise("\xa0")
    end = F.lit("\x85\n")
    padded = F.concat(pad, F.col("text"), end)
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        strip(padded).alias("stripped"),
        not_blank(padded).alias("text_left"),
        not_blank(F.concat(pad, end)).alias("blank_left"),
    )
