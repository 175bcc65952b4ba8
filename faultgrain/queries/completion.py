"""Prompt and completion queries, answered by scripted clients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultgrain.bindings import table, view
from faultgrain.functions import weakness
from faultgrain.operators import contracts, prompts
from faultgrain.operators.complete import Client, RuleClient, ask, complete, complete_by_stage
from faultgrain.operators.corpus import plan_tasks
from faultgrain.operators.first_wins import first_per_key
from faultgrain.operators.journal import Journal, digest_of
from faultgrain.operators.triage import triage
from faultgrain.plans.explore import explore_prompts
from faultgrain.plans.overview import stored_overviews
from faultgrain.plans.probe import make_probes, rewrite_unreachable
from faultgrain.queries.corpus import TASKS_SQL, _all_files, file_index_table
from faultgrain.queries.ledger import LABEL_SQL
from faultgrain.queries.lifecycle import _RUNS
from faultgrain.queries.registry import query
from faultgrain.queries.triage import VERDICT_SQL
from faultgrain.session import materialize, scratch_path
from faultgrain.sources.ledger import Ledger

_OVERVIEW = "A tree of many parts."


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_EXPLORE_SQL = f"""
SELECT t.path AS key, concat('EXPLORE file ', t.path, ' (language: ', t.language, ').', chr(10), 'Overview of the project:', chr(10),
  '{_OVERVIEW}', chr(10), chr(10), 'Functions: ',
  CASE t.functions WHEN 'unknown' THEN 'none extracted' WHEN '' THEN ''
    ELSE concat(replace(regexp_replace(t.functions, ':([0-9]+-[0-9]+)', ' (lines \\1)', 'g'), ';', ', ')) END, '.', chr(10),
  {_sql_text(f"Report likely bugs as JSON of this shape, [] for none: {contracts.ISSUES_SHAPE}")}, chr(10), 'cwe_id is one of:', chr(10),
  {_sql_text(weakness.listing())}, chr(10), chr(10), '```', chr(10), f.content, chr(10), '```') AS prompt
FROM ({TASKS_SQL}) t JOIN (SELECT path, content FROM ($code_files) c WHERE NOT is_symlink
  UNION ALL SELECT path, content FROM ($python_files) p UNION ALL SELECT path, content FROM ($text_files) x) f ON f.path = t.path
"""


@query(f"SELECT key, sha256(prompt) AS prompt_hash, CAST(length(prompt) AS INT) AS chars FROM ({_EXPLORE_SQL}) e")
def exploration_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every task with its whole source, by hash and length."""
    tasks = plan_tasks(file_index_table(spark, sf_dir))
    asked = explore_prompts(tasks, _all_files(spark, sf_dir), F.lit(_OVERVIEW))
    return asked.select(
        "key", F.sha2("prompt", 256).alias("prompt_hash"), F.length("prompt").alias("chars")
    )


_FINDING_SQL = (
    "concat('candidate in file ', file, ', function ', function, '.', chr(10), 'Overview of the project:', chr(10), "
    f"'{_OVERVIEW}', chr(10), chr(10), 'Bug type: ', {LABEL_SQL}, '.', chr(10), 'Bug category: ', bug_category, '.', chr(10), "
    "'Description: ', description, chr(10), 'Trigger: ', trigger, chr(10))"
)
_PROBE_TEXT = (
    "Write one self-contained script that triggers the bug through a public entry point and then exits non-zero. "
    "It prints PROBE_SETUP_OK once everything it needs is loaded and PROBE_REACHED when the input enters the target. "
    "Refuse, with a reason, only when no probe is possible.\nAnswer with JSON of this shape: " + contracts.PROBE_SHAPE
)


@query(
    f"SELECT id, concat('PROBE for ', {_FINDING_SQL}, {_sql_text(_PROBE_TEXT)}, "
    "CASE WHEN reject_reason <> '' THEN concat(chr(10), chr(10), 'The last probe was turned down, correct this:', chr(10), reject_reason) "
    "ELSE '' END) AS prompt FROM ($candidates) c"
)
def probe_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe prompts of all candidates; a stored reason serves as feedback."""
    feedback = F.coalesce("reject_reason", F.lit(""))
    return view(spark, sf_dir, "candidates").select(
        "id", prompts.probe_prompt(F.lit(_OVERVIEW), feedback).alias("prompt")
    )


_AUDIT_TEXT = (
    "Without running it, check that it expects what the target promises, not what the bug does, and that its "
    "input can reach the target.\nAnswer with JSON of this shape: " + contracts.AUDIT_SHAPE + "\n\nProbe:\n```\n"
)


@query(
    "SELECT c.id, CASE WHEN f.content IS NULL THEN '' "
    f"ELSE concat('AUDIT the probe for ', {_FINDING_SQL}, {_sql_text(_AUDIT_TEXT)}, 'run(', c.id, ')', chr(10), '```', "
    "chr(10), chr(10), 'Source of ', file, ':', chr(10), '```', chr(10), f.content || chr(10), '```') END AS prompt, "
    "f.content IS NULL AS unavailable FROM ($candidates) c LEFT JOIN "
    "(SELECT concat('src/f', o_orderkey * 2, '.c') AS path, concat('int x', o_custkey, ';') AS content FROM orders) f "
    "ON f.path = c.file"
)
def audit_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit prompts with the target source; without a source there is no audit."""
    files = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("src/f"), F.col("o_orderkey") * 2, F.lit(".c")).alias("path"),
        F.concat(F.lit("int x"), F.col("o_custkey"), F.lit(";")).alias("content"),
    )
    candidates = view(spark, sf_dir, "candidates").withColumn("script", F.format_string("run(%d)", "id"))
    found = prompts.with_source(candidates, files)
    return found.select(
        "id",
        F.coalesce(prompts.audit_prompt(F.lit(_OVERVIEW)), F.lit("")).alias("prompt"),
        F.col("content").isNull().alias("unavailable"),
    )


def _overview_client() -> Client:
    class Describer(RuleClient):
        def complete(self, prompt: str) -> str:
            if "doc/src5/" in prompt:
                raise ConnectionError("no answer")
            return super().complete(prompt)

    return Describer([("doc/src7/", " \n"), ("doc/src3/", "tree three"), ("tree three", "tree three")], default="a tree")


@query(
    "SELECT source AS corpus_id, CASE WHEN n % 4 = 0 THEN concat('stored ', n) WHEN source IN ('src5', 'src7') THEN '' "
    "WHEN source = 'src3' THEN 'tree three' ELSE 'a tree' END AS overview "
    "FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) s"
)
def overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored overviews reused, blank and missing ones asked for twice at most."""
    documents = table(spark, sf_dir, "documents")
    index = documents.select(
        F.col("source").alias("corpus_id"),
        F.concat(F.lit("doc/"), "source", F.lit("/d"), "doc_id", F.lit(".c")).alias("path"),
        F.lit("c").alias("language"),
        F.lit(1).alias("line_count"),
        F.lit(None).cast("array<struct<start:int,end:int,name:string>>").alias("functions"),
    )
    sizes = documents.groupBy(F.col("source").alias("corpus_id")).agg(F.count("*").alias("n"))
    stored = F.when(F.col("n") % 4 == 0, F.concat(F.lit("stored "), "n")).otherwise(" \t")
    # No listing fits this bound whole, so each is asked for in pieces and the answers once more.
    asked = prompts.overview_prompts(prompts.corpus_listing(index, part_lines=3), 200)
    found = prompts.load_or_generate(
        sizes.select("corpus_id", stored.alias("overview")), asked, _overview_client, fail_fast=False, max_chars=200
    )
    return found.withColumn("overview", F.coalesce("overview", F.lit("")))


def _silent_client() -> Client:
    return RuleClient([])  # any call of it breaks


@query(
    "SELECT source AS corpus_id, CASE WHEN source = 'src7' THEN 'second try' WHEN source = 'src3' THEN 'tree three' ELSE 'a tree' END AS overview "
    "FROM (SELECT DISTINCT source FROM documents) s WHERE source <> 'src5'"
)
def overviews_stored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three jobs over one ledger: the second asks only about the corpora the first got no overview of, the third about one."""
    index = table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/d"), "doc_id", F.lit(".c")).alias("path"),
        F.lit("c").alias("language"), F.lit(1).alias("line_count"), F.lit(None).cast("array<struct<start:int,end:int,name:string>>").alias("functions"),
    )
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    first = lambda: RuleClient([("src7/d", " \n"), ("src5/d", " "), ("src3/d", "tree three")], default="a tree")
    second = lambda: RuleClient([("src7/d", "second try"), ("src5/d", " ")])
    for factory in (first, second, _silent_client):
        found = stored_overviews(ledger, index, factory, fail_fast=False)
    return found


def _moody_client() -> Client:
    class Moody:
        def complete(self, prompt: str) -> str:
            mood = int(prompt.split()[1])
            if mood == 50:
                raise TimeoutError("too slow")
            if mood % 3 == 0 or (mood % 3 == 1 and "could not be used: not valid JSON" in prompt):
                return "Sure: " + '{"verdict": "ok", "feedback": "%d"}' % mood
            return "hm"

    return Moody()


@query(
    """SELECT event_id AS key, CAST(CASE WHEN k = 50 OR k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 2 ELSE 3 END AS INT) AS attempts,
  k <> 50 AND k % 3 <> 2 AS ok,
  CASE WHEN k <> 50 AND k % 3 <> 2 THEN concat('{"verdict":"ok","feedback":"', k, '"}') ELSE '' END AS payload,
  CASE WHEN k = 50 THEN 'TimeoutError: too slow' ELSE '' END AS failure
FROM ($ev) e"""
)
def batch_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers asked for up to three times; errors fed back, broken calls kept apart."""
    events = view(spark, sf_dir, "ev")
    asked = events.select(F.col("event_id").alias("key"), F.concat(F.lit("mood "), "k", F.lit(" please")).alias("prompt"))
    answers = complete(asked, _moody_client, contracts.judge_audits, contracts.AUDIT_SHAPE, retries=2)
    none = F.lit("")
    return answers.select(
        "key", "attempts", "ok", F.coalesce("payload", none).alias("payload"), F.coalesce("failure", none).alias("failure")
    )


@query(
    """SELECT event_type AS stage, count(*) AS n, count(*) FILTER (WHERE event_type = 'view' OR event_type = 'click' AND k % 2 = 0) AS valid,
  CAST(max(CASE WHEN event_type NOT IN ('view', 'click') THEN 0 WHEN event_type = 'click' AND k % 2 = 1 THEN 2 ELSE 1 END) AS INT) AS attempts,
  max(CASE WHEN event_type IN ('view', 'click') THEN '' ELSE concat('no client for stage ', event_type) END) AS failure
FROM ($ev) e GROUP BY event_type"""
)
def stage_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages with a client and a contract each; the other event types have none."""
    events = view(spark, sf_dir, "ev").select(
        F.col("event_id").alias("key"), F.col("event_type").alias("stage"), F.concat(F.lit("number "), F.col("k") % 2).alias("prompt")
    )
    answers = complete_by_stage(
        events,
        {
            "view": lambda: RuleClient([], default="[]"),
            "click": lambda: RuleClient([("number 0", '{"verdict":"ok","feedback":""}')], default="[]"),
        },
        {"view": contracts.judge_issues, "click": contracts.judge_audits},
        {"view": contracts.ISSUES_SHAPE, "click": contracts.AUDIT_SHAPE},
        retries=1,
    )
    return answers.groupBy("stage").agg(
        F.count("*").alias("n"),
        F.count_if("ok").alias("valid"),
        F.max("attempts").alias("attempts"),
        F.max(F.coalesce("failure", F.lit(""))).alias("failure"),
    )


def _author() -> Client:
    """Writes and judges probes by the number in the target's file name."""

    class Author:
        def complete(self, prompt: str) -> str:
            number = int(prompt.split("candidate in file src/f")[1].split(".")[0])
            kind = number % 7
            if prompt.startswith("PROBE"):
                if kind == 0:
                    return '{"refuse":true,"reason":"no way in"}'
                if kind == 1:
                    return "hm"
                version = 2 if "turned down" in prompt else 1
                return '{"interpreter":["sh"],"script":"PROBE_SETUP_OK PROBE_REACHED v%d"}' % version
            if kind == 2 or (kind == 3 and "v1" in prompt):
                return '{"verdict":"invalid","feedback":"expects the bug"}'
            return "?" if kind == 4 else '{"verdict":"ok","feedback":""}'

    return Author()


@query(
    """WITH known AS (SELECT c.id, CAST(regexp_extract(c.file, '[0-9]+', 0) AS INT) % 7 AS kind, f.path IS NOT NULL AS held
  FROM ($candidates) c LEFT JOIN (SELECT DISTINCT concat('src/f', o_orderkey * 2, '.c') AS path FROM orders) f ON f.path = c.file)
SELECT id AS candidate_id,
  CASE WHEN kind = 0 THEN 'refused' WHEN kind = 1 THEN 'generate_failed' WHEN NOT held OR kind = 4 THEN 'audit_unavailable'
       WHEN kind = 2 THEN 'audit_invalid,audit_invalid,audit_invalid' WHEN kind = 3 THEN 'audit_invalid,audit_ok'
       ELSE 'audit_ok' END AS steps,
  CASE WHEN kind IN (0, 1, 2, 4) OR NOT held THEN '' WHEN kind = 3 THEN 'PROBE_SETUP_OK PROBE_REACHED v2'
       ELSE 'PROBE_SETUP_OK PROBE_REACHED v1' END AS script
FROM known"""
)
def probe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates to audited probes: what happened to each, and the script that may run."""
    files = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("src/f"), F.col("o_orderkey") * 2, F.lit(".c")).alias("path"),
        F.concat(F.lit("int x"), F.col("o_custkey"), F.lit(";")).alias("content"),
    )
    probes, steps = make_probes(view(spark, sf_dir, "candidates"), files, _author, _OVERVIEW)
    ordered = F.sort_array(F.collect_list(F.struct("step", "kind")))  # a run has a handful of steps
    shown = steps.groupBy("candidate_id").agg(F.array_join(F.transform(ordered, lambda s: s.kind), ",").alias("steps"))
    found = shown.join(probes.select("candidate_id", "script"), "candidate_id", "left")
    return found.select("candidate_id", "steps", F.coalesce("script", F.lit("")).alias("script"))


class _Counting:
    """Repeats the last word of a prompt; breaks on every fifth candidate while it is ``broken``."""

    def __init__(self, broken: bool) -> None:
        self._broken = broken

    def complete(self, prompt: str) -> str:
        number = prompt.split()[-1]
        if self._broken and int(number) % 5 == 0:
            raise ConnectionError("gone")
        return number


@query(
    "SELECT id, CAST(id AS VARCHAR) AS text, CAST(1 AS BIGINT) AS answers, CASE WHEN id % 5 = 0 THEN 'second' ELSE 'either' END AS asked "
    "FROM ($candidates) c"
)
def resumed_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job that a broken call aborts, and the one after it: what the first had answered is not asked again."""
    asked = view(spark, sf_dir, "candidates").select(F.col("id").alias("key"), F.concat(F.lit("candidate "), "id").alias("prompt"))
    journal = Journal(spark, scratch_path(spark, "journal"), batch_bytes=1 << 14)
    try:
        journal.ask(asked, lambda part: ask(part, lambda: _Counting(True)), "demo", fail_fast=True)
    except RuntimeError:
        pass  # the abort is what this query is about
    first = journal.entries().filter("failure IS NULL").select(F.col("job").alias("job1")).distinct()
    answers = journal.ask(asked, lambda part: ask(part, lambda: _Counting(False)), "demo")
    stored = journal.entries().filter("failure IS NULL").join(F.broadcast(first), F.col("job") == F.col("job1"), "left")
    stored = stored.groupBy("digest").agg(F.count("*").alias("answers"), F.bool_or(F.col("job1").isNotNull()).alias("early"))
    named = asked.select(F.col("key").alias("id"), digest_of("demo", F.col("prompt")).alias("digest"))
    joined = named.join(answers.select(F.col("key").alias("id"), "text"), "id").join(stored, "digest")
    late = F.when(F.col("text").cast("int") % 5 == 0, F.when(F.col("early"), "first").otherwise("second")).otherwise("either")
    return joined.select("id", "text", "answers", late.alias("asked"))


def _second_author() -> Client:
    class Author:
        def complete(self, prompt: str) -> str:
            number = int(prompt.split("candidate in file src/f")[1].split(".")[0])
            if number % 5 == 0:
                return '{"refuse":true,"reason":"no way in"}'
            seen = "target" if "never reached" in prompt and "bad option" in prompt else "nothing"
            return '{"interpreter":["sh"],"script":"PROBE_SETUP_OK PROBE_REACHED after %s"}' % seen

    return Author()


@query(
    "SELECT l.candidate_id, l.run_id, CAST(l.step + 1 AS INT) AS step, CASE WHEN l.candidate_id % 5 = 0 THEN 'refused' ELSE 'probe' END AS kind, "
    "CASE WHEN l.candidate_id % 5 = 0 THEN 'no way in' ELSE 'PROBE_SETUP_OK PROBE_REACHED after target' END AS text "
    "FROM (SELECT a.candidate_id, a.run_id, max(a.step) AS step, arg_max(CASE WHEN a.kind = 'exec' THEN v.verdict ELSE a.kind END, a.step) AS event "
    f"FROM ($attempts) a JOIN ({VERDICT_SQL}) v ON a.event_id = v.event_id GROUP BY a.candidate_id, a.run_id) l "
    f"JOIN ({_RUNS.replace('@n', '3')}) r ON r.candidate_id = l.candidate_id AND r.run_id = l.run_id WHERE l.event = 'unreachable' AND r.end_step = -1"
)
def unreachable_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose last probe missed the target get a new one, told how the run ended, as long as the budget lasts."""
    attempts = materialize(triage(view(spark, sf_dir, "attempts")), "attempts")
    found = first_per_key(view(spark, sf_dir, "ev"), ["user_id"], ["event_id"])
    candidates = found.select(
        F.col("user_id").alias("id"), F.concat(F.lit("src/f"), "user_id", F.lit(".c")).alias("file"), F.lit("main").alias("function"),
        F.lit(20).alias("cwe_id"), F.lit("seen").alias("bug_category"), F.lit("seen").alias("description"), F.lit("any").alias("trigger"),
    )
    probes, none = rewrite_unreachable(candidates, attempts, _second_author)
    shown = probes.select("candidate_id", "run_id", F.col("step").cast("int").alias("step"), F.lit("probe").alias("kind"), F.col("script").alias("text"))
    return shown.unionByName(none.select("candidate_id", "run_id", F.col("step").cast("int").alias("step"), "kind", F.col("detail").alias("text")))
