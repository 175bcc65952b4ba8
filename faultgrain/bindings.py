"""The engine's input tables as views over the star-schema and text tables.

Each view is one SQL text that Spark and any ANSI engine read alike: ``$name`` stands for
a base table or another view. Every view keeps all rows of its base table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_EVENTS = """
SELECT event_id, user_id, event_type, CAST(day(ts) AS INT) AS run_id, ts,
       CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k
FROM $events
"""

# Run logs: errors print a traceback, a compiler-style report or bare text; purchases time
# out or die silently; signups stop before the target, views before the setup marker.
_RUN_LOG = """
SELECT event_id, user_id AS candidate_id, run_id, CAST(event_id AS INT) AS step, event_type, k,
  CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 3
       WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN -1 ELSE 139 END ELSE 0 END AS INT) AS exit_code,
  (event_type = 'purchase' AND k % 2 = 0) AS timed_out,
  CASE event_type WHEN 'view' THEN concat('starting', chr(10))
       WHEN 'signup' THEN concat('PROBE_SETUP_OK', chr(10), 'skipping target', chr(10))
       ELSE concat('PROBE_SETUP_OK', chr(10), 'PROBE_REACHED', chr(10)) END AS stdout,
  CASE WHEN event_type = 'error' AND k % 5 < 3 THEN concat(
         'Traceback (most recent call last):', chr(10),
         '  File "/tmp/w', event_id, '/probe_', user_id, '", line ', k + 1, ', in <module>', chr(10),
         '    main()', chr(10),
         '  File "/tmp/w', event_id, '/target/mod', user_id % 40, '.py", line ', k + 7, ', in run', chr(10),
         '  File "/tmp/w', event_id, '/target/lib', k, '.py", line 4, in inner', chr(10),
         '  File "/usr/lib/json.py", line 9, in loads', chr(10),
         'ValueError: bad value ', event_id, chr(10))
       WHEN event_type = 'error' AND k % 5 = 3 THEN concat(
         '/tmp/w', event_id, '/target/src', user_id % 40, '.c:', k, ':7: runtime error: signed integer overflow',
         chr(10), 'SUMMARY: UndefinedBehaviorSanitizer: undefined-behavior', chr(10))
       WHEN event_type = 'error' THEN concat('  worker lost in /tmp/w', event_id, ' after step ', k, chr(10), '  ')
       WHEN event_type = 'signup' THEN concat('bad option', chr(10)) ELSE '' END AS stderr,
  concat('/tmp/w', event_id) AS workdir,
  concat('/tmp/w', event_id, '/probe_', user_id) AS probe_path
FROM ($ev) e
"""

# Attempt histories: one candidate per user, one run per day, steps in event order.
_ATTEMPTS = """
SELECT r.*,
  CASE WHEN event_type = 'view' AND k % 4 = 0 THEN 'audit_ok'
       WHEN event_type = 'view' AND k % 4 = 1 THEN 'audit_invalid'
       WHEN event_type = 'click' AND k % 10 < 5 THEN 'audit_invalid'
       WHEN event_type = 'click' AND k % 10 = 5 THEN 'refused'
       WHEN event_type = 'click' AND k % 10 = 6 THEN 'generate_failed'
       WHEN event_type = 'click' AND k % 10 = 7 THEN 'audit_unavailable'
       WHEN event_type = 'click' AND k % 10 = 8 THEN 'error'
       ELSE 'exec' END AS kind,
  concat('note ', k) AS detail
FROM ($run_log) r
"""

# Findings in arrival order, some outside the vocabulary, some breaking a constraint.
_FINDINGS = """
SELECT event_id AS pos, concat('src/f', user_id % 60, '.c') AS file, concat('fn', k % 15) AS function,
  CAST(CASE k % 6 WHEN 0 THEN 787 WHEN 1 THEN 79 WHEN 2 THEN 369 WHEN 3 THEN 20
       WHEN 4 THEN 9999 ELSE 12 END AS INT) AS cwe_id,
  event_type AS bug_category, concat('seen at step ', event_id) AS description,
  CASE WHEN k = 97 THEN NULL ELSE concat('input ', k) END AS trigger,
  CASE WHEN k = 98 THEN 'unsure' ELSE 'pending' END AS status
FROM ($ev) e
"""

# The candidate table those findings leave behind: the first finding per key.
_CANDIDATES = """
SELECT CAST(pos + 1 AS BIGINT) AS id, file, function, cwe_id, bug_category,
  description, trigger,
  CASE pos % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN 'inconclusive' WHEN 2 THEN 'confirmed'
       WHEN 3 THEN 'duplicate' ELSE 'pending' END AS status,
  CASE pos % 7 WHEN 0 THEN CASE WHEN pos % 2 = 0 THEN concat('note ', pos) END
       WHEN 1 THEN 'no evidence' END AS reject_reason,
  CAST(CASE pos % 7 WHEN 1 THEN 3 ELSE pos % 3 END AS INT) AS verify_attempts
FROM (SELECT *, row_number() OVER (PARTITION BY file, function, cwe_id ORDER BY pos) AS seen
      FROM ($findings) f WHERE trigger IS NOT NULL AND status = 'pending') g
WHERE seen = 1
"""

# Answers of a model: well-formed, malformed and ill-typed ones. The class is a function
# of event_type and k, so the right judgement is known for each row.
_ANSWERS = """
SELECT event_id, user_id, run_id, k, event_type, concat('src/f', user_id % 60, '.c') AS file,
  CASE event_type
    WHEN 'view' THEN CASE WHEN k % 4 = 0 THEN '[]' WHEN k % 4 = 1 THEN 'nothing wrong here'
                          WHEN k % 4 = 2 THEN concat('[', item, ',', item, ']') ELSE concat('{"issues":[', item, ']}') END
    WHEN 'click' THEN concat('[', item, ']')
    WHEN 'error' THEN concat('Here it is:', chr(10), '```json', chr(10), '[', item, ']', chr(10), '```', chr(10), 'done {')
    WHEN 'signup' THEN CASE k % 5 WHEN 0 THEN concat('[', item, '] and [', item, ']')
                          WHEN 1 THEN concat('[', item) WHEN 2 THEN '"a {b} string"'
                          WHEN 3 THEN 'null' ELSE concat('   [', item, ']', chr(10)) END
    ELSE CASE k % 7 WHEN 0 THEN replace(concat('[', item, ']'), '"cwe_id":79', '"cwe_id":79.0')
                    WHEN 1 THEN replace(concat('[', item, ']'), '"cwe_id":79', '"cwe_id":true')
                    WHEN 2 THEN replace(concat('[', item, ']'), '"cwe_id":79', '"cwe_id":9999')
                    WHEN 3 THEN replace(concat('[', item, ']'), '"trigger"', '"trig"')
                    WHEN 4 THEN replace(concat('[', item, ']'), '}', ',"extra":1}')
                    WHEN 5 THEN replace(concat('[', item, ']'), '"seen"', '"  "')
                    ELSE replace(concat('[', item, ']'), '"cwe_id":79', '"cwe_id":"79"') END
  END AS text
FROM (SELECT *, concat('{"function":"fn', k % 15, '","cwe_id":79,"bug_category":"', event_type,
                       '","description":"seen","trigger":"input ', k, '"}') AS item
      FROM ($ev) e) a
"""

_PROBE_ANSWERS = """
SELECT event_id, user_id AS candidate_id, run_id, k, event_type,
  CASE event_type
    WHEN 'view' THEN concat('{"refuse":true,"reason":"no entry point ', k, '"}')
    WHEN 'click' THEN concat('{"interpreter":["python3","-u"],"script":"print(''PROBE_SETUP_OK''); print(''PROBE_REACHED''); run(', k, ')"}')
    WHEN 'error' THEN CASE k % 3 WHEN 0 THEN '{"interpreter":[],"script":"PROBE_SETUP_OK PROBE_REACHED"}'
                        WHEN 1 THEN '{"interpreter":["sh",""],"script":"PROBE_SETUP_OK PROBE_REACHED"}'
                        ELSE '{"interpreter":"sh","script":"PROBE_SETUP_OK PROBE_REACHED"}' END
    WHEN 'signup' THEN CASE k % 3 WHEN 0 THEN '{"refuse":false,"reason":"x"}' WHEN 1 THEN '{"refuse":true,"reason":" "}'
                        ELSE '{"refuse":1,"reason":"x"}' END
    ELSE CASE k % 3 WHEN 0 THEN '{"interpreter":["sh"],"script":"PROBE_SETUP_OK"}' WHEN 1 THEN '["sh"]'
                        ELSE '{"interpreter":["sh"],"script":"PROBE_SETUP_OK PROBE_REACHED","path":"x"}' END
  END AS text
FROM ($ev) e
"""

_AUDIT_ANSWERS = """
SELECT event_id, user_id AS candidate_id, k, event_type,
  CASE event_type
    WHEN 'view' THEN '{"verdict":"ok","feedback":""}'
    WHEN 'click' THEN concat('{"verdict":"invalid","feedback":"expects the bug ', k, '"}')
    WHEN 'error' THEN '{"verdict":"invalid","feedback":" "}'
    WHEN 'signup' THEN CASE k % 2 WHEN 0 THEN '{"verdict":"maybe","feedback":"x"}' ELSE '{"verdict":"ok","feedback":null}' END
    ELSE CASE k % 2 WHEN 0 THEN '{"verdict":"ok"}' ELSE '{"feedback":"x","verdict":"ok"}' END
  END AS text
FROM ($ev) e
"""

# Service calls: one request per user and day; the state of each try by event type.
_CALLS = """
SELECT user_id * 100 + run_id AS request_id, CAST(event_id AS INT) AS seq,
  CASE event_type WHEN 'view' THEN '429' WHEN 'click' THEN '503' WHEN 'error' THEN 'timeout'
       WHEN 'signup' THEN CASE WHEN k % 3 = 0 THEN '400' ELSE 'connection' END
       ELSE CASE WHEN k % 3 = 0 THEN 'ok' ELSE '429' END END AS status
FROM ($ev) e
"""

# A table of source lines: files by user, numbered by event, so one file can be any size.
_CODE_LINES = """
SELECT concat('src/u', user_id % 60, CASE user_id % 5 WHEN 0 THEN '.go' WHEN 1 THEN '.rs' ELSE '.c' END) AS path,
  CASE user_id % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'rust' ELSE 'c' END AS language,
  CAST(event_id + 1 AS INT) AS n,
  CASE event_type
    WHEN 'view' THEN CASE WHEN user_id % 5 = 0 THEN concat('func (t *T) f', k, '(a int) {')
                          WHEN user_id % 5 = 1 THEN concat('  pub fn f', k, '(a: i32) {')
                          ELSE concat('int f', k, '(int a) {') END
    WHEN 'click' THEN '}'
    WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN '} }' ELSE concat('  if (x) { return g', k, ' (a); }') END
    WHEN 'signup' THEN CASE WHEN k % 3 = 0 THEN 'while (x) {{' ELSE concat('static int d', k, '(void);') END
    ELSE CASE WHEN k % 3 = 0 THEN '}} else {' ELSE 'x = y;' END END AS line
FROM ($ev) e
"""

# Source files: one per order, directory and suffix by its number, twelve lines picked by
# remainders of its numbers, line ends of three kinds.
_LINE_COUNT = 12
_LINE = """CASE (o_orderkey * {a} + o_custkey * {b}) % 9
  WHEN 0 THEN CASE o_orderkey % 10 WHEN 7 THEN concat('func (t *T) f{i}x', o_custkey, '(a int) {{')
                                   WHEN 8 THEN concat('  pub fn f{i}x', o_custkey, '(a: i32) {{')
                                   ELSE concat('int f{i}x', o_custkey, '(int a) {{') END
  WHEN 1 THEN '}}' WHEN 2 THEN '}}}} {{' WHEN 3 THEN concat('  return g', o_custkey, ' (a);')
  WHEN 4 THEN 'while (x) {{' WHEN 5 THEN '' WHEN 6 THEN '}}' WHEN 7 THEN concat('fn h{i}(x) {{ }}')
  ELSE 'x = y;' END"""
_CODE_FILES = """
SELECT concat(
    CASE o_orderkey % 12 WHEN 0 THEN '.git/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'pkg/node_modules/'
         WHEN 3 THEN 'lib/.cache/' WHEN 4 THEN 'Lib/Fixtures/' WHEN 5 THEN 'lib-x/' WHEN 6 THEN 'lib/sub/'
         WHEN 7 THEN '' ELSE 'lib/' END,
    CASE o_orderkey % 7 WHEN 0 THEN 'test_' WHEN 1 THEN '.' ELSE 'f' END, o_orderkey,
    CASE o_orderkey % 11 WHEN 0 THEN '_test' WHEN 1 THEN '.spec' WHEN 2 THEN 'Test' ELSE '' END,
    CASE o_orderkey % 10 WHEN 0 THEN '.c' WHEN 1 THEN '.H' WHEN 2 THEN '.java' WHEN 3 THEN '.ts'
         WHEN 4 THEN '.txt' WHEN 5 THEN '.cpp' WHEN 6 THEN '' WHEN 7 THEN '.go' WHEN 8 THEN '.rs' ELSE '.js' END) AS path,
  CASE WHEN o_orderkey % 50 = 9 THEN '' ELSE concat(%s,
    CASE o_orderkey % 4 WHEN 0 THEN '' ELSE chr(10) END) END AS content,
  o_orderkey % 97 = 0 AS is_symlink
FROM $orders
""".replace(
    "%s",
    ", CASE o_custkey % 3 WHEN 0 THEN chr(10) WHEN 1 THEN concat(chr(13), chr(10)) ELSE chr(12) END, ".join(
        _LINE.format(i=i, a=2 * i + 1, b=i * i + 3) for i in range(1, _LINE_COUNT + 1)
    ),
)

# Python sources: one file per order, shape by its number.
_PYTHON_FILES = """
SELECT concat('py/m', o_orderkey, '.py') AS path,
  CASE o_orderkey % 5
    WHEN 0 THEN concat('def f', o_custkey, '(x):', chr(10), '    return x', chr(10))
    WHEN 1 THEN concat('import os', chr(10), chr(10), '@cache', chr(10), 'async def g', o_custkey, '():', chr(10),
                       '    def inner():', chr(10), '        pass', chr(10), '    return inner', chr(10))
    WHEN 2 THEN concat('def broken', o_custkey, '(:', chr(10))
    WHEN 3 THEN concat('x = ', o_custkey, chr(10))
    ELSE concat('class C:', chr(10), '    def a(self): pass', chr(10), '    def b(self):', chr(10), '        return ', o_custkey)
  END AS content
FROM $orders
"""

# Whole texts as files: page sources and documents.
_TEXT_FILES = """
SELECT concat(CASE page_id % 6 WHEN 0 THEN 'web/tests/' WHEN 1 THEN 'web/.cache/' ELSE 'web/' END, 'p', page_id,
  CASE page_id % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.html' ELSE '.tsx' END) AS path, html AS content
FROM $pages
UNION ALL
SELECT concat('doc/', source, '/d', doc_id, CASE lang WHEN 'en' THEN '.c' WHEN 'fr' THEN '.go' WHEN 'de' THEN '.rs' ELSE '.md' END),
  text
FROM $documents
"""

VIEWS = {
    "ev": _EVENTS,
    "run_log": _RUN_LOG,
    "attempts": _ATTEMPTS,
    "findings": _FINDINGS,
    "candidates": _CANDIDATES,
    "answers": _ANSWERS,
    "probe_answers": _PROBE_ANSWERS,
    "audit_answers": _AUDIT_ANSWERS,
    "calls": _CALLS,
    "code_lines": _CODE_LINES,
    "code_files": _CODE_FILES,
    "python_files": _PYTHON_FILES,
    "text_files": _TEXT_FILES,
}
BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def sql_of(text: str, tables: dict[str, str] | None = None) -> str:
    """Expand ``$view`` and ``$table`` in ``text``; base tables may be renamed."""
    names = tables or {}

    def expand(match: re.Match[str]) -> str:
        name = match.group(1)
        return sql_of(VIEWS[name], names).strip() if name in VIEWS else names.get(name, name)

    return re.sub(r"\$(\w+)", expand, text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a table whose files give the scan fewer tasks than there are cores.

    A large table has more splits than that and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _over(spark: SparkSession, name: str, read: Callable[[str], DataFrame]) -> DataFrame:
    used = {t for t in BASE_TABLES if re.search(rf"\b__{t}\b", sql_of(VIEWS[name], {t: f"__{t}"}))}
    for base in used:
        read(base).createOrReplaceTempView(f"faultgrain_{base}")
    return spark.sql(sql_of(VIEWS[name], {base: f"faultgrain_{base}" for base in used}))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view ``name`` over the tables in ``sf_dir``."""
    return _over(spark, name, lambda base: spread(table(spark, sf_dir, base)))


def stream_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The row-wise view ``name`` over its base tables read as streams."""

    def read(base: str) -> DataFrame:
        layout = table(spark, sf_dir, base).schema
        # A glob: a plain path has to be a folder for a stream.
        return spark.readStream.schema(layout).parquet(f"{sf_dir}/{base}.parquet*")

    return _over(spark, name, read)
