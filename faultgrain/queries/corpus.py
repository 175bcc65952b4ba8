"""Corpus queries: paths, lines, spans, index, tasks, trees, snapshots."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultgrain.bindings import table, view
from faultgrain.functions import paths
from faultgrain.functions.text import line_count
from faultgrain.operators import changes, contracts, corpus as ops, prompts, spans
from faultgrain.operators.first_wins import mark_explored
from faultgrain.operators.ids import assign_ids
from faultgrain.queries.registry import query
from faultgrain.queries.triage import _S, _W
from faultgrain.session import materialize, scratch_path
from faultgrain.sources import snapshot, tree, tree_source

_PARENTS = "list_slice(string_split({p}, '/'), 1, -2)"
_SKIPPED = (
    f"len(list_filter({_PARENTS}, lambda d: starts_with(d, '.') OR d IN ('__pycache__', 'node_modules', 'venv'))) > 0"
).replace("{p}", "path")
_NAME = "list_extract(string_split(path, '/'), -1)"
_LANGUAGE = f"""CASE lower(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1))
  WHEN '.py' THEN 'python' WHEN '.c' THEN 'c' WHEN '.h' THEN 'c' WHEN '.cpp' THEN 'cpp' WHEN '.cc' THEN 'cpp'
  WHEN '.cxx' THEN 'cpp' WHEN '.hpp' THEN 'cpp' WHEN '.go' THEN 'go' WHEN '.java' THEN 'java' WHEN '.rs' THEN 'rust'
  WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' END"""
_IN_TEST_DIR = (
    f"len(list_filter({_PARENTS}, lambda d: lower(d) IN ('test', 'tests', '__tests__', 'testing', 'test_helpers', "
    "'testdata', 'testutils', 'fixtures', 'mocks'))) > 0"
).replace("{p}", "path")
_TEST_NAME = " OR ".join(
    f"regexp_matches({_NAME}, '{pattern}')"
    for pattern in (
        r"^test_.*\.py$", r"^.*_test\.py$", r"^conftest\.py$", r"^.*_test\.go$",
        r"^.*_test\.(cpp|cc|cxx|c|h|hpp)$", r"^test_.*\.(cpp|cc|cxx|c|h|hpp)$",
        r"^.*Test(s|Case)?\.java$", r"^.*\.(test|spec)\.(js|jsx|ts|tsx)$", r"^.*_test\.rs$",
    )
)
_IS_TEST = f"({_IN_TEST_DIR} OR {_TEST_NAME})"


@query(f"SELECT path, {_SKIPPED} AS skipped FROM ($code_files) f")
def skipped_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "code_files")
    return files.select("path", paths.in_skipped_dir(F.col("path")).alias("skipped"))


@query(f"SELECT path, coalesce({_LANGUAGE}, '') AS language FROM ($code_files) f")
def file_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.coalesce(paths.language(F.col("path")), F.lit(""))
    return view(spark, sf_dir, "code_files").select("path", language.alias("language"))


@query(f"SELECT path, {_IS_TEST} AS is_test FROM ($code_files) f")
def test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_test = paths.is_test_file(F.col("path"))
    return view(spark, sf_dir, "code_files").select("path", is_test.alias("is_test"))


@query(
    "SELECT path, starts_with(path, 'lib/') AS lib, starts_with(path, 'lib/') AS lib_slash, "
    "starts_with(path, 'lib/sub/') AS lib_sub, starts_with(path, 'li/') AS li, FALSE AS root_slash, TRUE AS dot "
    "FROM ($code_files) f"
)
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files each of six scopes covers."""
    scopes = {"lib": "lib", "lib_slash": "lib/", "lib_sub": "lib/sub", "li": "li", "root_slash": "/", "dot": "."}
    path = F.col("path")
    columns = [paths.in_scope(path, scope).alias(name) for name, scope in scopes.items()]
    return view(spark, sf_dir, "code_files").select("path", *columns)


_ENDS = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_SPLIT = f"""
SELECT path, language, CASE WHEN list_extract(parts, -1) = '' THEN list_slice(parts, 1, len(parts) - 1) ELSE parts END AS lines
FROM (SELECT path, {_LANGUAGE} AS language, regexp_split_to_array(content, '{_ENDS}') AS parts FROM @files) s
"""
_ALL_FILES = """
(SELECT path, content FROM ($code_files) c WHERE NOT is_symlink UNION ALL SELECT path, content FROM ($python_files) p
 UNION ALL SELECT path, content FROM ($text_files) t)
"""


def _all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "code_files")
    for name in ("python_files", "text_files"):
        files = files.unionByName(view(spark, sf_dir, name).withColumn("is_symlink", F.lit(False)))
    return files


@query(f"SELECT path, len(lines) AS line_count FROM ({_SPLIT.replace('@files', _ALL_FILES)}) l".replace("len(lines)", "CAST(len(lines) AS INT)"))
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every source file, page and document."""
    files = _all_files(spark, sf_dir).filter("NOT is_symlink")
    return files.select("path", line_count(F.col("content")).alias("line_count"))


_TYPE = rf"[{_W}:<>,\*&\[\]]+"
_C = rf"^[{_S}]*(?:{_TYPE}[{_S}]+)+([{_W}]+)[{_S}]*\([^;{{}}]*\)[{_S}]*\{{?"
_GO = rf"^func[{_S}]+(?:\([{_S}]*[{_W}]+[{_S}]+[{_W}\*]+[{_S}]*\)[{_S}]+)?([{_W}]+)[{_S}]*\("
_RUST = rf"^[{_S}]*(?:pub[{_S}]+)?fn[{_S}]+([{_W}]+)"
_SIGNATURE = (
    f"nullif(CASE language WHEN 'go' THEN regexp_extract(line, '{_GO}', 1) "
    f"WHEN 'rust' THEN regexp_extract(line, '{_RUST}', 1) WHEN 'python' THEN '' "
    f"ELSE regexp_extract(line, '{_C}', 1) END, '')"
)
_FILE_LINES = f"""
SELECT path, language, lines[n] AS line, CAST(n AS INT) AS n
FROM (SELECT path, language, lines, unnest(range(1, len(lines) + 1)) AS n
      FROM ({_SPLIT}) s WHERE language IS NOT NULL) u
"""
_CODE_FILES = "(SELECT path, content FROM ($code_files) c WHERE NOT is_symlink)"


@query(
    f"SELECT path, n, name FROM (SELECT path, n, {_SIGNATURE} AS name "
    f"FROM ({_FILE_LINES.replace('@files', _ALL_FILES)}) l) s WHERE name IS NOT NULL"
)
def signature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that look like a function signature, over all files of a known language."""
    files = _all_files(spark, sf_dir).filter("NOT is_symlink").withColumn("language", paths.language(F.col("path")))
    lines = spans.explode_lines(files.filter("language IS NOT NULL").select("path", "language", "content"))
    found = lines.select("path", "n", spans.signature_name(F.col("line"), F.col("language")).alias("name"))
    return found.filter("name IS NOT NULL")


_SPANS = f"""
SELECT s.path, s.name, s.n AS start, coalesce(min(e.n), min(s.last)) AS "end" FROM @depths s
LEFT JOIN @depths e ON e.path = s.path AND e.n >= s.opening AND e.depth <= s.depth - s.net
WHERE s.name IS NOT NULL GROUP BY s.path, s.name, s.n
"""
_DEPTHS = f"""(SELECT path, n, net, name, sum(net) OVER (PARTITION BY path ORDER BY n) AS depth, max(n) OVER (PARTITION BY path) AS last,
  min(CASE WHEN contains(line, '{{') THEN n END) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opening
FROM (SELECT path, n, line, {_SIGNATURE} AS name, length(line) - length(replace(line, '{{', ''))
        - (length(line) - length(replace(line, '}}', ''))) AS net FROM @lines) l)"""


def _spans_sql(lines: str) -> str:
    return _SPANS.replace("@depths", _DEPTHS.replace("@lines", lines))


@query(_spans_sql("($code_lines)"))
def brace_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in a table of lines where one file may hold any share of the lines."""
    lines = spans.with_last_line(view(spark, sf_dir, "code_lines"))
    return spans.brace_spans(spans.brace_lines(lines))


_FILE_SPANS = _spans_sql(f"({_FILE_LINES.replace('@files', _ALL_FILES)})")
_PYTHON_SPANS = """
SELECT concat('py/m', o_orderkey, '.py') AS path, CASE o_orderkey % 5
  WHEN 0 THEN concat('f', o_custkey, ':1-2') WHEN 1 THEN concat('g', o_custkey, ':4-7;inner:5-6') WHEN 2 THEN 'unknown'
  WHEN 3 THEN '' ELSE 'a:2-2;b:3-4' END AS functions FROM orders
"""


def _shown(functions: Column) -> Column:
    """``name:start-end`` joined by ``;``, ``unknown`` for NULL."""
    spans_text = F.transform(
        functions, lambda s: F.concat(s["name"], F.lit(":"), s["start"], F.lit("-"), s["end"])
    )
    return F.coalesce(F.array_join(spans_text, ";"), F.lit("unknown"))


@query(_PYTHON_SPANS)
def python_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every def of every Python file; ``unknown`` where the file does not parse."""
    found = spans.python_functions(F.col("content"))
    return view(spark, sf_dir, "python_files").select("path", _shown(found).alias("functions"))


INDEX_SQL = f"""
SELECT f.path, f.language, CAST(len(f.lines) AS INT) AS line_count,
  CASE WHEN f.language = 'python' THEN p.functions ELSE coalesce(s.functions, '') END AS functions
FROM ({_SPLIT.replace('@files', _ALL_FILES)}) f
LEFT JOIN (SELECT path, string_agg(concat(name, ':', start, '-', "end"), ';' ORDER BY start) AS functions
           FROM ({_FILE_SPANS}) x GROUP BY path) s ON s.path = f.path
LEFT JOIN ({_PYTHON_SPANS}) p ON p.path = f.path
WHERE f.language IS NOT NULL AND NOT {_SKIPPED.replace('path', 'f.path')}
"""


def file_index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.build_index(_all_files(spark, sf_dir))


@query(INDEX_SQL)
def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The function index of all source files: language, lines and spans."""
    index = file_index_table(spark, sf_dir)
    return index.select("path", "language", "line_count", _shown(F.col("functions")).alias("functions"))


@query(f"SELECT path, CAST(row_number() OVER (ORDER BY string_split(path, '/')) AS BIGINT) AS place FROM ({INDEX_SQL}) i")
def index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each indexed file when sorted by path components."""
    ordered = ops.source_files(_all_files(spark, sf_dir)).select("path", paths.parts(F.col("path")).alias("parts"))
    return assign_ids(ordered, ["parts"], column="place").drop("parts")


TASKS_SQL = f"SELECT path, language, functions FROM ({INDEX_SQL}) i WHERE NOT {_IS_TEST}"


@query(TASKS_SQL)
def exploration_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = ops.plan_tasks(file_index_table(spark, sf_dir))
    return tasks.select("path", "language", _shown(F.col("functions")).alias("functions"))


@query(
    "SELECT path, starts_with(path, 'lib/') AS in_first_run FROM "
    f"(SELECT path FROM ({_SPLIT.replace('@files', _CODE_FILES)}) f WHERE language IS NOT NULL AND NOT {_SKIPPED} AND NOT {_IS_TEST}) t"
)
def scoped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run below ``lib`` and then one without scope: the second takes exactly the rest."""
    sources = ops.source_files(view(spark, sf_dir, "code_files"))
    index = sources.select("path", "language", F.lit(None).alias("functions"))
    first = ops.plan_tasks(index, "lib")
    explored = first.select(F.col("path").alias("file"))
    rest = ops.pending_tasks(ops.plan_tasks(index), explored)
    return first.select("path", F.lit(True).alias("in_first_run")).unionByName(
        rest.select("path", F.lit(False).alias("in_first_run"))
    )


@query(
    "SELECT concat('d', doc_id) AS path, doc_id IN (SELECT doc_id FROM labels) AS skipped FROM documents"
)
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tasks and labelled ones as explored: what is left and what is skipped."""
    tasks = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"))
    explored = table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), "doc_id").alias("file"))
    return ops.pending_tasks(tasks, explored).withColumn("skipped", F.lit(False)).unionByName(
        ops.skipped_tasks(tasks, explored).withColumn("skipped", F.lit(True))
    )


@query(
    "SELECT DISTINCT file FROM ($answers) a WHERE (event_type IN ('click', 'error') OR (event_type = 'view' AND k % 4 IN (0, 2)) "
    "OR (event_type = 'signup' AND k % 5 = 4)) AND file NOT IN "
    "(SELECT concat('src/f', s_suppkey * 3, '.c') FROM supplier)"
)
def explored_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose answer is valid, to be added to a stored explored set."""
    stored = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("src/f"), F.col("s_suppkey") * 3, F.lit(".c")).alias("file")
    )
    return mark_explored(stored, contracts.judge_issues(view(spark, sf_dir, "answers")).filter("ok"))


@query(
    f"SELECT path, content, coalesce({_LANGUAGE}, '') AS language FROM {_ALL_FILES} f WHERE NOT starts_with(path, '.git/')"
)
def snapshot_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files frozen into a snapshot, without links and version control folders."""
    frozen = snapshot.freeze(_all_files(spark, sf_dir), scratch_path(spark, "snapshots"), "s1").drop("digest")
    return frozen.withColumn("language", F.coalesce("language", F.lit("")))


@query(f"SELECT path, language, line_count, functions FROM ({INDEX_SQL}) i")
def snapshot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a snapshot, each language read from its own folder."""
    index = ops.build_index(snapshot.freeze(_all_files(spark, sf_dir), scratch_path(spark, "snapshots"), "s1"))
    return index.select("path", "language", "line_count", _shown(F.col("functions")).alias("functions"))


# A later state of all files: some gone, some longer, some elsewhere, some copied.
_LATER_FILES = f"""
(SELECT CASE length(content) % 11 WHEN 2 THEN concat('moved/', path) ELSE path END AS path,
   CASE WHEN length(content) % 11 = 1 AND NOT starts_with(path, 'py/') THEN concat(content, chr(10), 'x') ELSE content END AS content
 FROM {_ALL_FILES} f WHERE length(content) % 11 <> 0
 UNION ALL SELECT concat('copy/', path), content FROM {_ALL_FILES} f WHERE length(content) % 11 = 3 AND NOT starts_with(path, 'py/'))
"""


def _two_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = _all_files(spark, sf_dir)
    kind, python = F.length("content") % 11, F.startswith("path", F.lit("py/"))
    longer = F.when((kind == 1) & ~python, F.concat("content", F.lit("\nx"))).otherwise(F.col("content"))
    path = F.when(kind == 2, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    later = files.filter(kind != 0).select(path.alias("path"), longer.alias("content"), "is_symlink")
    copies = files.filter((kind == 3) & ~python)
    later = later.unionByName(copies.select(F.concat(F.lit("copy/"), "path").alias("path"), "content", "is_symlink"))
    root = scratch_path(spark, "snapshots")
    return snapshot.freeze(files, root, "s1"), snapshot.freeze(later, root, "s2")


_FROZEN = "SELECT path, sha256(content) AS digest FROM {} f WHERE NOT starts_with(path, '.git/') AND NOT contains(path, '/.git/')"


@query(
    f"WITH was AS ({_FROZEN.format(_ALL_FILES)}), now AS ({_FROZEN.format(_LATER_FILES)}), "
    "gone AS (SELECT path, digest, row_number() OVER (PARTITION BY digest ORDER BY path) AS turn FROM was WHERE path NOT IN (SELECT path FROM now)), "
    "come AS (SELECT path, digest, row_number() OVER (PARTITION BY digest ORDER BY path) AS turn FROM now WHERE path NOT IN (SELECT path FROM was)) "
    "SELECT coalesce(c.path, g.path) AS path, CASE WHEN c.path IS NULL THEN 'removed' WHEN g.path IS NULL THEN 'added' ELSE 'moved' END AS change, "
    "CASE WHEN c.path IS NOT NULL THEN coalesce(g.path, '') ELSE '' END AS old_path "
    "FROM gone g FULL JOIN come c ON c.digest = g.digest AND c.turn = g.turn "
    "UNION ALL SELECT was.path, 'changed', '' FROM was JOIN now ON was.path = now.path WHERE was.digest <> now.digest"
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, changed, removed and moved files between two snapshots of all files."""
    return changes.diff(*_two_snapshots(spark, sf_dir)).withColumn("old_path", F.coalesce("old_path", F.lit("")))


_LATER_SPANS = _spans_sql(f"({_FILE_LINES.replace('@files', _LATER_FILES)})")
LATER_INDEX_SQL = f"""
SELECT f.path, f.language, CAST(len(f.lines) AS INT) AS line_count,
  CASE WHEN f.language = 'python' THEN p.functions ELSE coalesce(s.functions, '') END AS functions
FROM ({_SPLIT.replace('@files', _LATER_FILES)}) f
LEFT JOIN (SELECT path, string_agg(concat(name, ':', start, '-', "end"), ';' ORDER BY start) AS functions
           FROM ({_LATER_SPANS}) x GROUP BY path) s ON s.path = f.path
LEFT JOIN ({_PYTHON_SPANS}) p ON p.path = replace(f.path, 'moved/', '')
WHERE f.language IS NOT NULL AND NOT {_SKIPPED.replace('path', 'f.path')}
"""


@query(LATER_INDEX_SQL)
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the second snapshot from that of the first: only contents that were not there are parsed."""
    old, new = _two_snapshots(spark, sf_dir)
    index = changes.refresh_index(old, materialize(ops.build_index(old), "index"), new)
    return index.select("path", "language", "line_count", _shown(F.col("functions")).alias("functions"))


def _write_pages(pages: DataFrame, root: str) -> None:
    """Pages as files below ``root``, one in five linked as well, one folder linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, html in zip(batch["path"], batch["content"]):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as sink:
                    sink.write(html.encode() + b"\xff")
                for link, points_to in ((f"{target}.link.js", target), (f"{root}/linked", f"{root}/web")):
                    if not os.path.lexists(link):
                        try:
                            os.symlink(points_to, link)
                        except FileExistsError:
                            pass
            yield batch[["path"]]

    pages.mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()


@query(
    "SELECT path, concat(html, chr(65533)) AS content FROM (SELECT html, page_id, "
    "concat(CASE page_id % 6 WHEN 0 THEN 'web/tests/' ELSE 'web/' END, 'p', page_id, "
    "CASE page_id % 3 WHEN 0 THEN '.js' ELSE '.tsx' END) AS path FROM pages) p "
    "WHERE page_id % 6 <> 1 AND page_id % 3 <> 1"
)
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as a directory tree with links and bad bytes, then read as a file table."""
    root = scratch_path(spark, "tree")
    pages = view(spark, sf_dir, "text_files").filter("path LIKE 'web/%'")
    _write_pages(pages, tree.mounted_path(root))
    return ops.source_files(tree.read_tree(spark, root)).drop("language")


@query("SELECT path, concat(content, chr(65533)) AS content FROM ($text_files) f")
def tree_source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages and documents written as a directory tree with links and bad bytes, then read through the data source."""
    root = scratch_path(spark, "tree")
    _write_pages(view(spark, sf_dir, "text_files"), tree.mounted_path(root))
    tree_source.register(spark)
    return spark.read.format(tree_source.FORMAT).option("hidden", "true").load(root)


def listed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with each file's top folder as its corpus."""
    corpus_id = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("")
    return file_index_table(spark, sf_dir).withColumn("corpus_id", corpus_id)


LISTING_SQL = f"""
SELECT corpus_id, part, string_agg(line, chr(10) ORDER BY n) AS text
FROM (SELECT corpus_id, line, n, CAST(floor((n - 1) / {prompts.PART_LINES}) AS BIGINT) AS part
  FROM (SELECT corpus_id, concat('- ', path, ' (', language, ', ', line_count, ' lines): ',
          CASE functions WHEN 'unknown' THEN 'functions unknown' WHEN '' THEN 'no functions'
               ELSE regexp_replace(replace(functions, ';', ', '), ':[0-9]+-[0-9]+', '', 'g') END) AS line,
          row_number() OVER (ORDER BY corpus_id, string_split(path, '/')) AS n
    FROM (SELECT *, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '' END AS corpus_id
          FROM ({INDEX_SQL}) i) c) l) p
GROUP BY corpus_id, part
"""


@query(LISTING_SQL)
def corpus_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file listing of every corpus in ordered parts."""
    return prompts.corpus_listing(listed_index(spark, sf_dir))
