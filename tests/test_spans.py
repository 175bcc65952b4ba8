import ast
import random
import re
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from faultgrain.operators import corpus, spans

# The signature patterns, in Python's notation.
PATTERNS = {
    "c": re.compile(r"^\s*(?:[\w:<>,*&\[\]]+\s+)+(\w+)\s*\([^;{}]*\)"),
    "go": re.compile(r"^func\s+(?:\(\s*\w+\s+[\w*]+\s*\)\s+)?(\w+)\s*\("),
    "rust": re.compile(r"^\s*(?:pub\s+)?fn\s+(\w+)"),
}
SUFFIX = {"c": ".c", "go": ".go", "rust": ".rs"}
LINES = [
    "int f{}(int a) {{", "}}", "{{", "x = y;", "}} }}", "int g{}(int a);", "int h{}(int a) {{ }}", "}} else {{",
    "{{ {{", "  return foo{} (x)", "static  é{}² (b)", "func (r *T) go{}(x) {{", "func q{}(", "  pub fn z{}() {{",
    "fn y{}()", "}}}}{{", " int nb k{}(x)", "f{}(a) {{", "else if (a{}) {{", " * see foo{} (bar)", "pub(crate) fn n{}()",
    "async fn m{}() {{", "const x = (a{}) => {{", "a::b<c> *d{} (int e[]) const {{",
]


def walk(lines, pattern):
    """Spans from running sums: where the depth is first back at what it was, once a brace is open."""
    opened = list(accumulate((line.count("{") for line in lines), initial=0))
    closed = list(accumulate((line.count("}") for line in lines), initial=0))
    depth = [a - b for a, b in zip(opened, closed)]
    spans_ = []
    for at in range(len(lines)):
        name = pattern.search(lines[at])
        if name is None:
            continue
        ends = (e for e in range(at + 1, len(lines) + 1) if opened[e] > opened[at] and depth[e] <= depth[at])
        spans_.append((at + 1, next(ends, len(lines)), name.group(1)))
    return spans_


def corpus_of(seed):
    rng = random.Random(seed)
    files, expected = [], {}
    for k in range(60):
        language = rng.choice(list(SUFFIX))
        count = rng.choice([0, 1, 5, 60, 150])
        text = "".join(rng.choice(LINES).format(i) + rng.choice(["\n", "\r\n", "\r", "\x0b", " "]) for i in range(count))
        path = f"d/x{k}{SUFFIX[language]}"
        files.append((path, text))
        expected[path] = (len(text.splitlines()), walk(text.splitlines(), PATTERNS[language]))
    return files, expected


def index_of(spark, files):
    rows = corpus.build_index(spark.createDataFrame(files, "path string, content string")).collect()
    return {r.path: (r.line_count, None if r.functions is None else [tuple(f) for f in r.functions]) for r in rows}


@pytest.mark.parametrize("block_lines", [4096, 7, 1])
def test_brace_spans_agree_with_a_line_walk(spark, monkeypatch, block_lines):
    monkeypatch.setattr(spans, "BLOCK_LINES", block_lines)
    files, expected = corpus_of(block_lines)
    assert index_of(spark, files) == expected


def test_special_files(spark):
    files = [
        ("long.c", "int x " + "a " * 200_000 + "\n"),
        ("parens.c", "(" * 100_000),
        ("one.c", "int f(void) " + "{}" * 50_000),
        ("p.py", "def f():\n  async def g():\n    pass\n@x\ndef h(): pass\n"),
        ("bad.py", "def f(:\n"),
        ("nul.py", "x = 1\0"),
        ("empty.py", ""),
        ("empty.c", ""),
        ("none.go", "package x\n"),
        ("__init__.py", "x = 1"),
        (".hidden.py", ""),
        (".git/hook.py", "def f(): pass"),
        ("README.md", "int f() {}"),
    ]
    assert index_of(spark, files) == {
        "long.c": (1, []), "parens.c": (1, []), "one.c": (1, [(1, 1, "f")]),
        "p.py": (5, [(1, 3, "f"), (2, 3, "g"), (5, 5, "h")]), "bad.py": (1, None), "nul.py": (1, None),
        "empty.py": (0, []), "empty.c": (0, []), "none.go": (1, []), "__init__.py": (1, []), ".hidden.py": (0, []),
    }


def test_language_without_handler_has_unknown_functions(spark):
    files = spark.createDataFrame([("a.rs", "fn a() {}"), ("b.go", "func b() {}")], "path string, content string")
    rows = corpus.build_index(files, {"go": spans.brace_handler}).collect()
    assert {r.path: r.functions and len(r.functions) for r in rows} == {"a.rs": None, "b.go": 1}


def test_symlinks_in_a_file_table_are_skipped(spark):
    files = spark.createDataFrame([("a.py", "", False), ("b.py", "", True)], "path string, content string, is_symlink boolean")
    assert [r.path for r in corpus.source_files(files).collect()] == ["a.py"]


def test_python_spans_agree_with_ast(spark):
    source = open(ast.__file__).read()
    nodes = [n for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    expected = sorted((n.lineno, n.end_lineno, n.name) for n in nodes)
    assert index_of(spark, [("ast.py", source)])["ast.py"][1] == expected


def test_one_file_with_most_lines(spark):
    """A table of lines where one file holds nearly all of them, compared with a line walk."""
    rng = random.Random(3)
    lines = [rng.choice(LINES).format(i) for i in range(12_000)]
    rows = [("hot.c", "c", n, line) for n, line in enumerate(lines, 1)] + [("cold.c", "c", 1, "int f() {")]
    table = spark.createDataFrame(rows, "path string, language string, n int, line string").repartition(4)
    found = spans.brace_spans(spans.brace_lines(spans.with_last_line(table)))
    got = sorted((r.start, r.end, r.name) for r in found.filter("path = 'hot.c'").collect())
    assert got == walk(lines, PATTERNS["c"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "unspecifiedframe" not in plan and "unboundedfollowing" not in plan


@pytest.mark.parametrize("row_lines", [512, 40, 0])
def test_files_in_rows_and_files_by_lines_agree_with_a_line_walk(spark, monkeypatch, row_lines):
    monkeypatch.setattr(spans, "ROW_LINES", row_lines)
    files, expected = corpus_of(31)
    assert index_of(spark, files) == expected


def test_short_files_are_indexed_without_a_shuffle(spark):
    files = spark.createDataFrame([("a.c", "int f() {\n}\n"), ("b.py", "def f(): pass\n"), ("c.go", "")], "path string, content string")
    index = spans.brace_handler(corpus.source_files(files).select("path", "language", "content"))
    plan = index._jdf.queryExecution().executedPlan().toString()
    in_rows = plan[: plan.rindex("ArrowEvalPython")]
    assert "Window" not in in_rows and "Exchange" not in in_rows
    assert sorted((r.path, len(r.functions)) for r in index.collect()) == [("a.c", 1), ("b.py", 0), ("c.go", 0)]


def test_defs_in_every_kind_of_block(spark):
    source = "\n".join([
        "if 1:\n def a(): pass\nelif 2:\n def b(): pass\nelse:\n def c(): pass",
        "try:\n def d(): pass\nexcept ValueError:\n def e(): pass\nelse:\n def f(): pass\nfinally:\n def g(): pass",
        "match 1:\n case 1:\n  def h(): pass\nwhile 0:\n async def i(): pass\nelse:\n def j(): pass",
        "with x:\n class K:\n  def k(self): pass\nfor y in z:\n def l(): pass\nlambda: 0; m = [n for n in o]",
        "try:\n def p(): pass\nexcept* OSError:\n def q(): pass",
    ])
    nodes = [n for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    expected = sorted((n.lineno, n.end_lineno, n.name) for n in nodes)
    assert len(expected) == 14 and index_of(spark, [("x.py", source), ("null.py", None)]) == {"x.py": (len(source.splitlines()), expected), "null.py": (None, None)}
