import pytest
from pyspark.sql import functions as F

from faultgrain.functions import paths
from faultgrain.operators import corpus

SKIPPED = {
    "app.py": False, ".hidden.py": False, "a/.hidden.py": False, ".git/hook.py": True, "a/.x/b.py": True,
    "a/node_modules/b.js": True, "venv/b.py": True, ".venv/b.py": True, "__pycache__/b.py": True,
    "Node_Modules/b.js": False, "node_modules.py": False, "my_venv/b.py": False, "a/venvs/b.py": False,
}
LANGUAGES = {
    "a.py": "python", "a.H": "c", "x/a.TSX": "typescript", ".py": None, "a": None, "a.txt": None, "a.b.rs": "rust",
    "..py": "python", "dir.py/a": None, "a.cxx": "cpp", "a.": None,
}
TESTS = {
    "test_a.py": True, "a_test.py": True, "conftest.py": True, "xconftest.py": False, "Test_a.py": False,
    "a_test.go": True, "a_test.rs": True, "a_test.hpp": True, "test_a.cc": True, "FooTest.java": True,
    "FooTests.java": True, "FooTestCase.java": True, "FooTesting.java": False, "a.spec.tsx": True, "a.test.js": True,
    "atest.js": False, "TESTS/a.c": True, "a/Mocks/b.go": True, "a/testdata/x.py": True, "mytests/x.py": False,
    "a\\tests\\x.py": True, "tests": False, "test_a.go": False,
}


@pytest.mark.parametrize(
    "expression, cases",
    [(paths.in_skipped_dir, SKIPPED), (paths.language, LANGUAGES), (paths.is_test_file, TESTS)],
)
def test_path_rules(spark, expression, cases):
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", expression(F.col("p")).alias("r"))
    assert {r.p: r.r for r in rows.collect()} == cases


@pytest.mark.parametrize("scope, count", [(None, 3), ("", 3), (".", 3), ("a", 2), ("a/", 2), ("a/sub", 1), ("a/su", 0), ("c", 0), ("/", 0)])
def test_scope(spark, scope, count):
    index = spark.createDataFrame(
        [(p, "python", None) for p in ("a/x.py", "a/sub/y.py", "b/z.py", "a/test_x.py")],
        "path string, language string, functions array<string>",
    )
    assert corpus.plan_tasks(index, scope).count() == count


def test_component_order(spark):
    index = spark.createDataFrame([("a-b.py",), ("a/b.py",), ("a.py",), ("a/a/z.py",)], "path string")
    assert [r.path for r in corpus.in_index_order(index).collect()] == ["a/a/z.py", "a/b.py", "a-b.py", "a.py"]
