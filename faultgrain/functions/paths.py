"""Expressions over '/'-separated relative paths."""

from __future__ import annotations

from collections.abc import Mapping
from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories never indexed (any directory starting with a dot is
# skipped as well).
VENDOR_DIRS = ("__pycache__", "node_modules", "venv", ".venv")

# File suffix -> language.
LANGUAGE_BY_SUFFIX = {
    ".py": "python",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".go": "go",
    ".java": "java",
    ".rs": "rust",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
}

# Directory names (any case) that hold tests.
TEST_DIRS = (
    "test",
    "tests",
    "__tests__",
    "testing",
    "test_helpers",
    "testdata",
    "testutils",
    "fixtures",
    "mocks",
)

# Base names of test files, by naming habit.
TEST_NAMES = (
    r"test_.*\.py",
    r".*_test\.py",
    r"conftest\.py",
    r".*_test\.go",
    r".*_test\.(?:cpp|cc|cxx|c|h|hpp)",
    r"test_.*\.(?:cpp|cc|cxx|c|h|hpp)",
    r".*Test(?:s|Case)?\.java",
    r".*\.(?:test|spec)\.(?:js|jsx|ts|tsx)",
    r".*_test\.rs",
)


def parts(path: Column) -> Column:
    """Path components; as a sort key it orders ``a/b`` before ``a-b``."""
    return F.split(path, "/", -1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def in_skipped_dir(path: Column) -> Column:
    """A parent directory is hidden or a vendor directory."""
    names = "|".join(name for name in VENDOR_DIRS if not name.startswith("."))
    return path.rlike(rf"(?:^|/)(?:\.[^/]*|{names})/")


def language(path: Column, suffixes: Mapping[str, str] = LANGUAGE_BY_SUFFIX) -> Column:
    """Language by lower-cased suffix; NULL for an unknown or missing suffix."""
    suffix = F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)\z", 1))
    table = F.create_map(*(F.lit(item) for pair in suffixes.items() for item in pair))
    return F.element_at(table, suffix)


def is_test_file(path: Column) -> Column:
    """The path lies in a test directory or its base name follows a test naming habit."""
    unified = F.replace(path, F.lit("\\"), F.lit("/"))
    in_dir = F.lower(unified).rlike(rf"(?:^|/)(?:{'|'.join(TEST_DIRS)})/")
    # (?d): only \n is a line end for '.' and '$', as in Python.
    named = base_name(unified).rlike(rf"(?d)^(?:{'|'.join(TEST_NAMES)})$")
    return in_dir | named


def in_scope(path: Column, scope: str | None) -> Column:
    """``path`` lies under the directory ``scope``; None, '' and '.' mean everywhere."""
    if scope in (None, "", "."):
        return F.lit(True)
    return path.startswith(scope.strip("/") + "/")


def has_part(path: Column, names: tuple[str, ...]) -> Column:
    """Any component of ``path`` is one of ``names``."""
    return F.arrays_overlap(parts(path), F.array(*(F.lit(name) for name in names)))
