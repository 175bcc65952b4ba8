"""The bug report as ordered text blocks: a table of bugs for each weakness and one of what is not proven.

Each block is one row with its sort key; table heads come from the distinct groups, so no row
has to look at its neighbour and the sort is the only global step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultgrain.functions import weakness
from faultgrain.plans.skew import lookup

TITLE = "# Proven bugs\n"
NOTHING = "Nothing was proven.\n"
BUG_COLUMNS = ("Bug", "Function", "File", "Category", "Description", "Trigger", "Probe", "Evidence")
OPEN_TITLE = "## Not proven"
OPEN_COLUMNS = ("State", "File", "Function", "Weakness", "Attempts", "Why")
UNRESOLVED = ("inconclusive", "rejected")
ORDER = ("section", "grp", "kind", "first", "second", "id")


def confirmed_with_candidates(confirmed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each confirmed bug with the candidate it came from."""
    bugs = confirmed.select("id", "candidate_id", "probe_path", "evidence_key")
    found = candidates.withColumnRenamed("id", "candidate_id")
    return bugs.join(found, "candidate_id")


def orphans(confirmed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Confirmed bugs whose candidate does not exist."""
    known = candidates.select(F.col("id").alias("candidate_id"))
    return lookup(confirmed, known, ["candidate_id"], ["id"], "left_anti")


def check_references(confirmed: DataFrame, candidates: DataFrame) -> None:
    """Raise when a confirmed bug has no candidate."""
    if lost := orphans(confirmed, candidates).first():
        raise ValueError(f"bug {lost.id} refers to unknown candidate {lost.candidate_id}")


def unresolved(candidates: DataFrame) -> DataFrame:
    """Candidates of the appendix."""
    return candidates.filter(F.col("status").isin(*UNRESOLVED))


def _block(rows: DataFrame, section: int, kind: int, text: Column, **keys: Column) -> DataFrame:
    return rows.select(
        F.lit(section).alias("section"),
        keys.get("grp", F.lit(0)).cast("int").alias("grp"),
        F.lit(kind).alias("kind"),
        keys.get("first", F.lit("")).alias("first"),
        keys.get("second", F.lit("")).alias("second"),
        keys.get("id", F.lit(0)).cast("bigint").alias("id"),
        text.alias("text"),
    )


def table_head(columns: Sequence[str]) -> str:
    return "\n".join((f"| {' | '.join(columns)} |", f"|{' --- |' * len(columns)}"))


def _row(*cells: Column) -> Column:
    """A table row; line ends in a cell become blanks, bars are escaped, a missing text is an empty cell."""

    def cell(value: Column) -> Column:
        one_line = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " ")
        return F.replace(one_line, F.lit("|"), F.lit("\\|"))

    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, cells)), F.lit(" |"))


def bug_blocks(bugs: DataFrame) -> DataFrame:
    """A table per weakness id with a row per bug, by (weakness id, function, bug id)."""
    group, columns = F.col("cwe_id"), ("id", "function", "file", "bug_category", "description", "trigger", "probe_path", "evidence_key")
    groups = bugs.select("cwe_id").distinct()
    heading = F.concat(F.lit("## "), weakness.label(group), F.lit("\n\n" + table_head(BUG_COLUMNS)))
    row = _row(*map(F.col, columns))
    return (
        _block(groups, 1, 0, heading, grp=group)
        .unionByName(_block(bugs, 1, 1, row, grp=group, first=F.col("function"), id=F.col("id")))
        .unionByName(_block(groups, 1, 2, F.lit(""), grp=group))  # an empty line ends a table
    )


def appendix_blocks(candidates: DataFrame) -> DataFrame:
    """One table of inconclusive, then rejected candidates, each by (file, function); no rows when there are none."""
    rows = unresolved(candidates)
    rank = F.when(F.col("status") == "inconclusive", 0).otherwise(1)
    any_row = rows.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    row = _row(F.col("status"), F.col("file"), F.col("function"), weakness.label(F.col("cwe_id")), F.col("verify_attempts"), F.col("reject_reason"))
    return _block(any_row, 2, 0, F.lit(f"{OPEN_TITLE}\n\n{table_head(OPEN_COLUMNS)}")).unionByName(
        _block(rows, 3, 1, row, grp=rank, first=F.col("file"), second=F.col("function"), id=F.col("id"))
    )


def report(confirmed: DataFrame, candidates: DataFrame) -> DataFrame:
    """All blocks (ORDER columns and ``text``); joined by newlines in ORDER they are the report."""
    bugs = confirmed_with_candidates(confirmed, candidates)
    none = confirmed.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    title = confirmed.sparkSession.range(1)
    return (
        _block(title, 0, 0, F.lit(TITLE))
        .unionByName(_block(none, 0, 1, F.lit(NOTHING)))
        .unionByName(bug_blocks(bugs))
        .unionByName(appendix_blocks(candidates))
    )
