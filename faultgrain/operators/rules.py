"""Ordered substring rules: the first rule whose marker occurs in a text decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str]


def first_rule(text: Column, rules: Sequence[Rule], default: str | None = None) -> Column:
    """The value of the first (marker, value) whose marker ``text`` contains.

    Without a match the default, or NULL. Rules are few and ordered, so they become one
    conditional expression instead of a join of every text with every rule.
    """
    matched = F.lit(default).cast("string")
    for marker, value in reversed(rules):
        matched = F.when(F.contains(text, F.lit(marker)), F.lit(value)).otherwise(matched)
    return matched


def match_or_fail(text: Column, rules: Sequence[Rule]) -> Column:
    """``first_rule`` that raises when no rule matches."""
    found = first_rule(text, rules)
    message = F.concat(F.lit("no rule matches: "), F.substring(text, 1, 120))
    return F.coalesce(found, F.raise_error(message).cast("string"))
