"""License scans over a positional index of licence words, in DataFrame functions alone.

Of every text only the words that some template holds are kept, with their places. Their
document frequencies over the whole corpus make the rarest words of each template's key
phrase its index entries. A file's postings of those entries, shifted by the place the words
have in the template, are intersected; what is left are places where the template may start.
There the whole key phrase is verified, and the share of the template's words at their places
is the score.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.common import keyed, unkeyed
from faultgrain.session import materialize

ENTRIES = 2
LEAST_SCORE = 0.8
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Template(NamedTuple):
    """A licence's words; the first ``key`` of them (all if 0) must be there as they are."""

    label: str
    words: str
    key: int = 0


# The base phrases and their labels.
BASE = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)
# Phrases of public licences.
MORE = (
    Template("agpl", "gnu affero general public license"),
    Template("apache-2", "licensed under the apache license version 2 0 the license", 5),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 8),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by-sa", "cc by sa"),
    Template("epl", "eclipse public license"),
    Template("gpl", "gnu general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    Template("lgpl", "gnu lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 6),
    Template("mpl", "mozilla public license"),
    Template("unlicense", "free and unencumbered software released into the public domain", 4),
)


def vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({word for t in templates for word in t.words.split()})


def postings(docs: DataFrame, known: Sequence[str]) -> DataFrame:
    """``doc_id, n_words, hits``: how many words each text has, and place and word of the ``known`` ones."""
    found = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    # lower() is quick but also folds two non-ASCII letters; the words kept are folded again by A-Z alone.
    hits = F.filter(
        F.transform("_words", lambda w, i: F.when(F.lower(w).isin(*known), F.struct(i.alias("at"), F.translate(w, _UPPER, _LOWER).alias("word")))),
        lambda h: h["word"].isin(*known),
    )
    split = docs.select("doc_id", F.coalesce(found, F.array().cast("array<string>")).alias("_words"))
    return split.select("doc_id", F.size("_words").cast("long").alias("n_words"), hits.alias("hits"))


def rarity(indexed: DataFrame, known: Sequence[str]) -> dict[str, int]:
    """In how many documents each known word is; as many numbers as the templates have words."""
    once = F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word")
    counts = dict.fromkeys(known, 0)
    counts.update((r["word"], r["count"]) for r in indexed.select(once).groupBy("word").count().collect())
    return counts


def _starts(word: str, place: int) -> Column:
    """Where a template would start by each posting of its word."""
    return F.transform(F.filter("hits", lambda h: h["word"] == word), lambda h: h["at"] - place)


def _found(template: Template, files: dict[str, int]) -> tuple[Column, Column]:
    """Verified starts of a template, and for each start how often it stands among the words after the key, sorted."""
    own = template.words.split()
    key = sorted(range(template.key or len(own)), key=lambda k: (files[own[k]], k))
    shared = reduce(F.array_intersect, [_starts(own[k], k) for k in key[:ENTRIES]])
    empty = F.array().cast("array<int>")
    verified = reduce(F.array_intersect, [_starts(own[k], k) for k in key[ENTRIES:]], shared)
    rare = F.exists("hits", lambda h: h["word"] == own[key[0]])
    starts = F.when(rare, F.when(F.size(shared) > 0, verified)).otherwise(empty)
    starts = F.filter(F.coalesce(starts, empty), lambda s: s >= 0)
    rest = range(template.key or len(own), len(own))
    more = [F.array_intersect(F.col("_starts"), _starts(own[k], k)) for k in rest]
    return starts, F.array_sort(F.flatten(F.array(*more))) if more else empty


def _judged(template: Template) -> tuple[Column, Column]:
    """The starts with a share of words in place of at least LEAST_SCORE, each judged by itself, and the largest share."""
    words, starts, more = len(template.words.split()), F.col("_starts"), F.col("_more")
    key = template.key or words

    def again(start: Column, i: Column, n: int) -> Column:
        """Whether the sorted ``more`` holds this start n times from here on."""
        return F.coalesce(F.get(more, i + (n - 1)) == start, F.lit(False))

    def run(start: Column, i: Column) -> Column:
        return reduce(lambda a, b: a + b, [again(start, i, n).cast("int") for n in range(1, words - key + 1)], F.lit(0))

    need = next(n for n in range(words - key + 1) if (key + n) / words >= LEAST_SCORE)
    kept = F.array_distinct(F.filter(more, lambda s, i: again(s, i, need))) if need else starts
    most = F.coalesce(F.array_max(F.transform(more, run)), F.lit(0)) if key < words else F.lit(0)
    return kept, F.when(F.size(starts) > 0, (key + most) / F.lit(words)).otherwise(0.0)


def _places(template: Template, starts: Column) -> Column:
    label, size = F.lit(template.label).alias("label"), F.lit(len(template.words.split())).alias("words")
    return F.transform(starts, lambda s: F.struct(label, s.alias("start"), size))


def scan(docs: DataFrame, base: Sequence[Template] = BASE, more: Sequence[Template] = MORE) -> DataFrame:
    """Each document's licences: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places``.

    ``n_base`` counts the places of all base phrases, ``first_word`` and ``last_word`` are the
    smallest and largest start of one; ``labels`` also holds those of further templates with a
    place of a share of at least LEAST_SCORE; ``score`` is the largest share of any place. ``places``
    lists label, start and words of every place with that share. Null and empty texts have no words and no labels
    (empty strings). Rows of one doc_id stay apart; rows without doc_id keep it null. An empty
    table gives no rows.
    """
    templates = [*base, *more]
    known = vocabulary(templates)
    indexed = materialize(postings(keyed(docs, "text"), known), "licence-words")
    files = rarity(indexed, known)
    judged = indexed.select("doc_id", "n_words", "hits")
    for k, template in enumerate(templates):
        starts, more = _found(template, files)
        judged = judged.withColumn("_starts", starts)
        judged = judged.withColumn("_more", more)
        kept, share = _judged(template)
        judged = judged.withColumn(f"_kept{k}", kept).withColumn(f"_share{k}", share)
        judged = judged.withColumnRenamed("_starts", f"_starts{k}").drop("_more")
    base_starts = F.flatten(F.array(*(F.col(f"_starts{k}") for k in range(len(base)))))
    labels = [F.when(F.col(f"_share{k}") >= LEAST_SCORE, F.lit(t.label)) for k, t in enumerate(templates)]

    def joined(some: list[Column]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*some)))), ",")

    places = F.flatten(F.array(*(_places(t, F.col(f"_kept{k}")) for k, t in enumerate(templates))))
    return judged.select(
        unkeyed(),
        "n_words",
        F.size(base_starts).cast("long").alias("n_base"),
        F.array_min(base_starts).cast("long").alias("first_word"),
        F.array_max(base_starts).cast("long").alias("last_word"),
        joined(labels[: len(base)]).alias("base_labels"),
        joined(labels).alias("labels"),
        F.greatest(*(F.col(f"_share{k}") for k in range(len(templates)))).alias("score"),
        F.array_sort(places).alias("places"),
    )
