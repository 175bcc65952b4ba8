"""What changed between two snapshots, and an index that only parses what is new."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultgrain.operators.corpus import source_files
from faultgrain.operators.first_wins import first_per_key
from faultgrain.operators.ids import assign_ids
from faultgrain.operators.spans import HANDLERS, Handler, index_files
from faultgrain.plans.prefilter import wanted_only
from faultgrain.plans.skew import lookup
from faultgrain.session import materialize

CONTENT = ("digest", "language")


def _turns(paths: DataFrame, name: str) -> DataFrame:
    """``digest, turn`` and the path as ``name``: the place of each path among those of its digest.

    Numbered by a range sort over digest and path, so one content under a third of all paths is no single task's.
    """
    numbered = assign_ids(paths.select("digest", "path"), ["digest", "path"], column="place")
    first = numbered.groupBy("digest").agg(F.min("place").alias("first"))
    turned = lookup(numbered, first, ["digest"], ["path"], "inner")
    return turned.select("digest", (F.col("place") - F.col("first")).alias("turn"), F.col("path").alias(name))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change, old_path`` of every path that is not the same in both snapshots.

    Both have ``path`` (unique) and ``digest``; contents are not read. A path is ``added``, ``removed``,
    ``changed`` (another content) or ``moved``: a new path whose content an old path had that is gone, which
    ``old_path`` names; the moved path's old place is no row of its own. Of several paths with one content
    the first gone one in path order moved to the first new one, and so on; what is left over was removed or added.
    """
    before = old.select("path", F.col("digest").alias("old_digest"))
    after = new.select("path", F.col("digest").alias("new_digest"))
    other = before.join(after, "path", "full").filter("NOT old_digest <=> new_digest")
    other = materialize(other, "changes")
    gone = _turns(other.filter("new_digest IS NULL").select("path", F.col("old_digest").alias("digest")), "old_path")
    come = _turns(other.filter("old_digest IS NULL").select("path", F.col("new_digest").alias("digest")), "path")
    # A digest and a turn are one row on each side.
    paired = gone.join(come, ["digest", "turn"], "full")
    kind = F.when(F.col("path").isNull(), "removed").when(F.col("old_path").isNull(), "added").otherwise("moved")
    moved = F.when(F.col("path").isNotNull(), F.col("old_path"))
    single = paired.select(F.coalesce("path", "old_path").alias("path"), kind.alias("change"), moved.alias("old_path"))
    changed = other.filter("old_digest IS NOT NULL AND new_digest IS NOT NULL")
    return single.unionByName(changed.select("path", F.lit("changed").alias("change"), F.lit(None).cast("string").alias("old_path")))


def _short(digest: Column) -> Column:
    """The first 128 bits of a SHA-256 as bytes, a quarter of its text to move; what is none stays whole."""
    return F.coalesce(F.when(F.length(digest) == 64, F.unhex(F.left(digest, F.lit(32)))), digest.cast("binary"))


def unparsed(old: DataFrame, old_index: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index rows of ``new`` that ``old_index`` has for the same content and language, and the files still to be parsed.

    The files come as ``path, digest, language``, the digest shortened; contents are not read. Most files
    are where they were, so the snapshots meet by path, once; only files with another content than their path
    had are looked up by content, and a filter drops most of the old contents none of them has.
    """
    files = source_files(old.select("path", *CONTENT)).select("path", _short(F.col("digest")).alias("_digest"))
    known = old_index.select("path", F.col("language").alias("_language"), "line_count", "functions")
    # A path has one row; of a table that names one twice any will do, as the rest is looked up or parsed.
    seen = first_per_key(files.join(known, "path"), ["path"], ["_digest", "line_count"])
    now = source_files(new.select("path", *CONTENT)).select("path", _short(F.col("digest")).alias("digest"), "language")
    same = F.col("digest").eqNullSafe(F.col("_digest")) & F.col("language").eqNullSafe(F.col("_language"))
    met = seen.join(now, "path", "full").withColumn("_same", same)
    met = materialize(met.withColumn("digest", F.when(~F.col("_same"), F.col("digest"))), "met")
    stayed = met.filter("_same").select("path", "language", "line_count", "functions")
    other = met.filter("NOT _same AND digest IS NOT NULL").select("path", *CONTENT)
    had = met.filter("_language IS NOT NULL").select(
        F.col("_digest").alias("digest"), F.col("_language").alias("language"), "line_count", "functions"
    )
    had = first_per_key(wanted_only(had, "digest", other, "digest"), CONTENT, ["line_count"])
    found = materialize(lookup(other, had.withColumn("_known", F.lit(True)), CONTENT, ["path"]), "looked-up")
    reused = stayed.unionByName(found.filter("_known").select(*stayed.columns))
    return reused, found.filter("_known IS NULL").select("path", *CONTENT)


def refresh_index(
    old: DataFrame, old_index: DataFrame, new: DataFrame, handlers: Mapping[str, Handler] = HANDLERS
) -> DataFrame:
    """The index of snapshot ``new``, given the index of snapshot ``old``; equals an index built from nothing.

    Spans depend on content and language alone, so files with a content that was indexed before, under
    whatever path, take its row, and each new content is parsed once however many files have it.
    """
    reused, todo = unparsed(old, old_index, new)
    one = materialize(first_per_key(todo, CONTENT, ["path"]), "unparsed")
    # Unwanted contents are dropped in the scan's stage, but for a few.
    texts = wanted_only(source_files(new), "path", one, "path").join(one.select("path"), "path", "left_semi")
    parsed = index_files(texts.select("path", "language", "content"), handlers)
    parsed = parsed.drop("language").join(one, "path").select(*CONTENT, "line_count", "functions")
    found = lookup(todo, materialize(parsed, "parsed"), CONTENT, ["path"], "inner")
    return reused.unionByName(found.select("path", "language", "line_count", "functions"))
