"""Overviews that a job makes once and the next jobs find in the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultgrain.functions.text import not_blank
from faultgrain.operators import prompts
from faultgrain.operators.complete import ClientFactory
from faultgrain.session import materialize
from faultgrain.sources.ledger import Ledger


def top_folder(path: Column) -> Column:
    """The corpus of a file: its first folder, the empty name for files without one."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("")


def stored_overviews(
    ledger: Ledger, index: DataFrame, factory: ClientFactory, corpus: Column | None = None, fail_fast: bool = True, max_chars: int = prompts.MAX_PROMPT_CHARS
) -> DataFrame:
    """``corpus_id, overview`` of every corpus of ``index``: the ledger's, or asked for and added to the ledger.

    ``corpus`` names a file's corpus (default ``top_folder``). Only corpora without a stored overview that says
    something are listed and asked about; what was told is stored before a corpus without an answer fails the job.
    """
    named = index.withColumn("corpus_id", top_folder(F.col("path")) if corpus is None else corpus)
    stored = materialize(ledger.read("overviews").filter(not_blank(F.col("overview"))), "stored-overviews")
    missing = materialize(named.join(stored.select("corpus_id"), "corpus_id", "left_anti"), "unseen-corpora")
    if not missing.isEmpty():
        asked = prompts.overview_prompts(prompts.corpus_listing(missing), max_chars)
        told = prompts.load_or_generate(stored.limit(0), asked, factory, fail_fast=False, max_chars=max_chars)
        told = materialize(told, "overviews")
        ledger.commit(append={"overviews": told.filter(not_blank(F.col("overview")))})
        lost = told.filter(~F.coalesce(not_blank(F.col("overview")), F.lit(False)))
        if fail_fast and (first := lost.first()):
            raise RuntimeError(f"no overview of corpus {first.corpus_id} after two tries")
    known = ledger.read("overviews").filter(not_blank(F.col("overview")))
    return named.select("corpus_id").distinct().join(known, "corpus_id")
