"""One exploration pass: files to candidates, each file once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultgrain.operators import contracts, corpus, first_wins, prompts, tallies
from faultgrain.operators.complete import ClientFactory, complete
from faultgrain.operators.ids import assign_ids
from faultgrain.operators.journal import Journal
from faultgrain.plans.overview import stored_overviews, top_folder
from faultgrain.plans.prefilter import wanted_only
from faultgrain.plans.skew import lookup
from faultgrain.session import materialize
from faultgrain.sources.ledger import Ledger


def explore_prompts(tasks: DataFrame, files: DataFrame, overview: Column) -> DataFrame:
    """Prompts (key = path, prompt). Files that are no task are dropped before the exchange, but for a few."""
    with_text = tasks.join(wanted_only(files.select("path", "content"), "path", tasks, "path"), "path")
    return with_text.select(F.col("path").alias("key"), prompts.explore_prompt(overview).alias("prompt"))


def store_findings(ledger: Ledger, judged: DataFrame, tag: str = "") -> tuple[DataFrame, DataFrame]:
    """Commit the issues of judged answers (file, json, ok); returns offered and new rows.

    A file joins the explored set when its answer was valid, also without an issue.
    """
    offered = materialize(contracts.explode_issues(judged), "offered")
    # The keys are stored in buckets: only the batch is exchanged, and no candidate is read.
    new = first_wins.new_candidates(offered, ledger.runs("candidate_keys"), buckets=ledger.buckets)
    new = assign_ids(new, ["file", "pos"], start=ledger.next_id("open"))
    done = first_wins.mark_explored(ledger.runs("explored"), judged.filter("ok"), ledger.buckets)
    ledger.commit(append={"open": new, "explored": done}, tag=tag)
    return offered, new


def explore(
    ledger: Ledger,
    files: DataFrame,
    factory: ClientFactory,
    overview: str | ClientFactory = "",
    run_id: int = 1,
    scope: str | None = None,
    retries: int = 1,
    fail_fast: bool = True,
    journal: Journal | None = None,
) -> DataFrame:
    """Explore the files not explored yet and store what the answers report.

    ``overview`` is one text for all files, or a client factory: then each top folder has an overview of its own,
    which the ledger holds or the client writes once (``stored_overviews``).

    Returns the run's tallies. A file whose answers all failed stays unexplored. With
    ``fail_fast`` a broken call ends the job once all good answers are stored. With a ``journal`` answers
    outlive a job that dies before that.
    """
    index = materialize(corpus.build_index(files), "index")
    tasks = corpus.plan_tasks(index, scope)
    explored = ledger.read("explored")
    todo = corpus.pending_tasks(tasks, explored)
    if callable(overview):
        told = stored_overviews(ledger, index, overview)
        named = todo.withColumn("corpus_id", top_folder(F.col("path")))
        asked = explore_prompts(lookup(named, told, ["corpus_id"], ["path"]), files, F.coalesce("overview", F.lit("")))
    else:
        asked = explore_prompts(todo, files, F.lit(overview))
    answers = complete(asked, factory, contracts.judge_issues, contracts.ISSUES_SHAPE, retries, journal=journal, stage="explore")
    judged = answers.select(F.col("key").alias("file"), F.col("payload").alias("json"), "ok")
    offered, new = store_findings(ledger, judged)
    if fail_fast and (broken := answers.filter("failure IS NOT NULL").first()):
        raise RuntimeError(f"{broken.key}: {broken.failure}")
    in_run = lambda rows: rows.withColumn("run_id", F.lit(run_id))
    skipped = corpus.skipped_tasks(tasks, explored)
    return tallies.exploration_tallies(
        in_run(todo), in_run(skipped), in_run(judged.filter("NOT ok")), in_run(offered), in_run(new)
    )
