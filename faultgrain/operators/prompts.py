"""Prompt texts from index, candidate and source rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultgrain.functions import paths, weakness
from faultgrain.functions.evidence import Markers
from faultgrain.functions.text import not_blank
from faultgrain.operators.complete import ClientFactory, complete
from faultgrain.operators.contracts import AUDIT_SHAPE, ISSUES_SHAPE, PROBE_SHAPE, judge_text
from faultgrain.operators.first_wins import latest_per_key
from faultgrain.operators.ids import assign_ids
from faultgrain.plans.prefilter import wanted_only
from faultgrain.plans.skew import lookup
from faultgrain.session import materialize

PART_LINES = 10_000
# A prompt is one text value; Spark holds at most 2 GiB in one.
MAX_PROMPT_CHARS = 1 << 29

OVERVIEW_TASK = (
    "Describe the source tree below in a short Markdown document: what it is for, how it is "
    "laid out, where callers enter it and where bugs are likely. Answer with the document only.\n\n"
    "Files:\n"
)
MERGE_TASK = (
    "The texts below describe parts of one source tree, in order. Write one short Markdown document "
    "about the whole tree. Answer with the document only.\n\n"
)


# The words and the line by which a listing and a prompt show a file's functions.
NO_FUNCTIONS, FUNCTIONS_UNKNOWN, NONE_EXTRACTED = "no functions", "functions unknown", "none extracted"
LISTING_LINE, SPAN = "- %s (%s, %d lines): %s", "%s (lines %d-%d)"


def span_names(functions: Column) -> Column:
    """``a, b``; ``no functions`` for none and ``functions unknown`` for NULL."""
    names = F.when(F.size(functions) > 0, F.array_join(functions["name"], ", ")).otherwise(NO_FUNCTIONS)
    return F.when(functions.isNotNull(), names).otherwise(FUNCTIONS_UNKNOWN)


def listing_line(path: Column, language: Column, lines: Column, functions: Column) -> Column:
    return F.format_string(LISTING_LINE, path, language, lines, span_names(functions))


def corpus_listing(index: DataFrame, part_lines: int | None = None) -> DataFrame:
    """The listing of each corpus as ordered parts (corpus_id, part, text).

    Joined by newlines in ``part`` order the parts are the whole listing. A part holds at
    most ``part_lines`` files, PART_LINES if not given, so a corpus with most of all files is still spread over tasks.
    """
    lines = index.select(
        "corpus_id",
        paths.parts(F.col("path")).alias("_order"),
        listing_line(F.col("path"), F.col("language"), F.col("line_count"), F.col("functions")).alias("line"),
    )
    # Numbering samples its input before it sorts it; write it once instead of indexing twice.
    numbered = assign_ids(materialize(lines, "listing"), ["corpus_id", "_order"], column="_n")
    part = F.floor((F.col("_n") - 1) / (part_lines or PART_LINES)).alias("part")
    ordered = F.sort_array(F.collect_list(F.struct("_n", "line")))
    return numbered.groupBy("corpus_id", part).agg(
        F.array_join(F.transform(ordered, lambda row: row.line), "\n").alias("text")
    )


def _pieces(texts: DataFrame, order: str, task: str, max_chars: int) -> DataFrame:
    """The texts of each corpus, in order, as prompts (corpus_id, piece, pieces, prompt).

    A piece takes texts until the next would make it longer than ``max_chars``-character steps
    allow; a longer single text is a piece of its own. Only the texts' lengths are ordered per corpus.
    """
    texts = texts.select("corpus_id", F.col(order).alias("_at"), "text")
    before = Window.partitionBy("corpus_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text") + 1).over(before)
    steps = texts.select("corpus_id", "_at", F.floor((end - 1) / max_chars).alias("_step"))
    numbered = steps.select(
        "corpus_id", "_at", F.dense_rank().over(Window.partitionBy("corpus_id").orderBy("_step")).alias("piece")
    )
    ordered = F.sort_array(F.collect_list(F.struct("_at", "text")))
    joined = F.array_join(F.transform(ordered, lambda row: row.text), "\n")
    pieces = texts.join(numbered, ["corpus_id", "_at"]).groupBy("corpus_id", "piece").agg(
        F.concat(F.lit(task), joined).alias("prompt")
    )
    counts = numbered.groupBy("corpus_id").agg(F.max("piece").alias("pieces"))
    return pieces.join(counts, "corpus_id").select("corpus_id", "piece", "pieces", "prompt")


def overview_prompts(parts: DataFrame, max_chars: int = MAX_PROMPT_CHARS) -> DataFrame:
    """Prompts (corpus_id, piece, pieces, prompt) of all corpora; a long listing has several.

    ``max_chars`` bounds the listing in a prompt, but no part of a listing is cut.
    """
    return _pieces(parts, "part", OVERVIEW_TASK, max_chars)


def load_or_generate(
    existing: DataFrame,
    prompts: DataFrame,
    factory: ClientFactory,
    fail_fast: bool = True,
    max_chars: int = MAX_PROMPT_CHARS,
) -> DataFrame:
    """The overview of each corpus (corpus_id, overview): the stored one unless it is blank.

    A missing one is asked for twice at most; a broken call counts as a try. Where a corpus has several
    pieces, each is asked for and then one overview of the answers, in as many rounds as it takes. A
    corpus still without one fails the job, or stays NULL without ``fail_fast``.
    """
    stored = existing.filter(not_blank(F.col("overview"))).select("corpus_id", "overview")
    done, asked = stored, materialize(prompts.join(stored, "corpus_id", "left_anti"), "overview-prompts")
    while not asked.isEmpty():
        named = asked.withColumn("key", F.to_json(F.struct("corpus_id", "piece")))
        answers = complete(named, factory, judge_text, retries=1, retry_failures=True)
        told = named.drop("prompt").join(answers.select("key", F.col("payload").alias("text")), "key")
        told = materialize(told.select("corpus_id", "piece", "pieces", "text"), "overview-pieces")
        lost = told.filter("text IS NULL").select("corpus_id").distinct()
        if fail_fast and (first := lost.first()):
            raise RuntimeError(f"no overview of corpus {first.corpus_id} after two tries")
        whole = told.filter("pieces = 1").select("corpus_id", F.col("text").alias("overview"))
        several = lost.join(told.filter("pieces > 1").select("corpus_id").distinct(), "corpus_id")
        done = done.unionByName(whole).unionByName(several.withColumn("overview", F.lit(None).cast("string")))
        rest = told.filter("pieces > 1").join(lost, "corpus_id", "left_anti")
        # At least two answers a prompt, so that every round has fewer pieces.
        most = rest.agg(F.max(F.length("text"))).first()[0] or 0
        asked = materialize(_pieces(rest, "piece", MERGE_TASK, max(max_chars, 2 * most + 2)), "overview-prompts")
    return done


def _fill(*pieces: Column | str) -> Column:
    return F.concat(*(F.lit(piece) if isinstance(piece, str) else piece for piece in pieces))


def span_list(functions: Column) -> Column:
    """``a (lines 1-3), b (lines 5-9)``; '' for none and ``none extracted`` for NULL."""
    shown = F.transform(functions, lambda span: F.format_string(SPAN, span["name"], span["start"], span["end"]))
    return F.coalesce(F.array_join(shown, ", "), F.lit(NONE_EXTRACTED))


def explore_prompt(overview: Column) -> Column:
    """Prompt of a task row with path, language, functions and content."""
    return _fill(
        "EXPLORE file ", F.col("path"), " (language: ", F.col("language"), ").\n",
        "Overview of the project:\n", overview, "\n\n",
        "Functions: ", span_list(F.col("functions")), ".\n",
        f"Report likely bugs as JSON of this shape, [] for none: {ISSUES_SHAPE}\n",
        f"cwe_id is one of:\n{weakness.listing()}\n\n",
        "```\n", F.col("content"), "\n```",
    )


def _finding(overview: Column) -> Column:
    """The part probe and audit prompts share, of a candidate row."""
    return _fill(
        "candidate in file ", F.col("file"), ", function ", F.col("function"), ".\n",
        "Overview of the project:\n", overview, "\n\n",
        "Bug type: ", weakness.label(F.col("cwe_id")), ".\n",
        "Bug category: ", F.col("bug_category"), ".\n",
        "Description: ", F.col("description"), "\n",
        "Trigger: ", F.col("trigger"), "\n",
    )


def probe_prompt(overview: Column, feedback: Column, markers: Markers = Markers()) -> Column:
    """Prompt of a candidate row; non-empty ``feedback`` asks for a rewrite."""
    rewrite = F.when(
        feedback != "", _fill("\n\nThe last probe was turned down, correct this:\n", feedback)
    )
    return _fill(
        "PROBE for ", _finding(overview),
        "Write one self-contained script that triggers the bug through a public entry point and "
        f"then exits non-zero. It prints {markers.setup} once everything it needs is loaded and "
        f"{markers.reached} when the input enters the target. Refuse, with a reason, only when "
        f"no probe is possible.\nAnswer with JSON of this shape: {PROBE_SHAPE}",
        F.coalesce(rewrite, F.lit("")),
    )


def audit_prompt(overview: Column) -> Column:
    """Prompt of a candidate row joined with its probe ``script`` and source ``content``."""
    return _fill(
        "AUDIT the probe for ", _finding(overview),
        "Without running it, check that it expects what the target promises, not what the bug "
        "does, and that its input can reach the target.\n"
        f"Answer with JSON of this shape: {AUDIT_SHAPE}\n\n",
        "Probe:\n```\n", F.col("script"), "\n```\n\n",
        "Source of ", F.col("file"), ":\n```\n", F.col("content"), "\n```",
    )


def with_source(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates with the ``content`` of their file; NULL content means no audit is possible.

    Files without candidates are dropped before the exchange, but for a few that share a hash bucket
    with one, and a file with very many candidates is spread over tasks.
    """
    sources = wanted_only(files, "path", candidates, "file").select(F.col("path").alias("file"), "content")
    return lookup(candidates, sources, ["file"], ["id"])


def latest_probes(generated: DataFrame) -> DataFrame:
    """The last script written per candidate (candidate_id, step, interpreter, script)."""
    return latest_per_key(generated, ["candidate_id"], ["step"])
