"""Batch completion of a prompt table by an outside service.

Every try is one job over the prompts still open: call, judge, write. Answers are written
before anything reads them, so a lost executor never repeats an answered call of an
earlier try. Keep speculation off: a speculative task would ask twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultgrain.operators.contracts import Contract
from faultgrain.operators.journal import Journal
from faultgrain.operators.rules import Rule
from faultgrain.plans.prefilter import wanted_only
from faultgrain.session import materialize


class Client(Protocol):
    def complete(self, prompt: str) -> str:
        """The service's text for one prompt."""


# Characters of answers handed on together: many short ones cost one batch, long ones do not pile up.
CHARS_AT_ONCE = 1 << 20

# Built once per partition, on the executor.
ClientFactory = Callable[[], Client]


class RuleClient:
    """Answers from ordered (marker, response) rules; for tests and offline runs."""

    def __init__(self, rules: Sequence[Rule], default: str | None = None) -> None:
        self._rules, self._default = tuple(rules), default

    def complete(self, prompt: str) -> str:
        for marker, response in self._rules:
            if marker in prompt:
                return response
        if self._default is None:
            raise LookupError("no rule matches")
        return self._default


def ask(prompts: DataFrame, factory: ClientFactory) -> DataFrame:
    """One call per row (key, prompt): ``text``, or ``failure`` when the service broke."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = factory()

        def answer(prompt: str) -> tuple[str | None, str | None]:
            try:
                return client.complete(prompt), None
            except Exception as problem:  # one broken call must not lose the others
                return None, f"{type(problem).__name__}: {problem}"

        for batch in batches:
            start, size, answers = 0, 0, []
            for at, prompt in enumerate(batch["prompt"]):
                text, failure = answer(prompt.as_py())
                answers.append((text, failure))
                size += len(text or failure or "")
                if size >= CHARS_AT_ONCE or at == batch.num_rows - 1:
                    texts, failures = (pa.array(part, pa.string()) for part in zip(*answers))
                    yield pa.RecordBatch.from_arrays([batch["key"].slice(start, len(answers)), texts, failures], names=["key", "text", "failure"])
                    start, size, answers = at + 1, 0, []

    key_type = dict(prompts.dtypes)["key"]
    return prompts.select("key", "prompt").mapInArrow(
        run, f"key {key_type}, text string, failure string"
    )


def feedback_on(error: Column, shape: str) -> Column:
    """What is added to a prompt whose last answer broke its contract."""
    return F.concat(
        F.lit("\n\nYour last answer could not be used: "),
        error,
        F.lit(f".\nAnswer with JSON of this shape and nothing else: {shape}"),
    )


def complete(
    prompts: DataFrame,
    factory: ClientFactory,
    contract: Contract,
    shape: str | None = None,
    retries: int = 2,
    parallel_calls: int | None = None,
    retry_failures: bool = False,
    fail_fast: bool = False,
    journal: Journal | None = None,
    stage: str = "",
) -> DataFrame:
    """Ask until the answer passes ``contract``, at most ``1 + retries`` times.

    Returns key, attempts, ok, payload, error and failure. The error of the last try is
    added to the original prompt (never to an earlier addition) when ``shape`` is given. A
    failure of the service ends a row at once unless ``retry_failures``; with ``fail_fast``
    it ends the job. With a ``journal`` answers are kept under ``stage`` as they come, and prompts that
    it has an answer for are not asked; a broken call is asked again by the next job.
    """

    def answered(asked: DataFrame) -> DataFrame:
        if journal is None:
            return ask(asked, factory)
        return journal.ask(asked, lambda part: ask(part, factory), stage, fail_fast)

    key_and_prompt = prompts.select("key", "prompt")
    if retries:  # a retry must not build all prompts again for a few rows
        key_and_prompt = materialize(key_and_prompt, "prompts")
    open_prompts, results = key_and_prompt, None
    for attempt in range(1, retries + 2):
        if parallel_calls:
            open_prompts = open_prompts.repartition(parallel_calls, "key")
        judged = materialize(contract(answered(open_prompts)), "answers")
        if fail_fast and (broken := judged.filter("failure IS NOT NULL").first()):
            raise RuntimeError(f"{broken.key}: {broken.failure}")
        again = ~F.col("ok") & (F.lit(retry_failures) | F.col("failure").isNull())
        last_try = attempt > retries
        done = (judged if last_try else judged.filter(~again)).select(
            "key",
            F.lit(attempt).alias("attempts"),
            "ok",
            F.when(F.col("ok"), F.col("json")).alias("payload"),
            "error",
            "failure",
        )
        results = done if results is None else results.unionByName(done)
        rejected = judged.filter(again).select("key", "error")
        if last_try or rejected.isEmpty():
            break
        open_prompts = wanted_only(key_and_prompt, "key", rejected, "key").join(rejected, "key")
        if shape is not None:
            added = F.concat("prompt", feedback_on(F.col("error"), shape))
            open_prompts = open_prompts.withColumn("prompt", added)
        open_prompts = open_prompts.drop("error")
    return results


def complete_by_stage(
    prompts: DataFrame,
    factories: Mapping[str, ClientFactory],
    contracts: Mapping[str, Contract],
    shapes: Mapping[str, str],
    **options: object,
) -> DataFrame:
    """Route each prompt to the client of its ``stage``; the routing is fixed, never a fallback.

    Prompts of a stage without client, or of none, come back after no attempt, with a ``failure``.
    """
    stage_name = F.coalesce(F.col("stage"), F.lit("(none)"))
    results = prompts.filter(~F.coalesce(F.col("stage").isin(*factories), F.lit(False))).select(
        "key",
        F.lit(0).alias("attempts"),
        F.lit(False).alias("ok"),
        F.lit(None).cast("string").alias("payload"),
        F.lit(None).cast("string").alias("error"),
        F.concat(F.lit("no client for stage "), stage_name).alias("failure"),
        "stage",
    )
    for stage, factory in factories.items():
        answered = complete(
            prompts.filter(F.col("stage") == stage),
            factory,
            contracts[stage],
            shapes[stage],
            **options,
        ).withColumn("stage", F.lit(stage))
        results = results.unionByName(answered)
    return results
