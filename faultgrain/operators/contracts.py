"""Strict contracts over structured answers.

Each ``judge_*`` takes rows with a ``text`` column and adds ``json`` (canonical document),
``error`` (why the answer breaks its contract, NULL when it does not) and ``ok``. The checks
run on the whole answer inside its row, so judging needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultgrain.functions import weakness
from faultgrain.functions.evidence import Markers
from faultgrain.functions.json_scan import single_json
from faultgrain.functions.text import not_blank

# The key sets of the three answers.
ISSUE_KEYS = ("function", "cwe_id", "bug_category", "description", "trigger")
PROBE_KEYS = ("interpreter", "script")
REFUSAL_KEYS = ("refuse", "reason")
AUDIT_KEYS = ("verdict", "feedback")

ISSUES_SHAPE = (
    '[{"function": text, "cwe_id": integer from the list, "bug_category": text, '
    '"description": text, "trigger": text}]'
)
PROBE_SHAPE = '{"interpreter": [text, ...], "script": text} or {"refuse": true, "reason": text}'
AUDIT_SHAPE = '{"verdict": "ok" or "invalid", "feedback": text}'

Contract = Callable[[DataFrame], DataFrame]


def extract(answers: DataFrame) -> DataFrame:
    """Add ``json`` and ``error`` from the single JSON document in ``text``."""
    return (
        answers.withColumn("_found", single_json(F.col("text")))
        .withColumns({"json": F.col("_found.json"), "error": F.col("_found.error")})
        .drop("_found")
    )


def has_keys(value: Column, keys: Sequence[str]) -> Column:
    """``value`` is an object with exactly these keys."""
    found = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.coalesce(F.array_sort(found) == F.array(*map(F.lit, sorted(keys))), F.lit(False))


def type_of(value: Column, key: str) -> Column:
    """Type of a field: STRING, BOOLEAN, BIGINT (any integer of 64 bits), ARRAY<...> and so on."""
    return F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))


def text_of(value: Column, key: str) -> Column:
    """A string field, NULL for any other type."""
    return F.when(type_of(value, key) == "STRING", F.try_variant_get(value, f"$.{key}", "string"))


def says_something(value: Column, key: str) -> Column:
    return F.coalesce(not_blank(text_of(value, key)), F.lit(False))


def issue_error(issue: Column) -> Column:
    """Why one issue breaks the contract, NULL when it does not."""
    cwe_id = F.try_variant_get(issue, "$.cwe_id", "bigint")
    typed = (type_of(issue, "cwe_id") == "BIGINT") & weakness.is_known(cwe_id)
    texts = [says_something(issue, key) for key in ISSUE_KEYS if key != "cwe_id"]
    return (
        F.when(~has_keys(issue, ISSUE_KEYS), f"an issue needs exactly the keys {', '.join(ISSUE_KEYS)}")
        .when(~F.coalesce(typed, F.lit(False)), "cwe_id must be an integer from the list")
        .when(~(texts[0] & texts[1] & texts[2] & texts[3]), "issue texts must not be blank")
    )


def issues_error(document: Column) -> Column:
    """Why an issue report breaks the contract. One bad issue fails the report, ``[]`` is fine."""
    items = F.try_variant_get(document, "$", "array<variant>")
    errors = F.filter(F.transform(items, issue_error), lambda error: error.isNotNull())
    return F.when(items.isNull(), "expected a JSON array of issues").otherwise(F.get(errors, F.lit(0)))


def probe_error(document: Column, markers: Markers = Markers()) -> Column:
    """Why a probe or refusal breaks the contract."""
    refusal, probe = has_keys(document, REFUSAL_KEYS), has_keys(document, PROBE_KEYS)
    refuses = (type_of(document, "refuse") == "BOOLEAN") & F.try_variant_get(document, "$.refuse", "boolean")
    words = F.try_variant_get(document, "$.interpreter", "array<variant>")
    word_ok = lambda w: (F.schema_of_variant(w) == "STRING") & (F.try_variant_get(w, "$", "string") != "")
    command_ok = F.coalesce((F.size(words) > 0) & F.forall(words, word_ok), F.lit(False))
    script = text_of(document, "script")
    return (
        F.when(refusal & ~F.coalesce(refuses, F.lit(False)), "refuse must be true")
        .when(refusal & ~says_something(document, "reason"), "a refusal needs a reason")
        .when(refusal, F.lit(None))
        .when(~probe, "expected the keys interpreter and script, or refuse and reason")
        .when(~command_ok, "interpreter must be a non-empty array of non-empty texts")
        .when(~says_something(document, "script"), "script must not be blank")
        .when(~F.contains(script, F.lit(markers.setup)), f"script must print {markers.setup}")
        .when(~F.contains(script, F.lit(markers.reached)), f"script must print {markers.reached}")
    )


def audit_error(document: Column) -> Column:
    """Why an audit breaks the contract."""
    verdict = text_of(document, "verdict")
    return (
        F.when(~has_keys(document, AUDIT_KEYS), "expected exactly the keys verdict and feedback")
        .when(~F.coalesce(verdict.isin("ok", "invalid"), F.lit(False)), "verdict must be ok or invalid")
        .when(text_of(document, "feedback").isNull(), "feedback must be text")
        .when((verdict == "invalid") & ~says_something(document, "feedback"), "invalid needs feedback")
    )


def _judge(answers: DataFrame, check: Callable[[Column], Column]) -> DataFrame:
    """The parsed document gets a column of its own, so an answer is parsed once."""
    parsed = extract(answers).withColumn("_document", F.try_parse_json("json"))
    broken = F.when(F.col("error").isNull(), check(F.col("_document"))).otherwise(F.col("error"))
    return parsed.withColumn("error", broken).withColumn("ok", F.col("error").isNull())


def judge_issues(answers: DataFrame) -> DataFrame:
    return _judge(answers, issues_error).drop("_document")


def judge_probes(answers: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """Adds ``kind`` (probe, refusal or invalid), ``interpreter``, ``script`` and ``reason``."""
    judged = _judge(answers, lambda document: probe_error(document, markers))
    refusal = has_keys(F.col("_document"), REFUSAL_KEYS)
    kind = F.when(~F.col("ok"), "invalid").when(refusal, "refusal").otherwise("probe")
    fields = F.when(
        F.col("ok"), F.from_json("json", "interpreter array<string>, script string, reason string")
    )
    return (
        judged.withColumns({"kind": kind, "_fields": fields})
        .select("*", "_fields.interpreter", "_fields.script", "_fields.reason")
        .drop("_fields", "_document")
    )


def judge_audits(answers: DataFrame) -> DataFrame:
    """Adds ``audit_kind`` (audit_ok, audit_invalid, audit_unavailable) and ``feedback``."""
    judged = _judge(answers, audit_error)
    fields = F.when(F.col("ok"), F.from_json("json", "verdict string, feedback string"))
    return (
        judged.withColumn("_fields", fields)
        .withColumn(
            "audit_kind",
            F.coalesce(F.concat(F.lit("audit_"), F.col("_fields.verdict")), F.lit("audit_unavailable")),
        )
        .withColumn("feedback", F.col("_fields.feedback"))
        .drop("_fields", "_document")
    )


def judge_text(answers: DataFrame) -> DataFrame:
    """Any non-blank text passes, as it is."""
    ok = F.coalesce(not_blank(F.col("text")), F.lit(False))
    return answers.withColumns(
        {"json": F.col("text"), "ok": ok, "error": F.when(~ok, "the answer is blank")}
    )


_ISSUE_ROWS = (
    "array<struct<function:string,cwe_id:int,bug_category:string,description:string,trigger:string>>"
)


def explode_issues(judged: DataFrame) -> DataFrame:
    """Candidate rows of the valid reports: the report's ``file`` and each issue's position."""
    issues = judged.filter("ok").withColumn("_issues", F.from_json("json", _ISSUE_ROWS))
    return issues.select("file", F.posexplode("_issues").alias("pos", "_issue")).select(
        "file", "pos", "_issue.*", F.lit("pending").alias("status")
    )
