import pytest
from pyspark.sql import functions as F

from faultgrain.functions import weakness
from faultgrain.operators import prompts
from faultgrain.operators.complete import RuleClient
from faultgrain.schemas import FILE_INDEX

INDEX = [
    ("b.py", "python", 1, None),
    ("a/x.py", "python", 14, [(4, 9, "average"), (12, 14, "clamp")]),
    ("a-x.c", "c", 0, []),
]


def index(spark):
    return spark.createDataFrame(INDEX, FILE_INDEX)


def test_listing_parts_join_to_the_whole(spark, monkeypatch):
    expected = (
        "- a/x.py (python, 14 lines): average, clamp\n"
        "- a-x.c (c, 0 lines): no functions\n"
        "- b.py (python, 1 lines): functions unknown"
    )
    for part_lines in (1, 2, 10_000):
        monkeypatch.setattr(prompts, "PART_LINES", part_lines)
        parts = prompts.corpus_listing(index(spark).withColumn("corpus_id", F.lit("c")))
        assert "\n".join(r.text for r in parts.orderBy("part").collect()) == expected
        (prompt,) = prompts.overview_prompts(parts).collect()
        assert prompt.prompt == prompts.OVERVIEW_TASK + expected and prompt.pieces == 1
    single = prompts.corpus_listing(index(spark).withColumn("corpus_id", F.lit("c")), part_lines=1)
    pieces = prompts.overview_prompts(single, max_chars=10).orderBy("piece").collect()
    assert [(r.piece, r.pieces) for r in pieces] == [(1, 3), (2, 3), (3, 3)]
    assert "\n".join(r.prompt.removeprefix(prompts.OVERVIEW_TASK) for r in pieces) == expected


def test_a_long_listing_still_gets_an_overview(spark):
    rows = [(f"d/{c}{i}.c", "c", 1, [], c) for c in "ab" for i in range(9)] + [("e/z.c", "c", 1, [], "z")]
    index_ = spark.createDataFrame(rows, FILE_INDEX + ", corpus_id string")
    asked = prompts.overview_prompts(prompts.corpus_listing(index_, part_lines=1), max_chars=40)
    none = spark.createDataFrame([], "corpus_id string, overview string")
    client = lambda: RuleClient([("all of a", "all of a"), ("d/a", "about a"), ("about a", "all of a"), ("d/b4", " "), ("d/b", "about b")], default="small")
    found = prompts.load_or_generate(none, asked, client, fail_fast=False, max_chars=30)
    assert {r.corpus_id: r.overview for r in found.collect()} == {"a": "all of a", "b": None, "z": "small"}


def test_explore_prompt_tells_unknown_from_none(spark):
    rows = index(spark).withColumn("content", F.lit("SOURCE")).orderBy("path")
    texts = [r.p for r in rows.select(prompts.explore_prompt(F.lit("OVER")).alias("p")).collect()]
    assert "Functions: .\n" in texts[0]
    assert "Functions: average (lines 4-9), clamp (lines 12-14).\n" in texts[1]
    assert "Functions: none extracted.\n" in texts[2]
    assert all("OVER" in t and "SOURCE" in t and "CWE-369 Divide By Zero" in t for t in texts)
    assert weakness.listing().count("\n") == 38 and len(set(weakness.WEAKNESS_IDS)) == 39


def test_overview_is_loaded_or_generated(spark):
    existing = spark.createDataFrame([("have", "kept "), ("blank", " \n")], "corpus_id string, overview string")
    asked = spark.createDataFrame([(c, 1, 1, f"p {c}") for c in ("have", "blank", "new")], "corpus_id string, piece int, pieces int, prompt string")
    client = lambda: RuleClient([("blank", "fresh"), ("new", "made")])
    found = prompts.load_or_generate(existing, asked, client)
    assert {r.corpus_id: r.overview for r in found.collect()} == {"have": "kept ", "blank": "fresh", "new": "made"}
    mute = lambda: RuleClient([], default=" ")
    with pytest.raises(RuntimeError, match="two tries"):
        prompts.load_or_generate(existing, asked, mute)
    kept = prompts.load_or_generate(existing, asked, mute, fail_fast=False)
    assert {r.corpus_id: r.overview for r in kept.collect()} == {"have": "kept ", "blank": None, "new": None}


def test_probe_and_audit_prompts(spark):
    candidates = spark.createDataFrame(
        [(1, "a.py", "f", 369, "math", "divides", "[]"), (2, "gone.py", "g", 9999, "x", "y", "z")],
        "id bigint, file string, function string, cwe_id int, bug_category string, description string, trigger string",
    )
    feedback = F.when(F.col("id") == 1, "").otherwise("say more")
    first, second = (r.p for r in candidates.select("id", prompts.probe_prompt(F.lit("O"), feedback).alias("p")).orderBy("id").collect())
    assert "CWE-369: Divide By Zero." in first and "turned down" not in first
    assert "Bug type: CWE-9999.\n" in second and second.endswith("say more")
    files = spark.createDataFrame([("a.py", "SOURCE"), ("other.py", "")], "path string, content string")
    found = prompts.with_source(candidates.withColumn("script", F.lit("SCRIPT")), files)
    rows = {r.id: r for r in found.select("id", "content", prompts.audit_prompt(F.lit("O")).alias("p")).collect()}
    assert "SOURCE" in rows[1].p and "SCRIPT" in rows[1].p
    assert rows[2].content is None and rows[2].p is None
