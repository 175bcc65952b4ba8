from pyspark.sql import functions as F

from faultgrain.operators import prompts
from faultgrain.operators.complete import RuleClient, complete_by_stage
from faultgrain.operators.contracts import judge_text
from faultgrain.operators.corpus import build_index
from faultgrain.plans import skew
from faultgrain.plans.explore import explore_prompts
from faultgrain.plans.prefilter import wanted_only
from faultgrain.plans.probe import make_probes
from faultgrain.functions.text import strip
from faultgrain.sources import snapshot


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def facts(spark):
    rows = [(1, i) for i in range(900)] + [(2, i) for i in range(40)] + [(None, i) for i in range(300)] + [(7, 0)]
    return spark.createDataFrame(rows, "key int, n int")


def test_salts_grow_with_a_key(spark):
    found = {r.key: r._salts for r in skew.hot_keys(facts(spark), ["key"], rows=100).collect()}
    assert found == {1: 9}
    assert skew.hot_keys(facts(spark), ["key"]).count() == 0


def test_lookup_joins_alike_with_and_without_salts(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "x")], "key int, v string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        want = sorted(map(str, facts(spark).join(dim, "key", how).collect()))
        for rows in (10, 100, 10_000):
            got = skew.lookup(facts(spark), dim, ["key"], ["n"], how, rows=rows)
            assert sorted(map(str, got.collect())) == want


def test_wanted_only_loses_no_wanted_row(spark):
    table = spark.range(50_000).select(F.col("id").cast("string").alias("path"))
    wanted = spark.createDataFrame([(str(i),) for i in range(0, 50_000, 500)] + [(None,), ("else",)], "file string")
    kept = {r.path for r in wanted_only(table, "path", wanted, "file").collect()}
    assert kept >= {str(i) for i in range(0, 50_000, 500)} and len(kept) < 200
    assert wanted_only(table, "path", wanted.limit(0), "file").count() == 0


def test_unwanted_contents_meet_the_filter_before_an_exchange(spark, tmp_path):
    spark.createDataFrame([(f"f{i}.c", "int x;") for i in range(50)], "path string, content string").write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = spark.createDataFrame([("f7.c", "c", None)], "path string, language string, functions array<struct<start:int,end:int,name:string>>")
        asked = explore_prompts(tasks, files, F.lit(""))
        candidates = spark.createDataFrame([(1, "f7.c")], "id int, file string")
        for found in (asked, prompts.with_source(candidates, files)):
            lines = plan_of(found).splitlines()
            scan = next(k for k, line in enumerate(lines) if "FileScan" in line and "content" in line)
            # Between the filter and the scan there are the lines of the filter's own subquery and no exchange.
            kept = max(k for k, line in enumerate(lines[:scan]) if "element_at" in line and "Filter" in line)
            own = next(k for k, c in enumerate(lines[kept + 1]) if c != " ")
            assert not any("Exchange" in line for line in lines[kept + 1 : scan] if line[own] != ":")
            assert found.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_stage_without_client_is_a_failure(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "x")], "key int, stage string, prompt string")
    found = complete_by_stage(rows, {"a": lambda: RuleClient([], default="fine")}, {"a": judge_text}, {"a": ""})
    assert {r.key: (r.attempts, r.ok, r.failure) for r in found.collect()} == {
        1: (1, True, None), 2: (0, False, "no client for stage b"), 3: (0, False, "no client for stage (none)"),
    }


def test_a_snapshot_holds_no_links(spark, tmp_path):
    rows = [("a.py", "x = 1\n", False), ("l.py", "x = 1\n", True), ("n.py", "", None), (".git/h.py", "", False)]
    files = spark.createDataFrame(rows, "path string, content string, is_symlink boolean")
    frozen = snapshot.freeze(files, str(tmp_path), "s")
    assert sorted(r.path for r in build_index(frozen).collect()) == ["a.py", "n.py"]


def test_strip_is_linear(spark):
    text = spark.range(1).select(F.concat(F.lit("x"), F.repeat(F.lit(" "), 1_000_000), F.lit("y ")).alias("t"))
    assert text.select(F.length(strip(F.col("t")))).first()[0] == 1_000_002


class Author:
    def complete(self, prompt):
        if prompt.startswith("PROBE"):
            return '{"interpreter":["sh"],"script":"PROBE_SETUP_OK PROBE_REACHED"}'
        raise ConnectionError("no audit")


def test_probes_without_the_audit_gate(spark):
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    candidates = spark.createDataFrame(
        [(1, "a.c", "f", 369, "m", "d", "t")],
        "id bigint, file string, function string, cwe_id int, bug_category string, description string, trigger string",
    )
    files = spark.createDataFrame([("a.c", "int x;")], "path string, content string")
    probes, steps = make_probes(candidates, files, Author, audit=False)
    assert probes.count() == 1 and steps.count() == 0
    probes, steps = make_probes(candidates, files, Author)
    assert probes.count() == 0
    assert [(r.kind, r.detail) for r in steps.collect()] == [("audit_unavailable", "ConnectionError: no audit")]
