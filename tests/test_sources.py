import os

import pytest
from pyspark.sql import functions as F

from faultgrain.operators import report
from faultgrain.operators.corpus import source_files
from faultgrain.schemas import CANDIDATES, CONFIRMED
from faultgrain.sources import sinks, snapshot, tree
from faultgrain.sources.ledger import Ledger, by_id, in_id_order, pending, split_by_status

BASE = ("main", 369, "math", "what", "how")


def candidates(spark, *rows):
    full = [(i, f"f{i}.c", *BASE, status, reason, attempts) for i, status, reason, attempts in rows]
    return spark.createDataFrame(full, CANDIDATES)


def test_ledger_versions(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.version == 0 and ledger.candidates().count() == 0
    first = candidates(spark, (1, "pending", None, 0), (2, "rejected", "no", 0))
    ledger.commit(append={"open": first}, tag="one")
    old = ledger.candidates()
    bugs = spark.createDataFrame([(1, 3, "p", "k")], CONFIRMED)
    ledger.commit(append={"open": candidates(spark, (3, "pending", None, 0)), "confirmed": bugs})
    assert old.count() == 2 and ledger.version == 2
    now = ledger.candidates()
    assert [r.id for r in in_id_order(now).collect()] == [1, 2, 3]
    assert [r.id for r in in_id_order(pending(now)).collect()] == [1, 3]
    assert by_id(now, 2).first().reject_reason == "no" and by_id(now, 9).first() is None
    still_open, closed = split_by_status(ledger.read("open"))
    ledger.commit(append={"closed": closed}, replace={"open": still_open})
    assert (ledger.read("open").count(), ledger.read("closed").count(), ledger.read("confirmed").count()) == (2, 1, 1)
    assert ledger.has_tag("one") and not ledger.has_tag("two")


def test_a_failed_commit_changes_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    good = candidates(spark, (1, "pending", None, 0))
    ledger.commit(append={"open": good})
    bad = good.withColumn("file", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        ledger.commit(append={"confirmed": spark.createDataFrame([(1, 1, "p", "k")], CONFIRMED), "closed": bad})
    assert ledger.version == 1 and ledger.read("confirmed").count() == 0


def test_references(spark):
    known = candidates(spark, (1, "confirmed", None, 0))
    report.check_references(spark.createDataFrame([(1, 1, "p", "k")], CONFIRMED), known)
    with pytest.raises(ValueError, match="candidate 7"):
        report.check_references(spark.createDataFrame([(1, 7, "p", "k")], CONFIRMED), known)


def test_tree(spark, tmp_path):
    def put(path, data=b"x = 1\n"):
        target = tmp_path / "src" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)

    for path in ("app.py", "__init__.py", "_private/a.py", ".hidden.py", ".git/hook.py", "a/.tool/b.py", "node_modules/x.js", "deep/er/z.c"):
        put(path)
    put("bad.py", b"a\xffb")
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "secret.py").write_text("no")
    os.symlink(tmp_path / "outside", tmp_path / "src" / "linked")
    os.symlink(tmp_path / "outside" / "secret.py", tmp_path / "src" / "link.py")
    os.symlink(tmp_path / "src", tmp_path / "src" / "cycle")
    found = tree.read_tree(spark, f"file:{tmp_path}/src")
    texts = {r.path: r.content for r in found.collect()}
    assert sorted(texts) == [".hidden.py", "__init__.py", "_private/a.py", "app.py", "bad.py", "deep/er/z.c"]
    assert texts["bad.py"] == "a�b" and texts["app.py"] == "x = 1\n"
    everything = tree.list_tree(spark, f"{tmp_path}/src", skip_dirs=False)
    assert {".git/hook.py", "a/.tool/b.py", "node_modules/x.js"} <= {r.path for r in everything.collect()}
    assert source_files(found).count() == 6
    with pytest.raises(ValueError):
        tree.list_tree(spark, "s3a://bucket/src")


def test_snapshot_is_a_frozen_copy(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "1"), (".faultgrain/x.py", "2"), ("b/.git/c", "3"), (".github/d", "4")], "path string, content string")
    frozen = snapshot.freeze(files, str(tmp_path), "s1")
    assert sorted((r.path, r.language) for r in frozen.collect()) == [(".github/d", None), ("a.py", "python")]
    plan = source_files(frozen).filter("language IN ('python')")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(language" in plan
    with pytest.raises(Exception, match="already exists"):
        snapshot.freeze(files, str(tmp_path), "s1")


REPORT = """# Proven bugs

## CWE-20: Improper Input Validation

| Bug | Function | File | Category | Description | Trigger | Probe | Evidence |
| --- | --- | --- | --- | --- | --- | --- | --- |
| 2 | beta | f4.c | math | what | how | probe_4 | k2 |

## CWE-369: Divide By Zero

| Bug | Function | File | Category | Description | Trigger | Probe | Evidence |
| --- | --- | --- | --- | --- | --- | --- | --- |
| 1 | main | f3.c | math | what | how | probe_3 | k1 |
| 3 | main | f6.c | math | what | how | probe_6 | k\\|3 |

## Not proven

| State | File | Function | Weakness | Attempts | Why |
| --- | --- | --- | --- | --- | --- |
| inconclusive | f2.c | main | CWE-369: Divide By Zero | 3 | no evidence |
| rejected | f1.c | main | CWE-369: Divide By Zero | 0 | clean, in two lines |
| rejected | f5.c | main | CWE-369: Divide By Zero | 0 |  |
"""


def text_of(folder):
    parts = sorted(p for p in os.listdir(folder) if p.startswith("part-"))
    return "".join(open(os.path.join(folder, p), encoding="utf-8").read() for p in parts)


def test_report(spark, tmp_path):
    rows = candidates(
        spark, (1, "rejected", "clean,\r\nin two lines", 0), (2, "inconclusive", "no evidence", 3), (3, "confirmed", None, 0),
        (4, "confirmed", None, 0), (5, "rejected", None, 0), (6, "confirmed", None, 0), (7, "pending", None, 0),
    )
    rows = rows.withColumn("cwe_id", F.when(F.col("id") == 4, 20).otherwise(F.col("cwe_id")))
    rows = rows.withColumn("function", F.when(F.col("id") == 4, "beta").otherwise(F.col("function")))
    bugs = spark.createDataFrame([(1, 3, "probe_3", "k1"), (2, 4, "probe_4", "k2"), (3, 6, "probe_6", "k|3")], CONFIRMED)
    sinks.write_report(report.report(bugs, rows.repartition(3)), str(tmp_path / "r"))
    assert text_of(tmp_path / "r") == REPORT


def test_empty_report(spark, tmp_path):
    none = spark.createDataFrame([], CONFIRMED)
    sinks.write_report(report.report(none, candidates(spark, (1, "pending", None, 0))), str(tmp_path / "r"))
    assert text_of(tmp_path / "r") == "# Proven bugs\n\nNothing was proven.\n\n"


def test_a_report_is_replaced_whole(spark, tmp_path):
    target = str(tmp_path / "report")
    one, none = candidates(spark, (1, "rejected", "old", 0)), spark.createDataFrame([], CONFIRMED)
    assert sinks.read_report(spark, target).count() == 0
    sinks.publish_report(report.report(none, one), target)
    first = [r.line for r in sinks.read_report(spark, target).orderBy("position").collect()]
    assert first[:3] == ["# Proven bugs", "", "Nothing was proven."] and any("old" in line for line in first)
    broken = report.report(none, one).withColumn("text", F.when(F.col("section") > 1, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        sinks.publish_report(broken, target)
    assert [r.line for r in sinks.read_report(spark, target).orderBy("position").collect()] == first
    many = candidates(spark, *((k, "rejected", f"new {k}", 0) for k in range(1, 60)))
    sinks.publish_report(report.report(none, many.repartition(4)), target)
    rows = sinks.read_report(spark, target).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == 9 + 59 - 1
    assert [r.line.split("new ")[1] for r in rows[8:]] == [f"{k} |" for k in sorted(range(1, 60), key=lambda k: f"f{k}.c")]
