"""Key tables in buckets, merged folders and ids that stand in the manifest."""

import re

import pytest
from pyspark.sql import functions as F

from faultgrain.operators import first_wins, lifecycle
from faultgrain.operators.ids import assign_ids
from faultgrain.schemas import CANDIDATES
from faultgrain.sources.buckets import read_buckets, write_buckets
from faultgrain.sources.ledger import Ledger

KEYS = ["file", "function", "cwe_id"]


def findings(spark, low, high):
    return spark.range(low, high).selectExpr(
        "concat('f', id % 97, '.c') AS file", "concat('g', id DIV 97) AS function", "CAST(20 + id % 3 AS INT) AS cwe_id", "'x' AS bug_category",
        "'d' AS description", "'t' AS trigger", "'pending' AS status", "id AS pos",
    )


def insert(ledger, offered):
    new = first_wins.new_candidates(offered, ledger.runs("candidate_keys"), buckets=ledger.buckets)
    new = assign_ids(new, ["file", "pos"], start=ledger.next_id("open"))
    ledger.commit(append={"open": new})


@pytest.fixture
def plain_plans(spark):
    """Plans as they are made, without broadcasts or changes while they run."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(name) for name in names]
    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "false")
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def exchanges(df):
    """How many exchanges a plan has, and which of its scans read buckets."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\bExchange ", plan)), re.findall(r"Bucketed: (\w+)", plan)


def test_a_batch_moves_nothing_that_is_stored(spark, tmp_path, plain_plans):
    ledger = Ledger(spark, str(tmp_path), buckets=5)
    for n in range(3):
        insert(ledger, findings(spark, 1000 * n, 1000 * n + 1200))
    new = first_wins.new_candidates(findings(spark, 2900, 3400), ledger.runs("candidate_keys"), buckets=ledger.buckets)
    # Two exchanges of the batch: its first rows by key, then into buckets.
    assert exchanges(new) == (2, ["true"] * 3)
    assert new.count() == 200
    other = Ledger(spark, str(tmp_path), buckets=7)
    assert first_wins.new_candidates(findings(spark, 2900, 3400), other.runs("candidate_keys"), buckets=7).count() == 200


def test_fifty_batches_leave_few_folders(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), buckets=2)
    old = None
    for n in range(50):
        rows = spark.range(5 * n, 5 * n + 5, numPartitions=1).selectExpr("concat('f', id) AS file")
        if n % 10 == 9:  # with the five before, which are there
            more = spark.range(5 * n - 5, 5 * n + 5, numPartitions=1).selectExpr("concat('f', id) AS file")
            rows = first_wins.mark_explored(ledger.runs("explored"), more, ledger.buckets)
        ledger.commit(append={"explored": rows})
        if n == 10:
            old = ledger.read("explored")
    assert sorted(r.file for r in ledger.read("explored").collect()) == sorted(f"f{i}" for i in range(250))
    assert len(ledger.folders("explored")) <= 9 and ledger.version == 50
    assert old.count() == 55  # folders that were merged since can still be read


def test_ids_go_on_without_reading_candidates(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), buckets=3)
    insert(ledger, findings(spark, 0, 30))
    insert(ledger, findings(spark, 0, 30))
    assert ledger.next_id("open") == 31 and ledger.next_id("confirmed") == 1
    ledger.commit(replace={"open": ledger.read("open").filter("id < 5")})
    insert(ledger, findings(spark, 10, 35))
    ids = sorted(r.id for r in ledger.candidates().collect())
    assert ids == [1, 2, 3, 4, 31, 32, 33, 34, 35] and ledger.next_id("open") == 36


def test_settled_candidates_stay_taken(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), buckets=3)
    insert(ledger, findings(spark, 0, 10))
    ledger.commit(append={"closed": ledger.read("open")}, replace={"open": spark.createDataFrame([], CANDIDATES)})
    insert(ledger, findings(spark, 5, 12))
    assert ledger.read("open").count() == 2 and ledger.candidates().count() == 12


def test_confirm_against_runs_equals_confirm_against_one_table(spark, tmp_path):
    proven = spark.range(300).selectExpr(
        "id % 61 AS candidate_id", "CAST(id DIV 61 AS INT) AS run_id", "concat('p', id) AS probe_path", "concat('k', id % 40) AS evidence_key"
    )
    stored = spark.range(30).selectExpr("id + 1 AS id", "id AS candidate_id", "'p' AS probe_path", "concat('k', id * 3) AS evidence_key")
    ledger = Ledger(spark, str(tmp_path), buckets=4)
    for part in range(3):
        ledger.commit(append={"confirmed": stored.filter(F.col("id") % 3 == part)})
    bugs, resolved = lifecycle.confirm(proven, stored)
    again = lifecycle.confirm(proven, ledger.runs("evidence_keys"), ledger.next_id("confirmed"), ledger.buckets)
    assert sorted(bugs.collect()) == sorted(again[0].collect()) and bugs.count() == 40 - 14
    assert sorted(map(str, resolved.select(sorted(resolved.columns)).collect())) == sorted(
        map(str, again[1].select(sorted(again[1].columns)).collect())
    )
    assert lifecycle.confirm(proven, [])[0].count() == 40


def test_buckets_round_trip(spark, tmp_path):
    rows = spark.range(1000).selectExpr("CAST(id % 300 AS INT) AS k", "CASE WHEN id % 7 > 0 THEN concat('v', id) END AS v")
    folder = f"{tmp_path}/it's here"
    write_buckets(rows, folder, ["k"], 6)
    back = read_buckets(spark, folder, "k INT, v STRING", ["k"], 6)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
