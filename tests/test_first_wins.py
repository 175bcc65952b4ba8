from pyspark.sql import functions as F

from faultgrain.operators import first_wins
from faultgrain.operators.ids import assign_ids, next_id
from faultgrain.plans.skew import hot_keys, lookup
from faultgrain.schemas import CANDIDATES, EXPLORED

FINDING = "pos int, file string, function string, cwe_id int, bug_category string, description string, trigger string, status string"


def findings(spark, *rows):
    full = [(i, f, fn, cwe, cat, "d", "t", "pending") for i, (f, fn, cwe, cat) in enumerate(rows)]
    return spark.createDataFrame(full, FINDING)


def test_first_finding_per_key_wins(spark):
    batch = findings(
        spark, ("a", "f", 1, "first"), ("a", "f", 1, "second"), ("a", "f", 2, "x"), ("a", "g", 1, "x"), ("b", "f", 1, "x")
    )
    none = spark.createDataFrame([], CANDIDATES)
    new = first_wins.new_candidates(batch.repartition(4), none).orderBy("pos").collect()
    assert [r.pos for r in new] == [0, 2, 3, 4] and new[0].bug_category == "first"
    stored = assign_ids(first_wins.new_candidates(batch, none), ["file", "pos"])
    assert first_wins.new_candidates(batch, stored).count() == 0


def test_constraint_breakers_are_set_apart(spark):
    batch = findings(spark, ("a", "f", 1, "x"), (None, "f", 1, "x"), ("a", None, 1, "x"), ("a", "f", None, "x"))
    batch = batch.unionByName(findings(spark, ("z", "z", 1, "x")).withColumn("status", F.lit("odd")))
    accepted, refused = first_wins.split_by_constraints(batch)
    assert accepted.count() == 1
    assert sorted(r.violation for r in refused.collect()) == [
        "cwe_id is missing", "file is missing", "function is missing", "status is unknown",
    ]


def test_first_wins_cuts_a_hot_key_before_the_shuffle(spark):
    rows = spark.range(10_000).withColumn("key", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")))
    first = first_wins.first_per_key(rows, ["key"], ["id"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit [key") < plan.index("Exchange") < plan.rindex("WindowGroupLimit [key")
    assert first.count() == 3334


def test_latest_per_key(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "z")], "k int, step int, s string")
    got = first_wins.latest_per_key(rows, ["k"], ["step"]).orderBy("k").collect()
    assert [r.s for r in got] == ["c", "z"]


def test_explored_set(spark):
    explored = spark.createDataFrame([("a",)], EXPLORED)
    valid = spark.createDataFrame([("a",), ("b",), ("b",)], EXPLORED)
    assert [r.file for r in first_wins.mark_explored(explored, valid).collect()] == ["b"]


def test_ids_follow_the_order_for_any_partitioning(spark):
    rows = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("k"), F.lit("p").alias("p"))
    for parts in (1, 5):
        got = assign_ids(rows.repartition(parts), ["p", "k"], start=11).orderBy("id").collect()
        assert [(r.id, r.k) for r in got] == [(k + 11, k) for k in range(5_000)]
    none = assign_ids(rows.filter("k < 0"), ["k"])
    assert none.count() == 0 and next_id(none) == 1


def test_lookup_spreads_hot_keys(spark):
    fact = spark.range(9_000).select(F.when(F.col("id") < 6_000, 0).otherwise(F.col("id")).alias("k"), "id")
    dim = spark.range(0, 9_000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert [r.k for r in hot_keys(fact, ["k"], rows=1_000).collect()] == [0]
    plain = fact.join(dim, ["k"], "left")
    for how in ("left", "inner", "left_semi", "left_anti"):
        expected = fact.join(dim, ["k"], how)
        got = lookup(fact, dim, ["k"], ["id"], how, rows=1_000)
        assert got.columns == expected.columns
        assert sorted(got.collect()) == sorted(expected.collect()), how
    assert plain.count() == 9_000
