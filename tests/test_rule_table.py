"""Rules from a table against the plain rule."""

import random

from faultgrain.operators import rule_table
from faultgrain.operators.rule_table import first_rule_of_table


def plain(text, rules):
    for _, marker, value in sorted((r for r in rules if r[1] is not None), key=lambda r: (r[0], r[1], r[2])):
        if text is not None and marker in text:
            return value
    return None


def test_first_rule_of_a_table(spark):
    pick = random.Random(3)
    words = ["".join(pick.choices("abé ", k=pick.randint(1, 5))) for _ in range(300)]
    rules = [(n % 90, w, f"v{n}") for n, w in enumerate(words)] + [(500, "", "empty"), (3, None, "none"), (7, words[0], "again")]
    texts = ["".join(pick.choices("abcé xyz", k=pick.randint(0, 30))) for _ in range(200)] + [None, "", "zzz"]
    rows = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "id int, text string, marker string").repartition(3)
    table = spark.createDataFrame(rules, "ord int, marker string, value string").repartition(4)
    for few, block in ((rules, 1 << 20), (rules, 100), (rules[:40], 30)):
        own = table if few is rules else spark.createDataFrame(few, table.schema)
        got = first_rule_of_table(rows, own, block_bytes=block)
        assert got.columns == ["id", "text", "marker", "value"]
        assert {r.id: r.value for r in got.collect()} == {n: plain(t, few) for n, t in enumerate(texts)}


def test_no_rules_and_no_join_with_all_rules(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a")], "id int, text string")
    none = spark.createDataFrame([], "ord int, marker string, value string")
    assert [r.value for r in first_rule_of_table(rows, none).collect()] == [None, None]
    some = spark.createDataFrame([(1, "a", "v")], none.schema)
    plan = first_rule_of_table(rows, some)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_long_markers_and_texts_cut_anywhere(spark, monkeypatch):
    monkeypatch.setattr(rule_table, "LEAST_BLOCK", 1)
    pick = random.Random(8)
    long = ["".join(pick.choices("abé", k=k)) for k in (15, 16, 17, 31, 33, 40, 64, 70, 131)]
    rules = [(n, w[:cut], f"v{n}") for n, (w, cut) in enumerate((w, c) for w in long for c in (len(w), len(w) - 1, 9))]
    pick.shuffle(rules)
    texts = [("x" * pick.randint(0, 200)).join(pick.sample([*long, *(w[1:] for w in long), "", "é"], 3)) for _ in range(60)] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    table = spark.createDataFrame(rules, "ord int, marker string, value string")
    got = first_rule_of_table(rows, table, block_bytes=7)
    assert {r.id: r.value for r in got.collect()} == {n: plain(t, rules) for n, t in enumerate(texts)}


def test_ten_times_the_rules_read_the_texts_as_often(spark):
    """A rule table of many blocks is no chain of as many passes over the texts."""
    texts = spark.createDataFrame([(n, f"see f{n} there") for n in range(50)], "id int, text string")
    reads = []
    for many in (200, 2000):
        rules = spark.range(many).selectExpr("id AS ord", "concat('f', id) AS marker", "concat('v', id) AS value")
        got = first_rule_of_table(texts, rules, block_bytes=64)
        reads.append(got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        assert {r.id: r.value for r in got.collect()} == {n: plain(f"see f{n} there", [(k, f"f{k}", f"v{k}") for k in range(many)]) for n in range(50)}
    assert reads[0] == reads[1] <= 1
