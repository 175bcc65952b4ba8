import pytest

from faultgrain.operators.call_budget import replay
from faultgrain.schemas import CALLS


@pytest.mark.parametrize(
    "statuses, budgets, expected",
    [
        ("429 429 ok", {}, ("ok", 3, 15)),
        ("429 429 429 429", {"rate_limit_retries": 3}, ("rate_limited_exhausted", 4, 35)),
        ("500 ok", {}, ("ok", 2, 5)),
        ("503 503 503", {"transient_retries": 2}, ("transient_exhausted", 3, 15)),
        ("429 500 429 503 ok", {"rate_limit_retries": 2, "transient_retries": 2}, ("ok", 5, 30)),
        ("400 ok", {}, ("rejected", 1, 0)),
        ("connection timeout ok", {}, ("ok", 3, 15)),
        ("429 " * 10 + "ok", {}, ("ok", 11, 5 + 10 + 20 + 40 + 80 + 160 + 300 * 4)),
        ("500 " * 6, {}, ("transient_exhausted", 6, 5 + 10 + 20 + 40 + 60)),
        ("429 500", {}, ("open", 2, 10)),
        ("ok", {"rate_limit_retries": 0, "transient_retries": 0}, ("ok", 1, 0)),
        ("429 ok", {"rate_limit_retries": 0}, ("rate_limited_exhausted", 1, 0)),
    ],
)
def test_replay(spark, statuses, budgets, expected):
    calls = spark.createDataFrame([(1, seq, s) for seq, s in enumerate(statuses.split())], CALLS)
    (row,) = replay(calls, **budgets).collect()
    assert (row.outcome, row.calls, row.waited) == expected
