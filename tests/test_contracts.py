import json
import random

import pytest

from faultgrain.functions.weakness import WEAKNESS_IDS
from faultgrain.operators import contracts

ISSUE = {"function": "average", "cwe_id": 369, "bug_category": "arith", "description": "empty", "trigger": "[]"}


def judge(spark, how, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return how(rows).orderBy("i").collect()


CASES = [
    (json.dumps([ISSUE]), True),
    ("[]", True),
    ("  []\n", True),
    (f"```json\n{json.dumps([ISSUE])}\n```", True),
    (f"prose {json.dumps([ISSUE])} more {{ prose", True),
    ("[" + json.dumps(ISSUE), False),
    ("[] []", False),
    ('"[] in a string"', False),
    ("12", False),
    ("null", False),
    ("not json", False),
    (None, False),
    ("", False),
    ("{}", False),
    (json.dumps({"issues": [ISSUE]}), False),
    (json.dumps([ISSUE, {**ISSUE, "extra": 1}]), False),
    (json.dumps([{k: v for k, v in ISSUE.items() if k != "trigger"}]), False),
    (json.dumps([ISSUE, 5]), False),
    (json.dumps([[]]), False),
    *((json.dumps([{**ISSUE, "cwe_id": bad}]), False) for bad in (9999, 369.0, True, "369", None, [369], 10**30)),
    *((json.dumps([{**ISSUE, key: bad}]), False) for key in ("function", "trigger") for bad in ("", " \t", " ", 5, None)),
    (json.dumps([{**ISSUE, "function": "  padded "}]), True),
    ('[{"function":"a","function":"b","cwe_id":20,"bug_category":"c","description":"d","trigger":"e"}]', True),
    ('[{"function":NaN,"cwe_id":20,"bug_category":"c","description":"d","trigger":"e"}]', False),
    ("[" * 5000, False),
    ("[" + "1" * 5000 + "]", False),
]


def test_issue_reports(spark):
    rows = judge(spark, contracts.judge_issues, [text for text, _ in CASES])
    assert [r.ok for r in rows] == [ok for _, ok in CASES]
    assert all((r.error is None) == r.ok for r in rows)


def test_issues_become_rows(spark):
    second = {**ISSUE, "function": " two ", "cwe_id": 20}
    texts = [("a.py", json.dumps([ISSUE, second])), ("b.py", "[]"), ("c.py", "oops")]
    judged = contracts.judge_issues(spark.createDataFrame(texts, "file string, text string"))
    rows = contracts.explode_issues(judged).orderBy("file", "pos").collect()
    assert [(r.file, r.pos, r.function, r.cwe_id, r.status) for r in rows] == [
        ("a.py", 0, "average", 369, "pending"), ("a.py", 1, " two ", 20, "pending"),
    ]


def plain_issue_check(text):
    """The contract spelled out over Python values."""
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return isinstance(value, list) and all(
        isinstance(v, dict) and sorted(v) == sorted(ISSUE) and type(v["cwe_id"]) is int and v["cwe_id"] in WEAKNESS_IDS
        and all(isinstance(v[k], str) and v[k].strip() for k in ISSUE if k != "cwe_id")
        for v in value
    )


def test_random_reports_agree_with_a_plain_check(spark):
    rng = random.Random(5)
    values = ["x", "", " ", 20, 79, 79.0, 1, True, None, [], {}, "é\n", "\x85", 2**70]

    def item():
        made = {k: rng.choice(values) if rng.random() < 0.1 else v for k, v in ISSUE.items()}
        if rng.random() < 0.1:
            made[rng.choice(["extra", "Function"])] = 1
        if rng.random() < 0.1:
            made.pop(rng.choice(list(made)))
        return made

    texts = [json.dumps([item() for _ in range(rng.randint(0, 3))], ensure_ascii=rng.random() < 0.5) for _ in range(400)]
    rows = judge(spark, contracts.judge_issues, texts)
    assert [r.ok for r in rows] == [plain_issue_check(t) for t in texts]


SCRIPT = "print('PROBE_SETUP_OK'); print('PROBE_REACHED')"
PROBES = [
    ({"interpreter": ["python3"], "script": SCRIPT}, "probe"),
    ({"refuse": True, "reason": "needs hardware"}, "refusal"),
    ({"refuse": False, "reason": "x"}, "invalid"),
    ({"refuse": "true", "reason": "x"}, "invalid"),
    ({"refuse": True, "reason": " "}, "invalid"),
    ({"refuse": True, "reason": None}, "invalid"),
    ({"refuse": True}, "invalid"),
    ({"refuse": True, "reason": "x", "script": SCRIPT}, "invalid"),
    ({"interpreter": [], "script": SCRIPT}, "invalid"),
    ({"interpreter": ["a", ""], "script": SCRIPT}, "invalid"),
    ({"interpreter": ["a", 1], "script": SCRIPT}, "invalid"),
    ({"interpreter": "sh", "script": SCRIPT}, "invalid"),
    ({"interpreter": [" "], "script": SCRIPT}, "probe"),
    ({"interpreter": ["sh"], "script": "PROBE_SETUP_OK"}, "invalid"),
    ({"interpreter": ["sh"], "script": "PROBE_REACHED"}, "invalid"),
    ({"interpreter": ["sh"], "script": 5}, "invalid"),
    ({"interpreter": ["sh"], "script": " "}, "invalid"),
    ([SCRIPT], "invalid"),
]


def test_probes(spark):
    rows = judge(spark, contracts.judge_probes, [json.dumps(v) for v, _ in PROBES])
    assert [r.kind for r in rows] == [kind for _, kind in PROBES]
    assert (rows[0].interpreter, rows[0].script, rows[1].reason) == (["python3"], SCRIPT, "needs hardware")


@pytest.mark.parametrize(
    "text, kind, feedback",
    [
        ('{"verdict":"ok","feedback":""}', "audit_ok", ""),
        ('{"verdict":"invalid","feedback":"why"}', "audit_invalid", "why"),
        ('{"verdict":"invalid","feedback":" "}', "audit_unavailable", None),
        ('{"verdict":"OK","feedback":""}', "audit_unavailable", None),
        ('{"verdict":["ok"],"feedback":""}', "audit_unavailable", None),
        ('{"verdict":"ok","feedback":null}', "audit_unavailable", None),
        ('{"verdict":"ok"}', "audit_unavailable", None),
        ("looks fine", "audit_unavailable", None),
    ],
)
def test_audits(spark, text, kind, feedback):
    (row,) = judge(spark, contracts.judge_audits, [text])
    assert (row.audit_kind, row.feedback) == (kind, feedback)
