import random

from pyspark.sql import functions as F

from faultgrain.functions.text import decode_utf8, line_count, not_blank, split_lines, strip

PIECES = ["a", "é", " ", "\t", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", " ", " ", "　", "\xa0", "𐐷"]


def test_lines_and_strip_agree_with_python(spark):
    rng = random.Random(7)
    texts = ["", "\n", "\n\n", "a\n", "\r\n", "\n\r", " \x85 "] + [
        "".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(500)
    ]
    text = F.col("t")
    rows = (
        spark.createDataFrame([(t,) for t in texts], "t string")
        .select("t", split_lines(text).alias("l"), line_count(text).alias("n"), strip(text).alias("s"), not_blank(text).alias("b"))
        .collect()
    )
    for row in rows:
        assert row.l == row.t.splitlines(), repr(row.t)
        assert row.n == len(row.t.splitlines()), repr(row.t)
        assert row.s == row.t.strip(), repr(row.t)
        assert row.b == bool(row.t.strip()), repr(row.t)


def test_decode_replaces_bad_bytes(spark):
    raw = [b"ok", b"a\xffb", b"\xe2\x82", b"\xc3\x28", "é".encode(), None]
    rows = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(raw)], "i int, b binary")
    got = [r.t for r in rows.select("i", decode_utf8(F.col("b")).alias("t")).orderBy("i").collect()]
    assert got == ["" if b is None else b.decode("utf-8", "replace") for b in raw]
