"""Line and substring dedup, license and secret scans against plain versions of their rules."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from faultgrain.llm import licenses, lines, queries, secrets, substrings

LAST = (1 << 63) - 1


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def as_id(doc):
    return LAST if doc is None else doc


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_substrings(rows):
    first = {}
    for doc, text in rows:
        w = words_of(text)
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, LAST), as_id(doc))
    out = []
    for doc, text in rows:
        w = words_of(text)
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < as_id(doc):
                gone.update(range(i, i + 13))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


@pytest.mark.parametrize("which", [0, 1])
def test_substrings(odd, tables, both, which):
    docs = [odd, tables("documents")][which]
    got = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert Counter(map(tuple, got)) == plain_substrings(both[which])


def test_substrings_in_small_slices(odd, both):
    spread = odd.repartition(9, "text")
    got = substrings.remove_repeats(spread, slice_bytes=200).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert Counter(map(tuple, got)) == plain_substrings(both[0])


def plain_lines(rows):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return re.sub("[A-Z]", lambda m: m.group().lower(), line)

    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(as_id(doc))
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        left = [x for x in own if len(holders[key(x)]) < 5 or max(holders[key(x)]) == as_id(doc)]
        out.append((doc, len(own), len(own) - len(left), "\n".join(left)))
    return Counter(out)


@pytest.mark.parametrize("which", [0, 1])
def test_lines(odd, tables, both, which):
    docs = [odd, tables("documents")][which]
    got = lines.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    want = plain_lines(both[which])
    assert Counter(map(tuple, got)) == want
    assert any(n for _, _, n, _ in want)


def test_lines_keep_all_columns(odd, both):
    got = lines.with_lines_dropped(odd)
    assert got.dtypes == odd.dtypes
    want = Counter((d, k if n else t) for (d, _, n, k), (_, t) in zip(plain_lines(both[0]).elements(), sorted_like(both[0])))
    assert sum(want.values()) == got.count()
    changed = got.filter("doc_id = 12").first()
    assert changed["text"] == "Aa\nBb" and changed["n_chars"] == 5 and changed["key"] == "x"
    assert got.filter("text IS NULL").count() == 1


def sorted_like(rows):
    return list(Counter(rows).elements())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    with duckdb.connect() as con:
        for table in ("documents", "pages"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        want = con.sql(queries.ORACLES[name])
        got = queries.QUERIES[name](spark, folder)
        assert sorted(got.columns) == sorted(want.columns)
        rows = sorted(map(tuple, got.select(*want.columns).collect()), key=repr)
        assert rows == sorted(want.fetchall(), key=repr)


def test_runs_over_batches(spark):
    runs, seen = lines.LineRuns(), set()
    for batch in range(9):
        rows = [(100 * batch + i, bytes([(batch * i) % 11])) for i in range(8)]
        new = lines.first_seen_lines(spark.createDataFrame(rows, "doc_id long, key binary"), runs)
        keys = {bytes(k) for _, k in rows}
        assert {bytes(r["key"]) for r in new.collect()} == keys - seen
        seen |= keys
    assert [len(level) for level in runs.levels] == [1, 2]
    table = runs.table()
    assert table.agg(F.sum("n_docs")).first()[0] == 72
    assert table.count() == len(seen)


def plain_licenses(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    starts, labels = [], set()
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += here
        labels |= {label} if here else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("which", [0, 1])
def test_licenses(odd, tables, both, which):
    got = licenses.scan([odd, tables("documents")][which]).collect()
    want = Counter((d, *plain_licenses(t)) for d, t in both[which])
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1.0 or not r["n_base"])


def test_license_templates(spark):
    texts = [
        "This work is licensed under the GNU General Public License, version 3.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of that software",
        "permission is hereby given free of charge to any person obtaining a copy of this software",
        "the mit license the mit under license",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], round(r["score"], 3)) for r in licenses.scan(docs).collect()}
    assert got == {0: ("gpl", 1.0), 1: ("mit", round(15 / 16, 3)), 2: ("", 0.0), 3: ("", 0.0)}


def test_each_place_of_a_license_counts_by_itself(spark):
    by_label = {t.label: t.words for t in licenses.MORE if t.key}
    mit, bsd = by_label["mit"], by_label["bsd"]
    key = "permission is hereby granted free of"
    texts = [f"{mit}. {key} all", f"{key} all. {mit}", f"{bsd} x " + "redistribution and use in source and binary forms x " * 2, f"{key} all"]
    texts.append(f"{mit.replace('software', 'work')} {key} all {mit}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [got[k]["labels"] for k in range(5)] == ["mit", "mit", "bsd", "", "mit"]
    assert [got[k]["score"] for k in range(5)] == [1.0, 1.0, 1.0, 6 / 16, 1.0]
    assert [[p["start"] for p in got[k]["places"]] for k in range(5)] == [[0], [7], [0], [], [0, 23]]


def plain_secrets(text):
    found = []
    text = text or ""
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)]


@pytest.mark.parametrize("which", [0, 1])
def test_secrets(odd, tables, both, which):
    got = secrets.scan([odd, tables("documents")][which]).collect()
    text_of = Counter()
    for r in got:
        spans = tuple(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] != "markov")
        text_of[(r["doc_id"], spans)] += 1
    assert text_of == Counter((d, tuple(plain_secrets(t))) for d, t in both[which])


def test_markov_models_find_random_tokens(spark, tables):
    import random

    pick = random.Random(3)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secret = ["".join(pick.choices(chars, k=32)) for _ in range(60)]
    rows = [(10_000 + i, f"The token = {s} is here") for i, s in enumerate(secret[:40])]
    rows += [(20_000 + i, f"Nothing but {s} is here") for i, s in enumerate(secret[40:])]
    docs = tables("documents").select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    hits = sum(any(s["kind"] == "markov" for s in got[20_000 + i]) for i in range(20))
    assert hits >= 19
    plain = [d for d in got if d < 10_000 and any(s["kind"] == "markov" for s in got[d])]
    assert len(plain) <= 0.02 * len(got)


@pytest.mark.parametrize("run", [substrings.remove_repeats, lines.drop_repeated_lines, lines.with_lines_dropped, licenses.scan, secrets.scan])
def test_empty_tables(empty, run):
    assert run(empty).collect() == []
