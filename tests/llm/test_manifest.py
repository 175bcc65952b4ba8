"""The Merkle manifest against a plain tree."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from faultgrain.llm import manifest
from faultgrain.llm.oracles import manifest_sql

NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """(root, for each node its left and right siblings level by level)."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for i in range(0, len(nodes), 8):
            run = nodes[i : i + 8]
            for k in range(len(run)):
                for leaf in under[i + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha(*run))
            held.append([leaf for k in range(len(run)) for leaf in under[i + k]])
        nodes, under = above, held
    return nodes[0], paths


def plain_manifest(rows, every=3):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for doc, source, lang, n, text in rows:
        hit = doc is not None and zlib.crc32(str(doc).encode()) % every == 0
        lower = "".join(c.lower() if c.isascii() else c for c in text) if hit and text is not None else text
        groups[lang].append((doc, leaf_of((doc, source, lang, n, text)), leaf_of((doc, source, lang, n, lower))))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = climb([leaf for _, leaf, _ in groups[lang]])
    root, above = climb([trees[lang][0] for lang in langs]) if langs else ("", [])
    out = []
    for lang, outer in zip(langs, above):
        for (doc, leaf, other), own in zip(groups[lang], trees[lang][1]):
            path = own + outer
            folded = other
            for left, right in path:
                folded = sha(left, folded, right)
            out.append((doc, leaf, trees[lang][0], root, sha(*(x + y for x, y in path)), folded, folded == root))
    return Counter(out)


def of(docs, **options):
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(touched, manifest.lowered(F.col("text"))).otherwise(F.col("text"))
    got = manifest.manifest(docs, tampered={"text": text}, **options)
    assert got.columns == NAMES
    return Counter(map(tuple, got.collect()))


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_of_the_given_documents(tables, levels):
    docs = tables("documents")
    assert of(docs, levels=levels) == plain_manifest(rows_of(docs))


@pytest.mark.parametrize("levels", [1, 4])
def test_manifest_of_odd_rows(odd, spark, levels):
    more = "doc_id long, text string, lang string, source string, n_chars long"
    extra = [(i % 7, None if i % 5 == 0 else f"T{i % 3}", None if i % 4 == 0 else "", None, None) for i in range(60)]
    extra += [(1, "same", "é", "s", 4)] * 30 + [(None, "N", "zz", "s", 1), (3, "x", "only", "s", 1)]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", F.lit("x").alias("leaf"), F.lit("y").alias("tree"))
    docs = docs.unionByName(spark.createDataFrame(extra, more), allowMissingColumns=True).repartition(5)
    assert of(docs, levels=levels) == plain_manifest(rows_of(docs))


def test_many_groups_one_group_and_none(spark, empty):
    each = spark.range(150).selectExpr("id AS doc_id", "'a' AS source", "concat('l', id) AS lang", "1L AS n_chars", "'Text' AS text")
    assert of(each, levels=1) == plain_manifest(rows_of(each))
    lone = each.limit(1)
    got = of(lone)
    assert got == plain_manifest(rows_of(lone))
    assert all(r[1] == r[2] == r[3] and r[4] == sha() for r in got)
    assert of(empty) == Counter()


def test_sql_states_the_same(tables):
    docs = tables("documents")
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    got = con.sql(f"SELECT {', '.join(NAMES)} FROM ({manifest_sql(3, 5)})").fetchall()
    assert Counter(got) == plain_manifest(rows_of(docs))


def test_nothing_is_tampered_by_default(tables):
    assert manifest.manifest(tables("documents")).filter("NOT verified").count() == 0
