"""A Merkle manifest of a table: a tree of sha256 digests for each group of rows, and one above the groups.

Rows are numbered in their group by a range sort. Eight nodes hash to one, so 8^4 consecutive leaves, a
superblock, reduce to one node without any other row, and the nodes of superblocks to nodes of
superblocks of their own, until each group has one root; the groups' roots are the leaves of the last
tree. Then paths go down the same way: the nodes of a superblock and the siblings that its own node has
further up, the outer nodes, are cogrouped by superblock, where the local tree is reduced once more, each
node's siblings are joined with the outer ones and, at the leaves, the proof is hashed and a possibly
tampered leaf is folded up to the root. No task sees more than a superblock and its outer nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultgrain.llm.common import fresh
from faultgrain.session import materialize

FAN_OUT = 8
LEVELS = 4  # of a superblock

_NODES = "tree string, at long, total long, digest string"
_PATHS = "tree string, at long, lefts array<string>, rights array<string>, subroot string, root string"


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(columns: Sequence[str], values: dict[str, Column] | None = None) -> Column:
    """The digest of a row: each column as `-` if null, else its UTF-8 byte count, `:` and its value."""

    def part(name: str) -> Column:
        text = (values or {}).get(name, F.col(name)).cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(part, columns)), 256)


def _reduced(digests: list[str], total: int, levels: int) -> list[list[str]]:
    """A superblock's nodes and the levels above them: ``levels`` more, or as many as one node needs if it is the whole tree."""
    whole = total <= FAN_OUT**levels
    out = [digests]
    while len(out[-1]) > 1 if whole else len(out) <= levels:
        below = out[-1]
        out.append([digest_of(*below[i : i + FAN_OUT]) for i in range(0, len(below), FAN_OUT)])
    return out


def _blocked(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"at DIV {FAN_OUT**levels}"))


def _floors(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """``tree, at, total, digest`` -> itself and, floor by floor, the nodes of superblocks, down to one node a tree."""
    size = FAN_OUT**levels

    def summit(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("at")
        total = int(nodes["total"].iloc[0])
        top = _reduced(nodes["digest"].tolist(), total, levels)[-1][0]
        row = (nodes["tree"].iloc[0], int(nodes["at"].iloc[0]) // size, -(-total // size), top)
        return pd.DataFrame([row], columns=["tree", "at", "total", "digest"])

    floors = [leaves]
    most = leaves.agg(F.max("total")).first()[0] or 0
    while most > 1:
        below = _blocked(floors[-1].select("tree", "at", "total", "digest"), levels)
        floors.append(materialize(below.groupBy("tree", "block").applyInPandas(summit, _NODES), "floor"))
        most = -(-most // size)
    return floors


def _siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a node and of each node above it, in their runs."""
    lefts, rights = [], []
    for level in levels[:-1]:
        run = at - at % FAN_OUT
        lefts.append("".join(level[run:at]))
        rights.append("".join(level[at + 1 : run + FAN_OUT]))
        at //= FAN_OUT
    return lefts, rights


def fold(leaf: str, lefts: Sequence[str], rights: Sequence[str]) -> str:
    """The root that a leaf and its siblings give."""
    return reduce(lambda node, beside: digest_of(beside[0], node, beside[1]), zip(lefts, rights), leaf)


def _exchanged(nodes: DataFrame, outer: DataFrame, each: Callable, layout: str, levels: int) -> DataFrame:
    """The nodes of each superblock cogrouped with its own node's path; ``each`` makes their rows."""

    def finish(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("at", ignore_index=True)
        return each(own, _reduced(own["digest"].tolist(), int(own["total"].iloc[0]), levels), above.iloc[0])

    left = _blocked(nodes, levels).groupBy("tree", "block")
    right = outer.withColumnRenamed("at", "block").groupBy("tree", "block")
    return left.cogroup(right).applyInPandas(finish, layout)


def _path_rows(own: pd.DataFrame, levels: list[list[str]], path: pd.Series) -> pd.DataFrame:
    rows = []
    for place, at in enumerate(own["at"].tolist()):
        lefts, rights = _siblings(levels, place)
        rows.append((path["tree"], at, [*lefts, *path["lefts"]], [*rights, *path["rights"]], path["subroot"], path["root"]))
    return pd.DataFrame(rows, columns=["tree", "at", "lefts", "rights", "subroot", "root"])


def _proof_rows(own: pd.DataFrame, levels: list[list[str]], path: pd.Series) -> pd.DataFrame:
    outer = "".join(x + y for x, y in zip(path["lefts"], path["rights"]))
    proofs, folded = [], []
    for place, leaf in enumerate(own["tampered"].tolist()):
        lefts, rights = _siblings(levels, place)
        proofs.append(digest_of(*(x + y for x, y in zip(lefts, rights)), outer))
        folded.append(fold(leaf, [*lefts, *path["lefts"]], [*rights, *path["rights"]]))
    own = own[["key", "digest"]].rename(columns={"digest": "leaf"})
    return own.assign(subroot=path["subroot"], root=path["root"], proof_sha256=proofs, folded_root=folded)


def _numbered(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """``rows`` with ``at``, their place from 0 within ``tree`` by ``order``, and ``total``, their tree's size.

    Ties are broken by a hash of the row's place in the input, so that rows alike in everything spread over
    partitions too. The sorted rows are stored before they are counted, as sampled bounds may differ in a
    second run. Sizes are one row for each tree and partition it is in.
    """
    dealt = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    by = ["tree", *order, "_tie"]
    dealt = dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    dealt = materialize(dealt.withColumn("_row", F.monotonically_increasing_id()), label)
    dealt = dealt.withColumn("_part", F.shiftright("_row", 33))
    sizes = dealt.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "tree", "_part", "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("tree")).alias("total"),
    )
    placed = dealt.join(sizes, ["tree", "_part"])
    return placed.withColumn("at", F.col("_row") - F.col("_first") + F.col("_before")).drop("_row", "_part", "_first", "_before")


def _paths(floors: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """The paths of the nodes of the second floor, from those of the uppermost, one node a tree."""
    for nodes in reversed(floors[1:-1]):
        outer = materialize(_exchanged(nodes, outer, _path_rows, _PATHS, levels), "paths")
    return outer


def proofs(rows: DataFrame, group: str, order: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """Rows with ``leaf`` and ``tampered`` digests -> the columns of ``rows`` without these two, and ``leaf, subroot,
    root, proof_sha256, folded_root, verified``.

    A tree for each value of ``group`` (null is one) over its leaves by ``order`` (nulls first, ties by
    leaf); a tree over the groups' roots by group, null first, else UTF-8 bytewise. ``proof_sha256`` is the
    digest of a leaf's siblings up to the root, left to right in each level; ``folded_root`` is what the
    tampered leaf gives with them. Rows alike in everything are leaves of their own. An empty table gives no rows.
    """
    kept = [c for c in rows.columns if c not in ("leaf", "tampered")]
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    sorting = {f"order{n}": F.col(c) for n, c in enumerate(order)}
    keys = {f"kept{n}": F.col(c) for n, c in enumerate(kept)}
    leaves = rows.select(
        tree.alias("tree"), F.col("leaf").alias("digest"), "tampered", F.struct(*(c.alias(n) for n, c in keys.items())).alias("key"),
        *(c.alias(n) for n, c in sorting.items()),
    )
    # Stored first: the range sort reads its input twice, and the texts should be hashed once.
    leaves = materialize(leaves, "hashed")
    leaves = materialize(_numbered(leaves, [*sorting, "digest"], "leaves").drop(*sorting), "numbered")

    floors = _floors(leaves, levels)
    # One node a tree is left; these roots are numbered by group and are the leaves of the last tree.
    roots = floors[-1] if len(floors) > 1 else leaves.select("tree", "at", "total", "digest")
    upper = roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    upper = materialize(_numbered(upper, ["of"], "groups"), "groups")
    upper_floors = _floors(upper.select("tree", "at", "total", "digest"), levels)
    nothing = F.array().cast("array<string>")
    first = F.lit(0).cast("long").alias("at")
    top = upper_floors[-1].select(
        "tree", first, nothing.alias("lefts"), nothing.alias("rights"), F.lit("").alias("subroot"), F.col("digest").alias("root")
    )
    outer = top
    if len(upper_floors) > 1:
        outer = _exchanged(upper_floors[0], _paths(upper_floors, top, levels), _path_rows, _PATHS, levels)
    named = upper.select("at", "of", F.col("digest").alias("own"))
    outer = outer.join(named, "at").select(F.col("of").alias("tree"), first, "lefts", "rights", F.col("own").alias("subroot"), "root")
    outer = materialize(outer, "paths")

    key_type = leaves.schema["key"].dataType.simpleString()
    layout = f"key {key_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    done = _exchanged(leaves, _paths(floors, outer, levels), _proof_rows, layout, levels)
    named_columns = [F.col(f"key.{n}").alias(c) for n, c in zip(keys, kept)]
    digests = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    return done.select(*named_columns, *digests, (F.col("folded_root") == F.col("root")).alias("verified"))


def lowered(text: Column) -> Column:
    """Only A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "lang",
    order: Sequence[str] = ("doc_id",),
    tampered: dict[str, Column] | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """``order`` columns, ``leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs``.

    A leaf is the digest of ``columns``; all other columns of ``docs`` are left out. ``tampered`` has
    other values for some of them, from which ``folded_root`` is recomputed; without it every row verifies.
    Digests are hexadecimal text. See ``proofs`` for nulls, ties, repeated rows and empty tables.
    """
    leaf, other, of = fresh(docs, "leaf"), fresh(docs, "tampered"), fresh(docs, "group_of")
    rows = docs.withColumns({leaf: leaf_digest(columns), other: leaf_digest(columns, tampered), of: F.col(group)})
    rows = rows.select(*order, F.col(of).alias("__group"), F.col(leaf).alias("leaf"), F.col(other).alias("tampered"))
    return proofs(rows, "__group", order, levels).drop("__group")
