"""A lookup join that stays balanced when one key holds much of the fact side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it has more rows than one task should get and more than 1/HOT_SHARE of
# all rows, so there are fewer than HOT_SHARE hot keys whatever the data, and broadcasting
# them is safe.
HOT_ROWS = 200_000
HOT_SHARE = 1000


def hot_keys(fact: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS, share: int = HOT_SHARE) -> DataFrame:
    """The keys with more than ``rows`` rows and more than 1/``share`` of ``fact``, with their ``_salts``.

    A key gets as many salts as it fills tasks of ``rows`` rows. Counting pre-aggregates on the map side, so
    the hot keys themselves cost one row per map task in the shuffle. Rows with a null in a key never
    match and are left out.
    """
    matching = fact.dropna(subset=list(keys))
    counts = matching.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = matching.agg(F.count(F.lit(1))).scalar()
    hot = counts.filter((F.col("_n") > rows) & (F.col("_n") * share > total))
    return hot.select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias("_salts"))


def lookup(
    fact: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``fact`` to ``dim`` (unique on ``keys``) with hot keys spread over tasks.

    Rows of a hot key get one of its salts from a hash of their ``spread`` columns and the key's
    single ``dim`` row is repeated once per salt; every other key joins with salt 0. Rows of
    ``fact`` with a null in a key match nothing and are spread over all tasks.
    """
    hot = F.broadcast(hot_keys(fact, keys, rows))
    turn = F.xxhash64(*spread)
    missing = reduce(or_, (F.col(key).isNull() for key in keys))
    salt = F.when(missing, turn).otherwise(F.coalesce(F.pmod(turn, F.col("_salts").cast("long")), F.lit(0).cast("long")))
    salted_fact = fact.join(hot, list(keys), "left").withColumn("_salt", salt).drop("_salts")
    all_salts = F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))).cast("array<bigint>")
    salted_dim = (
        dim.join(hot, list(keys), "left")
        .withColumn("_salt", F.explode(all_salts))
        .drop("_salts")
    )
    return salted_fact.join(salted_dim, [*keys, "_salt"], how).drop("_salt")
