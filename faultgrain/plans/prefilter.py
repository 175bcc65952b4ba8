"""Dropping rows no join wants before they reach an exchange."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The filter is one value of so many 64-bit words: 8 MiB at most, whatever the data.
MOST_WORDS = 1 << 20
BITS_A_KEY = 24
BITS_SET = 4


def words_for(keys: int) -> int:
    """How many words a filter of so many keys has: a power of two, bounded."""
    return min(MOST_WORDS, 1 << max(4, math.ceil(math.log2(max(1, keys * BITS_A_KEY / 64)))))


def _mask(key: Column) -> Column:
    """The bits of a key in its word."""
    h = F.xxhash64(key, F.lit(1))
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * n).bitwiseAND(F.lit(63)).cast("int")) for n in range(BITS_SET)]
    out = masks[0]
    for mask in masks[1:]:
        out = out.bitwiseOR(mask)
    return out


def wanted_only(table: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """``table`` without most rows whose ``key`` is not in ``wanted``.

    A blocked Bloom filter inside the scan's stage, sized by the number of wanted keys: no wanted row is lost,
    and up to some three million keys less than one unwanted row in a hundred stays. Its size is bounded, so far
    beyond that more rows pass. An exact join has to follow.
    """
    keys = wanted.select(F.col(wanted_key).alias("key")).filter("key IS NOT NULL")
    size = words_for(keys.count())
    words = keys.select(F.pmod(F.xxhash64("key"), F.lit(size)).alias("word"), _mask(F.col("key")).alias("bits"))
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    every = wanted.sparkSession.range(size).withColumnRenamed("id", "word").join(words, "word", "left")
    # As many rows as the filter has words, at most.
    listed = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    bloom = every.agg(F.transform(listed, lambda w: w["bits"]).alias("bloom")).scalar()
    word = F.element_at(bloom, (F.pmod(F.xxhash64(key), F.lit(size)) + 1).cast("int"))
    mask = _mask(F.col(key))
    return table.filter(word.bitwiseAND(mask) == mask)
