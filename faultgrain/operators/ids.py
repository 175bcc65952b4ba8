"""Surrogate ids in insert order, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.session import materialize


def next_id(table: DataFrame, column: str = "id") -> int:
    """One more than the largest id in ``table``; 1 for an empty table."""
    return (table.agg(F.max(column)).first()[0] or 0) + 1


def assign_ids(
    rows: DataFrame, order: Sequence[str], start: int = 1, column: str = "id"
) -> DataFrame:
    """Number ``rows`` from ``start`` in ``order`` (unique per row), gapless.

    Range partitioning orders the partitions, the rank inside a partition comes from
    its sort, and each partition's offset is the number of rows before it. The sampled
    range bounds may differ when a lost task runs again, so the ranked rows are written
    once before they are counted. The driver sees one count per partition.
    """
    ranked = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    ranked = materialize(ranked, "ranked")
    sizes = sorted(tuple(r) for r in ranked.groupBy("_part").count().collect())
    first_ids = accumulate((n for _, n in sizes), initial=start)
    offsets = rows.sparkSession.createDataFrame(
        [(part, first) for (part, _), first in zip(sizes, first_ids)], "_part int, _first long"
    )
    return (
        ranked.join(F.broadcast(offsets), "_part")
        .withColumn(column, F.col("_first") + F.col("_pos"))
        .drop("_part", "_pos", "_first")
    )
