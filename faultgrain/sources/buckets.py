"""Folders of Parquet files dealt into buckets by key, read as what they are.

A join of such a folder with rows that are dealt alike moves nothing of the folder. Spark knows buckets only
from a table's definition, so each read and write names the folder as an external table for a moment.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def dealt(rows: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """``rows`` in as many partitions as there are buckets, each key in the bucket's place."""
    return rows.repartition(buckets, *keys)


def write_buckets(rows: DataFrame, folder: str, keys: Sequence[str], buckets: int) -> None:
    """Write ``rows`` to a new folder, at most one file a bucket."""
    name = f"bucketed_{uuid.uuid4().hex}"
    writer = dealt(rows, keys, buckets).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", folder).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # an external table: the files stay


def read_buckets(spark: SparkSession, folder: str, layout: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """The rows of such a folder; joins and groupings on ``keys`` in this order need no exchange of them."""
    name, by = f"bucketed_{uuid.uuid4().hex}", ", ".join(keys)
    place = folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({layout}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{place}'")
    rows = spark.table(name)
    rows.schema  # the files are listed here, so the name is needed no more
    spark.sql(f"DROP TABLE {name}")
    return rows
