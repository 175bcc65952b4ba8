"""Insert-or-ignore: the first row per key wins, against the batch and the stored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultgrain import schemas
from faultgrain.sources.buckets import dealt


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The lowest row per key in ``order``.

    Spark turns the ``row_number`` filter into a group limit on the map side, so a key
    holding a third of all rows sends one row per map task through the shuffle.
    """
    by_key = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(by_key)).filter("_rank <= 1").drop("_rank")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The highest row per key in ``order``: a rewrite replaces the text before it."""
    by_key = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_rank", F.row_number().over(by_key)).filter("_rank <= 1").drop("_rank")


def not_in(rows: DataFrame, stored: DataFrame | Sequence[DataFrame], keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Rows whose key is not stored; of several stored runs, each unique on ``keys``, every one is probed in turn.

    ``buckets`` is the number of buckets in which the runs are stored by ``keys``: then the rows are dealt alike
    and no run is moved. Those probes are outer joins, as Spark would push an anti-join below the dealing.
    """
    if isinstance(stored, DataFrame):
        return rows.join(stored.select(*keys), list(keys), "left_anti")
    names = rows.columns
    if buckets:
        rows = dealt(rows, keys, buckets)
    for run in stored:
        rows = rows.join(run.select(*keys, F.lit(True).alias("_stored")), list(keys), "left").filter("_stored IS NULL")
        rows = rows.select(*names)
    return rows


def insert_or_ignore(
    batch: DataFrame,
    existing: DataFrame | Sequence[DataFrame],
    keys: Sequence[str],
    order: Sequence[str],
    buckets: int | None = None,
) -> DataFrame:
    """Rows of ``batch`` that are new: first per key and absent from ``existing``.

    Both join sides are unique on ``keys``, so no key is hot in the anti-join. ``buckets`` is the number of
    buckets in which ``existing`` is stored by ``keys``: then only the batch is exchanged.
    """
    return not_in(first_per_key(batch, keys, order), existing, keys, buckets)


def candidate_violation(required: Sequence[str]) -> Column:
    """Why a candidate row breaks the table's constraints, NULL when it does not."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required]
    if "status" in required:
        known = F.col("status").isin(*schemas.CANDIDATE_STATUSES)
        checks.append(F.when(~known, F.lit("status is unknown")))
    return F.coalesce(*checks)


CANDIDATE_REQUIRED = ("file", "function", "cwe_id", "bug_category", "description", "trigger", "status")


def split_by_constraints(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate rows a ledger accepts, and the ignored rest with the violation."""
    checked = rows.withColumn("violation", candidate_violation(CANDIDATE_REQUIRED))
    accepted = checked.filter(F.col("violation").isNull()).drop("violation")
    return accepted, checked.filter(F.col("violation").isNotNull())


CANDIDATE_KEY = ("file", "function", "cwe_id")


def new_candidates(
    batch: DataFrame,
    stored: DataFrame | Sequence[DataFrame],
    order: Sequence[str] = ("file", "pos"),
    buckets: int | None = None,
) -> DataFrame:
    """Accepted, new candidate rows. A reject reason or attempt count is not taken over."""
    accepted, _ = split_by_constraints(batch)
    accepted = accepted.withColumn("cwe_id", F.col("cwe_id").cast("int"))  # as it is stored, or its buckets do not fit
    return insert_or_ignore(accepted, stored, CANDIDATE_KEY, order, buckets).withColumns(
        {"reject_reason": F.lit(None).cast("string"), "verify_attempts": F.lit(0)}
    )


def mark_explored(explored: DataFrame | Sequence[DataFrame], valid: DataFrame, buckets: int | None = None) -> DataFrame:
    """Files to add to the explored set: answered validly, not in the set yet."""
    files = valid.select("file").distinct()
    return not_in(files, explored, ["file"], buckets)
