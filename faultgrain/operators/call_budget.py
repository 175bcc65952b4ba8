"""Retry budgets replayed over a log of service calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Retries per kind of error; first wait and longest waits in seconds.
RATE_LIMIT_RETRIES = 10
TRANSIENT_RETRIES = 5
FIRST_WAIT = 5
RATE_LIMIT_WAIT_CAP = 300
TRANSIENT_WAIT_CAP = 60


def replay(
    calls: DataFrame,
    rate_limit_retries: int = RATE_LIMIT_RETRIES,
    transient_retries: int = TRANSIENT_RETRIES,
) -> DataFrame:
    """Where each request ended: outcome, calls made and seconds waited (without jitter).

    ``calls`` has request_id, seq and status (``ok``, an HTTP code, ``connection`` or
    ``timeout``). Rate limits and transient errors have separate budgets and double their
    wait up to a cap; any other client error ends the request at once. Every rule is the
    n-th call of a kind, so only the first n per kind leave the map side.
    """
    status = F.col("status")
    kind = (
        F.when(status == "ok", "ok")
        .when(status == "429", "rate_limited")
        .when(status.rlike("^4[0-9][0-9]$"), "rejected")
        .otherwise("transient")
    )
    budget = (
        F.when(F.col("kind") == "rate_limited", rate_limit_retries)
        .when(F.col("kind") == "transient", transient_retries)
        .otherwise(0)
    )
    cap = F.when(F.col("kind") == "rate_limited", RATE_LIMIT_WAIT_CAP).otherwise(TRANSIENT_WAIT_CAP)
    by_kind = Window.partitionBy("request_id", "kind").orderBy("seq")
    doubled = F.lit(FIRST_WAIT) * F.pow(F.lit(2), F.col("_rank") - 1)
    ranked = (
        calls.withColumn("kind", kind)
        .withColumn("_rank", F.row_number().over(by_kind))
        .filter(F.col("_rank") <= max(rate_limit_retries, transient_retries) + 1)
        .filter(F.col("_rank") <= budget + 1)
        .withColumn("_ends", F.col("_rank") == budget + 1)
        .withColumn("_wait", F.least(doubled, cap).cast("bigint"))
    )
    end_seq = F.when(F.col("_ends"), F.col("seq"))
    before_end = lambda call: F.col("_end").isNull() | (call.seq <= F.col("_end"))
    waits = F.filter("_calls", lambda call: before_end(call) & ~call.ends)
    return (
        # At most the two budgets and a few more calls are left per request.
        ranked.groupBy("request_id")
        .agg(
            F.min(end_seq).alias("_end"),
            F.min_by(F.when(F.col("_ends"), F.col("kind")), end_seq).alias("_kind"),
            F.collect_list(
                F.struct("seq", F.col("_wait").alias("wait"), F.col("_ends").alias("ends"))
            ).alias("_calls"),
        )
        .select(
            "request_id",
            F.when(F.col("_kind").isin("rate_limited", "transient"), F.concat("_kind", F.lit("_exhausted")))
            .otherwise(F.coalesce("_kind", F.lit("open")))
            .alias("outcome"),
            F.size(F.filter("_calls", before_end)).alias("calls"),
            F.aggregate(waits, F.lit(0).cast("bigint"), lambda total, call: total + call.wait).alias(
                "waited"
            ),
        )
    )
