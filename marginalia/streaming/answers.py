"""Requests and their results as two streams: what is answered, and what will not be any more."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marginalia.operators import batches
from marginalia.operators.keyed import last_per_key
from marginalia.settings import RESULT_TTL_DAYS

KEYS = ("batch_id", "custom_id")
EXPIRED = "batch expired"
DELAY = "0 seconds"
# Ids of the rows that only tell the time.
TICK = ""


def answered(requests: DataFrame, results: DataFrame, ttl_days: int = RESULT_TTL_DAYS, delay: str = DELAY) -> DataFrame:
    """Every result with its request as it comes, and every request without one at its own expiry.

    ``requests`` have ``submitted_at``, ``results`` ``answered_at``; both are streams. A left outer
    join over the two event times: once both streams have passed a request's expiry, it is given
    out without a result and its state is dropped, so state holds the requests of ``ttl_days`` only.
    Rows with the ids of ``TICK`` are the clock: they move a stream's time on when nothing else comes. They
    pass through, because a filter on them would be moved below the watermark; ``settled`` drops them.
    """
    asked = requests.withWatermark("submitted_at", delay)
    given = results.select(*(F.col(c).alias(f"_{c}") for c in results.columns)).withWatermark("_answered_at", delay)
    in_time = (F.col("_answered_at") >= F.col("submitted_at")) & (
        F.col("_answered_at") <= F.col("submitted_at") + F.expr(f"INTERVAL {ttl_days} DAYS")
    )
    same = [F.col(c) == F.col(f"_{c}") for c in KEYS]
    joined = asked.join(given, same[0] & same[1] & in_time, "leftOuter")
    extra = [c for c in results.columns if c not in (*KEYS, "answered_at")]
    return joined.select(*requests.columns, *(F.col(f"_{c}").alias(c) for c in extra), F.col("_custom_id").isNotNull().alias("answered"))


def settled(rows: DataFrame) -> DataFrame:
    """Stored rows of ``answered``, one per request: its last result, as ``analysis`` or ``error``."""
    last = last_per_key(rows.filter(F.col("custom_id") != TICK), list(KEYS), F.col("seq").desc_nulls_last())
    read = batches.classify_results(last)
    return read.withColumn("error", F.when(F.col("answered"), F.col("error")).otherwise(F.lit(EXPIRED))).drop("answered")
