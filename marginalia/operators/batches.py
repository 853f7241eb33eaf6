"""Two-phase scoring: requests, pending state, results, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions import dates, replies, text
from marginalia.operators.keyed import dense_ordinals, last_per_key
from marginalia.settings import RESULT_TTL_DAYS

TERMINAL = ("complete", "error", "cancelled")
NO_RESULT = "no result returned by provider"


def build_requests(
    items: DataFrame, hint: Column, order: list[str] | None = None, prefix: str = "item", limit: int | None = None
) -> DataFrame:
    """Items with ``custom_id`` and ``prompt``.

    By default the id is a hash of the item id and nothing is sorted. With ``order``
    (columns that end in a unique one, ``item_id``) ids are running numbers. Content is sent
    whole unless a ``limit`` is given.
    """
    prompt = text.analysis_prompt(F.col("content"), hint, limit)
    if order is None:
        return items.withColumns({"custom_id": text.hashed_id(F.col("item_id")), "prompt": prompt})
    keys = items.select(*dict.fromkeys([*order, "item_id"]))
    numbered = dense_ordinals(keys, order).select(
        "item_id", text.padded_id(prefix, F.col("ordinal")).alias("custom_id")
    )
    return items.withColumn("prompt", prompt).join(numbered, "item_id")


def without_pending(items: DataFrame, pending_items: DataFrame) -> DataFrame:
    """Items not waiting for a result already; a second submit must not repeat them."""
    return items.join(pending_items.select("item_id").distinct(), "item_id", "left_anti")


def live(batches: DataFrame, as_of: Column) -> DataFrame:
    return batches.filter(as_of < F.col("expires_at"))


def expired(batches: DataFrame, as_of: Column) -> DataFrame:
    return batches.filter(as_of >= F.col("expires_at"))


def pending_batch(batch_id: Column, pipeline: Column, submitted_at: Column, ttl: int = RESULT_TTL_DAYS) -> list[Column]:
    return [
        batch_id.alias("batch_id"),
        pipeline.alias("pipeline"),
        submitted_at.alias("submitted_at"),
        dates.expiry(submitted_at, ttl).alias("expires_at"),
    ]


def drop_batches(batches: DataFrame, finished: DataFrame) -> DataFrame:
    """Pending state without the given batches; unknown ids change nothing."""
    return batches.join(finished.select("batch_id"), "batch_id", "left_anti")


def classify_results(results: DataFrame) -> DataFrame:
    """Raw results with ``analysis`` or ``error``."""
    kind = F.col("type")
    return (
        results.withColumn("_reply", F.when(kind == "succeeded", replies.parse_reply(F.col("message"))))
        .withColumn(
            "error",
            F.when(kind == "succeeded", F.col("_reply.error"))
            .when(kind == "errored", F.concat(F.lit("API error: "), F.coalesce("error", F.lit("None"))))
            .otherwise(F.concat(F.lit("Request "), kind)),
        )
        .withColumn("analysis", F.col("_reply.analysis"))
        .drop("_reply")
    )


def last_results(results: DataFrame) -> DataFrame:
    """One result per request: the last one written."""
    return last_per_key(results, ["batch_id", "custom_id"], F.col("seq").desc())


def reconcile(pending_items: DataFrame, results: DataFrame) -> DataFrame:
    """Every pending item with its analysis, or with the reason why it has none.

    Replaced results are dropped before the replies are parsed, and the shuffle that
    finds the last result serves the join too.
    """
    found = classify_results(last_results(results)).select(
        "batch_id", "custom_id", "analysis", F.col("error").alias("_error"), F.lit(True).alias("_seen")
    )
    joined = pending_items.join(found, ["batch_id", "custom_id"], "left")
    error = F.when(F.col("_seen").isNull(), F.lit(NO_RESULT)).when(
        F.col("analysis").isNull(), F.coalesce("_error", F.lit("None"))
    )
    return joined.withColumn("error", error).drop("_error", "_seen")


def result_counts(results: DataFrame) -> DataFrame:
    """Per batch: how many requests ended in which state."""
    kinds = ("succeeded", "errored", "expired", "canceled")
    return last_results(results).groupBy("batch_id").agg(
        *(F.count_if(F.col("type") == kind).alias(kind) for kind in kinds)
    )


def batch_state(processing_status: Column) -> Column:
    """State of a batch from the provider's status and the counts of its requests."""
    none_ok = F.col("succeeded") == 0
    return (
        F.when(processing_status.isin("in_progress", "canceling"), F.lit("in_progress"))
        .when((F.col("canceled") > 0) & none_ok & (F.col("errored") == 0), F.lit("cancelled"))
        .when((F.col("errored") > 0) & none_ok, F.lit("error"))
        .otherwise(F.lit("complete"))
    )


def batch_status(batches: DataFrame, pending_items: DataFrame, results: DataFrame) -> DataFrame:
    """Pending batches (with the provider's ``processing_status``) and their live state.

    Only items and results of these batches are counted and ranked, not the whole history.
    """
    ids = batches.select("batch_id")
    items = pending_items.join(ids, "batch_id", "left_semi").groupBy("batch_id").agg(F.count("*").alias("items"))
    counts = result_counts(results.join(ids, "batch_id", "left_semi"))
    counted = batches.join(items, "batch_id", "left").join(counts, "batch_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("items", "succeeded", "errored", "expired", "canceled")}
    done = F.col("succeeded") + F.col("errored") + F.col("expired") + F.col("canceled")
    open_ = F.when(F.col("processing_status") == "ended", F.lit(0)).otherwise(F.col("items") - done)
    return (
        counted.withColumns(zero)
        .withColumn("total", done + open_)
        .withColumn("failed", F.col("errored") + F.col("expired"))
        .withColumn("state", batch_state(F.col("processing_status")))
        .withColumn("is_terminal", F.col("state").isin(*TERMINAL))
    )


def given_up(pending_items: DataFrame, status: DataFrame, expired_batches: DataFrame) -> DataFrame:
    """Items of batches that failed, were cancelled or expired, with ``error`` and ``stage``."""
    ended = status.filter(F.col("state").isin("error", "cancelled")).select("batch_id", "state")
    late = expired_batches.select("batch_id", F.lit("expired").alias("state"))
    lost = pending_items.join(ended.unionByName(late), "batch_id")
    return lost.withColumns({"error": F.concat(F.lit("batch "), "state"), "stage": F.lit("batch")}).drop("state")
