"""Checked queries: two-phase scoring, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.catalog import inputs
from marginalia.catalog.inputs import BATCHES, CUTOFFS, ITEMS, NEW_MESSAGES
from marginalia.catalog.intake import SCORED, fresh_messages, scored_messages
from marginalia.catalog.registry import query
from marginalia.operators import batches, report


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return fresh_messages(spark, folder).select(
        F.col("message_id").alias("item_id"), "source", "internal_ts", F.col("subject").alias("content")
    )


@query(
    "batch_requests",
    f"""WITH {NEW_MESSAGES},
    numbered AS (SELECT *, row_number() OVER (ORDER BY source, internal_ts, message_id) - 1 AS n FROM fresh)
    SELECT message_id AS item_id, 'item' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END
           AS custom_id,
           md5('Content source hint: ' || source || chr(10) || 'Analyze the following content:' || chr(10) || chr(10)
               || subject) AS prompt_md5
    FROM numbered""",
)
def batch_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Running request numbers over (source, oldest first)."""
    built = batches.build_requests(
        _requests(spark, folder), F.col("source"), order=["source", "internal_ts", "item_id"]
    )
    return built.select("item_id", "custom_id", F.md5("prompt").alias("prompt_md5"))


@query(
    "batch_requests_hashed",
    f"WITH {NEW_MESSAGES} SELECT message_id AS item_id, sha256(message_id) AS custom_id FROM fresh",
)
def batch_requests_hashed(spark: SparkSession, folder: str) -> DataFrame:
    """Request ids that need no order."""
    built = batches.build_requests(_requests(spark, folder), F.col("source"))
    return built.select("item_id", "custom_id")


@query(
    "submit_new_only",
    f"""WITH {NEW_MESSAGES}, waiting AS (SELECT message_id FROM messages WHERE value > 20)
    SELECT message_id AS item_id, source FROM fresh WHERE message_id NOT IN (SELECT message_id FROM waiting)""",
)
def submit_new_only(spark: SparkSession, folder: str) -> DataFrame:
    """Items already waiting for a result are not submitted again."""
    waiting = inputs.messages(spark, folder).filter("value > 20").select(F.col("message_id").alias("item_id"))
    return batches.without_pending(_requests(spark, folder), waiting).select("item_id", "source")


@query(
    "result_rows",
    f"""WITH {BATCHES}
    SELECT batch_id, custom_id, seq, type, error,
           CASE WHEN error IS NULL THEN 'quality/' || quality END AS tag FROM classified""",
)
def result_rows(spark: SparkSession, folder: str) -> DataFrame:
    return batches.classify_results(inputs.results(spark, folder)).select(
        "batch_id", "custom_id", "seq", "type", "error", F.col("analysis.tags")[0].alias("tag")
    )


@query("results_dedup", f"WITH {BATCHES} SELECT batch_id, custom_id, seq, type FROM last_results")
def results_dedup(spark: SparkSession, folder: str) -> DataFrame:
    narrow = inputs.results(spark, folder).select("batch_id", "custom_id", "seq", "type")
    return batches.last_results(narrow)


@query("batch_reconcile", f"WITH {BATCHES} SELECT batch_id, custom_id, title, error FROM reconciled")
def batch_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    return reconciled(spark, folder).select("batch_id", "custom_id", "title", "error")


def reconciled(spark: SparkSession, folder: str) -> DataFrame:
    return batches.reconcile(inputs.pending_items(spark, folder), inputs.results(spark, folder))


def _clock(spark: SparkSession, folder: str) -> F.Column:
    return inputs.as_of(inputs.message_bounds(spark, folder))


def status(spark: SparkSession, folder: str) -> DataFrame:
    return batches.batch_status(
        inputs.batches(spark, folder, _clock(spark, folder)),
        inputs.pending_items(spark, folder),
        inputs.results(spark, folder),
    )


@query(
    "batch_status",
    f"""WITH {BATCHES}
    SELECT batch_id, pipeline, state, total, succeeded, failed,
           state IN ('complete', 'error', 'cancelled') AS is_terminal FROM status""",
)
def batch_status(spark: SparkSession, folder: str) -> DataFrame:
    return status(spark, folder).select(
        "batch_id", "pipeline", "state", "total", "succeeded", "failed", "is_terminal"
    )


@query(
    "batch_listing",
    f"""WITH {BATCHES}
    SELECT pipeline, count(*) AS batches, sum(items)::BIGINT AS items,
           count(*) FILTER (state <> 'in_progress') AS finalized,
           count(*) FILTER (state = 'in_progress') AS still_pending
    FROM status WHERE (SELECT as_of FROM clock) < expires_at GROUP BY pipeline""",
)
def batch_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Live batches per pipeline, with their items and how many can be finalized."""
    return (
        batches.live(status(spark, folder), _clock(spark, folder))
        .groupBy("pipeline")
        .agg(
            F.count("*").alias("batches"),
            F.sum("items").alias("items"),
            F.count_if("is_terminal").alias("finalized"),
            F.count_if(~F.col("is_terminal")).alias("still_pending"),
        )
    )


@query(
    "pending_live",
    f"""WITH {BATCHES}
    SELECT batch_id, submitted_at, expires_at, (SELECT as_of FROM clock) >= expires_at AS expired FROM batches""",
)
def pending_live(spark: SparkSession, folder: str) -> DataFrame:
    now = _clock(spark, folder)
    all_batches = inputs.batches(spark, folder, now)
    kept = batches.live(all_batches, now).withColumn("expired", F.lit(False))
    gone = batches.expired(all_batches, now).withColumn("expired", F.lit(True))
    return kept.unionByName(gone).select("batch_id", "submitted_at", "expires_at", "expired")


@query(
    "batch_finalize",
    f"""WITH {BATCHES}
    SELECT r.pipeline, count(*) FILTER (r.error IS NULL) AS created, count(*) FILTER (r.error IS NOT NULL) AS errors
    FROM reconciled r JOIN status s USING (batch_id)
    WHERE s.state = 'complete' AND (SELECT as_of FROM clock) < s.expires_at GROUP BY r.pipeline""",
)
def batch_finalize(spark: SparkSession, folder: str) -> DataFrame:
    """Complete live batches reconciled, counted per pipeline they are routed to."""
    ready = batches.live(status(spark, folder), _clock(spark, folder)).filter("state = 'complete'")
    rows = reconciled(spark, folder).join(ready.select("batch_id", "pipeline"), "batch_id")
    return rows.groupBy("pipeline").agg(
        F.count_if(F.col("error").isNull()).alias("created"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


@query(
    "pending_after_finalize",
    f"""WITH {BATCHES}
    SELECT batch_id, pipeline FROM status
    WHERE state = 'in_progress' AND (SELECT as_of FROM clock) < expires_at""",
)
def pending_after_finalize(spark: SparkSession, folder: str) -> DataFrame:
    """Live batches without those that ended in any state."""
    current = status(spark, folder)
    kept = batches.live(current, _clock(spark, folder)).select("batch_id", "pipeline")
    return batches.drop_batches(kept, current.filter("is_terminal"))


@query(
    "batch_dead_letters",
    f"""WITH {BATCHES},
    ended AS (
      SELECT batch_id, state FROM status
      WHERE state IN ('error', 'cancelled') AND (SELECT as_of FROM clock) < expires_at
      UNION ALL
      SELECT batch_id, 'expired' FROM batches WHERE (SELECT as_of FROM clock) >= expires_at)
    SELECT p.batch_id, p.custom_id, 'batch ' || e.state AS error FROM pending_items p JOIN ended e USING (batch_id)""",
)
def batch_dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Items of batches that ended without results or were not fetched in time."""
    clock = _clock(spark, folder)
    current = batches.live(status(spark, folder), clock)
    late = batches.expired(inputs.batches(spark, folder, clock), clock)
    lost = batches.given_up(inputs.pending_items(spark, folder), current, late)
    return lost.select("batch_id", "custom_id", "error")


@query(
    "run_report",
    f"""WITH {SCORED}
    SELECT 'newsletters' AS pipeline, count(*) AS items_processed, count(*) FILTER (error IS NULL) AS items_created,
           0::BIGINT AS items_skipped, count(*) FILTER (error IS NOT NULL) AS errors FROM scored
    UNION ALL
    SELECT 'inbox (batch)', count(*), count(*) FILTER (error IS NULL), 0, count(*) FILTER (error IS NOT NULL)
    FROM (WITH {BATCHES} SELECT * FROM reconciled)""",
)
def run_report(spark: SparkSession, folder: str) -> DataFrame:
    letters = report.run_report(scored_messages(spark, folder), "newsletters")
    return letters.unionByName(report.run_report(reconciled(spark, folder), "inbox", batch=True))


@query(
    "run_errors",
    f"""WITH {SCORED},
    letters AS (
      SELECT 0 AS run, source, internal_ts::TIMESTAMP AS moment, message_id AS id, '[' || source || '] ' || title || ': ' || error AS message
      FROM scored WHERE error IS NOT NULL
      UNION ALL
      SELECT 1, '', NULL, batch_id || '/' || custom_id, coalesce(title, '') || ': ' || error
      FROM (WITH {BATCHES} SELECT * FROM reconciled) WHERE error IS NOT NULL)
    SELECT row_number() OVER (ORDER BY run, source, moment NULLS FIRST, id) AS position, message FROM letters""",
)
def run_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Every error of two runs as a row, in the order of their processing; nothing is gathered into one list."""
    own = scored_messages(spark, folder).withColumn("id", F.col("message_id"))
    letters = report.dead_letters(own, F.lit("score"), "newsletters", ["source", F.col("internal_ts").cast("timestamp").alias("moment"), "id"])
    late = reconciled(spark, folder).withColumn("id", F.concat_ws("/", "batch_id", "custom_id"))
    inbox = report.dead_letters(late, F.lit("reconcile"), "inbox", [F.lit("").alias("source"), F.lit(None).cast("timestamp").alias("moment"), "id"])
    both = letters.withColumn("run", F.lit(0)).unionByName(inbox.withColumn("run", F.lit(1)))
    return report.in_order(both, ["run", "source", "moment", "id"]).select("position", "message")


@query(
    "dead_letters",
    f"""WITH {SCORED}
    SELECT message_id, source, internal_ts, 'score' AS stage, error FROM scored WHERE error IS NOT NULL""",
)
def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    failed = report.dead_letters(
        scored_messages(spark, folder), F.lit("score"), "newsletters", ["message_id", "source", "internal_ts"]
    )
    return failed.drop("message", "attempt")


@query(
    "created_per_source",
    f"WITH {SCORED} SELECT source, count(*) FILTER (error IS NULL) AS created FROM scored GROUP BY source",
)
def created_per_source(spark: SparkSession, folder: str) -> DataFrame:
    return report.created_per_source(scored_messages(spark, folder))
