"""Checked queries: the same intake as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.catalog import inputs
from marginalia.catalog.inputs import BATCHES, MESSAGES, NEW_MESSAGES
from marginalia.catalog.registry import query
from marginalia.session import use_checkpoint_dir
from marginalia.streaming import answers, intake


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = inputs.table(spark, folder, "events").schema
    return intake.message_stream(spark, folder, schema, "events.parquet").select(
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"),
        F.col("event_type").alias("source"),
        F.col("ts").alias("internal_ts"),
    )


def _judged(spark: SparkSession, folder: str, output: str) -> DataFrame:
    """One output of all messages streamed once from the table files."""
    root = f"{use_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    bounds = inputs.message_bounds(spark, folder)
    stream = _stream(spark, folder)
    started = intake.incremental_stream(
        stream,
        bounds.select("name"),
        inputs.as_of(bounds),
        root,
        f"{root}/checkpoint",
        first_marks=inputs.sync_state(bounds),
    )
    started.awaitTermination()
    return spark.read.parquet(f"{root}/{output}").select("message_id", "source", "internal_ts")


@query("incremental_stream", f"WITH {NEW_MESSAGES} SELECT message_id, source, internal_ts FROM fresh")
def incremental_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Must equal the batch query."""
    return _judged(spark, folder, "items")


@query(
    "late_messages",
    f"""WITH {NEW_MESSAGES}
    SELECT message_id, source, internal_ts FROM messages
    WHERE source IN (SELECT name FROM cutoffs) AND message_id NOT IN (SELECT message_id FROM fresh)""",
)
def late_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that come after their source's mark has passed them."""
    return _judged(spark, folder, "late")


@query(
    "message_dedup",
    f"""WITH {MESSAGES}
    SELECT DISTINCT message_id, internal_ts FROM
      (SELECT message_id, internal_ts FROM messages UNION ALL SELECT message_id, internal_ts FROM messages)""",
)
def message_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every message delivered twice in a stream, kept once."""
    root = f"{use_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    delivered = _stream(spark, folder).unionByName(_stream(spark, folder))
    writer = intake.distinct_messages(delivered).writeStream.option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).format("parquet").start(f"{root}/distinct").awaitTermination()
    return spark.read.parquet(f"{root}/distinct").select("message_id", "internal_ts")


@query(
    "stream_answers",
    f"""WITH {BATCHES}
    SELECT batch_id, custom_id, CASE WHEN r.custom_id IS NULL THEN 'batch expired' ELSE r.error END AS error
    FROM pending_items p JOIN batches b USING (batch_id) LEFT JOIN last_results r USING (batch_id, custom_id)
    WHERE r.custom_id IS NOT NULL OR (SELECT as_of FROM clock) >= b.expires_at""",
)
def stream_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Requests and results as streams: answered ones reconciled, unanswered ones given out when they expire."""
    root = f"{use_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    now = inputs.as_of(inputs.message_bounds(spark, folder))
    clock = spark.range(1).select(now.cast("timestamp").alias("now")).first()["now"]
    submitted = inputs.batches(spark, folder, F.lit(clock)).select("batch_id", "submitted_at")
    asked = inputs.pending_items(spark, folder).join(submitted, "batch_id").select("batch_id", "custom_id", F.col("submitted_at").cast("timestamp"))
    raw = inputs.results(spark, folder).join(submitted, "batch_id")
    given = raw.select("batch_id", "custom_id", "type", "message", "error", "seq", (F.col("submitted_at") + F.expr("INTERVAL 1 DAY")).cast("timestamp").alias("answered_at"))
    tick = spark.range(1).select((F.lit(clock) + F.expr("INTERVAL 1 SECOND")).alias("at"))
    streams = []
    for name, rows, time in (("requests", asked, "submitted_at"), ("results", given, "answered_at")):
        own = {time: F.col("at"), "batch_id": F.lit(answers.TICK), "custom_id": F.lit(answers.TICK)}
        ticks = tick.select(*(own.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
        rows.unionByName(ticks).write.parquet(f"{root}/{name}")
        streams.append(intake.message_stream(spark, f"{root}/{name}", rows.schema))
    writer = answers.answered(*streams).writeStream.option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).format("parquet").start(f"{root}/answers").awaitTermination()
    return answers.settled(spark.read.parquet(f"{root}/answers")).select("batch_id", "custom_id", "error")
