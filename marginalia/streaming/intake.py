"""Messages as a stream: one mark per source, each micro-batch judged by the mark before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from marginalia import schemas
from marginalia.operators import incremental
from marginalia.settings import LOOKBACK_DAYS
from marginalia.sources import state


def message_stream(
    spark: SparkSession, folder: str, schema: StructType, files: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def incremental_stream(
    messages: DataFrame,
    sources: DataFrame,
    as_of: F.Column,
    state_root: str,
    checkpoint: str,
    lookback_days: int = LOOKBACK_DAYS,
    first_marks: DataFrame | None = None,
    emit: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Append new messages to ``items``, late ones to ``late``, and advance the marks.

    A global event-time watermark would drop rows of slow sources, so the marks are a
    small table joined to each micro-batch: no per-source task, however large one source
    is. Folders are named after the micro-batch, so a repeated micro-batch replaces its
    own output and starts from the marks it saw the first time.
    """
    spark = messages.sparkSession

    def marks_before(batch: int) -> DataFrame:
        if batch > 0:
            return spark.read.schema(schemas.SYNC_STATE).parquet(f"{state_root}/marks/batch={batch - 1}")
        if first_marks is not None:
            return first_marks
        return spark.createDataFrame([], schemas.SYNC_STATE)

    def handle(rows: DataFrame, batch: int) -> None:
        marks = marks_before(batch)
        cutoffs = incremental.source_cutoffs(sources, marks, as_of, lookback_days)
        judged = rows.join(cutoffs.withColumnRenamed("name", "source"), "source").withColumn(
            "_new", incremental.is_new(F.col("internal_ts"))
        )
        # Judged once; both outputs and the marks read the kept rows.
        shown = judged.drop("last_sync", "search_from").persist()
        fresh = shown.filter("_new").drop("_new")
        fresh.write.mode("overwrite").parquet(f"{state_root}/items/batch={batch}")
        shown.filter("NOT _new").drop("_new").write.mode("overwrite").parquet(f"{state_root}/late/batch={batch}")
        if emit:
            emit(fresh, batch)
        advanced = incremental.advance_marks(marks, incremental.new_marks(fresh, F.lit(True)))
        typed = advanced.select("source", F.col("last_sync").cast("timestamp").alias("last_sync"))
        typed.write.mode("overwrite").parquet(f"{state_root}/marks/batch={batch}")
        shown.unpersist()

    return (
        messages.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def distinct_messages(messages: DataFrame, within: str = "1 day", ts: str = "internal_ts") -> DataFrame:
    """Messages without repeats that arrive within a time of each other."""
    timed = messages.withColumn("_event_time", F.col(ts).cast("timestamp"))
    return timed.withWatermark("_event_time", within).dropDuplicatesWithinWatermark(["message_id"]).drop("_event_time")


def publish_marks(spark: SparkSession, state_root: str, batch: int, path: str) -> int:
    """Make the marks of a finished stream the current ones of the batch jobs."""
    marks = spark.read.schema(schemas.SYNC_STATE).parquet(f"{state_root}/marks/batch={batch}")
    return state.write_snapshot(marks, path)
