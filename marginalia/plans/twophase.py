"""Scoring in two jobs: submit writes requests and pending state, resume reconciles results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia import schemas
from marginalia.functions.replies import TOOL_NAME
from marginalia.operators import batches, report, scoring
from marginalia.operators.scoring import Scorer
from marginalia.plans import inbox, newsletter
from marginalia.plans.runs import StateFolder, materialise, run_time, write_part
from marginalia.settings import JobSettings
from marginalia.sources import state, vault

ITEM = ["batch_id", "custom_id"]
# A batch id names a folder; starting with a letter it is never read back as a number.
BATCH_ID = r"[A-Za-z][A-Za-z0-9_-]{0,63}"


def pending_items(spark: SparkSession, folder: StateFolder, pipeline: str) -> DataFrame | None:
    """Items of all submitted batches, partitioned by batch: joined to the live batches,
    only their folders are read. None before the first submit."""
    path = folder.path(f"pending_items/{pipeline}")
    return spark.read.parquet(path) if vault.path_exists(spark, path) else None


def submit(
    items: DataFrame, folder: StateFolder, pipeline: str, batch_id: str, now: str,
    settings: JobSettings = JobSettings(), write: bool = True,
) -> DataFrame:
    """Write the requests of one batch and its pending state; returns the requests.

    Items of batches that still wait are left out, and so are items that could not be read;
    those become dead letters. The pending state is written last: if the job dies before,
    nothing waits for a result that will not come. With ``write=False`` nothing is written.
    """
    spark = items.sparkSession
    if not re.fullmatch(BATCH_ID, batch_id):
        raise ValueError(f"batch id {batch_id!r} must match {BATCH_ID}")
    waiting = pending_items(spark, folder, pipeline)
    live = batches.live(folder.pending_batches(spark), run_time(now))
    unreadable = items.limit(0)
    if "error" in items.columns:
        unreadable = items.filter("error IS NOT NULL").withColumn("stage", F.lit("extract"))
        items = items.filter("error IS NULL")
    fresh = items
    if waiting is not None:
        fresh = batches.without_pending(items, waiting.join(live.select("batch_id"), "batch_id", "left_semi"))
    built = batches.build_requests(fresh, F.col("hint"), limit=settings.prompt_max_chars).withColumn("batch_id", F.lit(batch_id))
    if not write:
        return built.select(*ITEM, "prompt")
    if "error" in items.columns:
        style = "newsletters" if "source" in items.columns else pipeline
        letters = report.dead_letters(unreadable, F.col("stage"), style, ["item_id"])
        write_part(letters, folder, f"dead_letters_{pipeline}_submit", batch_id)
    fixed = materialise(built.drop("error"), folder.path(f"requests/batch={batch_id}"))
    fixed.drop("prompt", "batch_id").write.mode("overwrite").parquet(
        folder.path(f"pending_items/{pipeline}/batch_id={batch_id}")
    )
    new = spark.range(1).select(
        *batches.pending_batch(F.lit(batch_id), F.lit(pipeline), run_time(now), settings.result_ttl_days)
    )
    others = batches.drop_batches(folder.pending_batches(spark), new)
    state.write_snapshot(others.unionByName(new), folder.path("pending_batches"))
    return fixed.select(*ITEM, "prompt")


def score_requests(
    spark: SparkSession, folder: StateFolder, batch_id: str, scorer: Scorer, system_prompt: str
) -> DataFrame:
    """Results of one submitted batch from a scorer that runs on the executors.

    Stands in for a remote service: it reads the stored requests and writes one result
    row per request, in the form ``resume`` expects.
    """
    requests = spark.read.parquet(folder.path(f"requests/batch={batch_id}"))
    scored = scoring.score(requests, scorer, system_prompt)
    block = F.struct(
        F.lit("tool_use").alias("type"), F.lit(TOOL_NAME).alias("name"), F.col("analysis").alias("input")
    )
    failed = F.col("error").isNotNull()
    rows = scored.select(
        F.lit(batch_id).alias("batch_id"),
        "custom_id",
        F.when(failed, "errored").otherwise("succeeded").alias("type"),
        F.when(~failed, F.to_json(F.struct(F.array(block).alias("content")))).alias("message"),
        "error",
        F.lit(0).cast("bigint").alias("seq"),
    )
    return materialise(rows, folder.path(f"results/batch={batch_id}"))


def cancel(spark: SparkSession, folder: StateFolder, batch_id: str) -> None:
    """Take one batch from the pending state; an unknown id is an error."""
    known = folder.pending_batches(spark)
    if known.filter(F.col("batch_id") == batch_id).isEmpty():
        raise ValueError(f"no pending batch {batch_id}")
    state.write_snapshot(known.filter(F.col("batch_id") != batch_id), folder.path("pending_batches"))


def resume(
    spark: SparkSession,
    folder: StateFolder,
    provider_batches: DataFrame,
    results: DataFrame,
    vocabulary: F.Column,
    pdf_files: DataFrame | None,
    now: str,
    run_id: str,
    settings: JobSettings = JobSettings(),
    write: bool = True,
) -> DataFrame:
    """Finalize every live batch that has ended; returns the state of the live batches.

    Complete batches become notes. Items of failed, cancelled and expired batches become dead
    letters before their batches leave the queue. Rerunning after a crash repeats the same
    writes. With ``write=False`` only the states are computed.
    """
    all_batches = folder.pending_batches(spark)
    live = batches.live(all_batches, run_time(now)).join(
        provider_batches.select("batch_id", "processing_status"), "batch_id", "left"
    )
    known_status = F.coalesce("processing_status", F.lit("in_progress"))
    live = live.withColumn("processing_status", known_status)
    states = []
    for pipeline in ("newsletters", "inbox"):
        waiting = pending_items(spark, folder, pipeline)
        if waiting is None:
            continue
        mine = live.filter(F.col("pipeline") == pipeline)
        status = batches.batch_status(mine, waiting, results)
        if write:
            status = materialise(status, folder.path(f"status/{pipeline}/run_id={run_id}"))
        states.append(status)
        if not write:
            continue
        late = batches.expired(all_batches, run_time(now)).filter(F.col("pipeline") == pipeline)
        lost = batches.given_up(waiting, status, late)
        style = "newsletters" if "source" in lost.columns else pipeline
        letters = report.dead_letters(lost, F.col("stage"), style, ["batch_id", "item_id"])
        write_part(letters, folder, f"dead_letters_{pipeline}_batches", run_id)
        ready = status.filter("state = 'complete'").select("batch_id")
        items = waiting.join(ready, "batch_id", "left_semi")
        answers = results.join(ready, "batch_id", "left_semi")
        outcomes = batches.reconcile(items, answers).withColumn("stage", F.lit("reconcile"))
        if status.filter("state = 'complete'").isEmpty():
            continue
        fixed = materialise(outcomes, folder.path(f"reconciled/{pipeline}/run_id={run_id}"))
        if pipeline == "newsletters":
            newsletter.commit(fixed, folder, now, run_id, settings)
        else:
            files = pdf_files if pdf_files is not None else spark.createDataFrame(
                [], "path string, modificationTime timestamp, length bigint, content binary"
            )
            inbox.commit(fixed, files, vocabulary, folder, now, run_id, settings)
    if not states:
        return spark.createDataFrame([], schemas.PENDING_BATCH)
    status = states[0] if len(states) == 1 else states[0].unionByName(states[1])
    if not write:
        return status
    left = batches.drop_batches(batches.live(all_batches, run_time(now)), status.filter("is_terminal"))
    state.write_snapshot(left, folder.path("pending_batches"))
    return status
