"""Another try for dead letters: their stored inputs are scored again and committed like a run.

Inputs are the rows that the failed run has written before it wrote anything else, so no mail is
read again. A letter is open until some run has made a note of its item; every try counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.operators import scoring
from marginalia.operators.keyed import last_per_key
from marginalia.operators.scoring import Scorer
from marginalia.plans import newsletter
from marginalia.plans.runs import RunResult, StateFolder, materialise, write_part
from marginalia.settings import JobSettings
from marginalia.sources import vault


def open_letters(spark: SparkSession, folder: StateFolder) -> DataFrame | None:
    """The last try of every item that has failed in scoring and was not made into a note since."""
    path = folder.path("dead_letters")
    if not vault.path_exists(spark, path):
        return None
    letters = spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string")).filter("stage = 'score'")
    last = last_per_key(letters, ["item_id"], F.col("attempt").desc(), F.col("run_id").desc())
    solved = folder.path("letters_done")
    if vault.path_exists(spark, solved):
        last = last.join(spark.read.parquet(solved).select("item_id").distinct(), "item_id", "left_anti")
    return last


def inputs_of(spark: SparkSession, folder: StateFolder, letters: DataFrame) -> DataFrame:
    """The stored rows of the letters, as they were before scoring, with the number of tries so far."""
    stored = spark.read.parquet(folder.path("scored")).withColumn("run_id", F.col("run_id").cast("string"))
    keys = letters.select("run_id", "item_id", F.col("attempt").alias("_tries"))
    return stored.join(keys, ["run_id", "item_id"]).drop("analysis", "error", "stage", "run_id", "attempt").withColumnRenamed("_tries", "attempt")


def replay(
    spark: SparkSession,
    folder: StateFolder,
    scorer: Scorer,
    system_prompt: str,
    now: str,
    run_id: str,
    settings: JobSettings = JobSettings(),
    most_attempts: int | None = None,
) -> RunResult | None:
    """Score the open letters again; None when there are none. Marks never move back by it."""
    letters = open_letters(spark, folder)
    if letters is None:
        return None
    if most_attempts is not None:
        letters = letters.filter(F.col("attempt") < most_attempts)
    items = inputs_of(spark, folder, letters).withColumn("attempt", F.col("attempt") + 1)
    again = scoring.score(items, scorer, system_prompt, limit=settings.prompt_max_chars, in_flight=settings.in_flight, per_second=settings.per_second).withColumn("stage", F.lit("score"))
    fixed = materialise(again, folder.path(f"scored/run_id={run_id}"))
    if fixed.isEmpty():
        return None
    result = newsletter.commit(fixed, folder, now, run_id, settings)
    write_part(fixed.filter("error IS NULL").select("item_id"), folder, "letters_done", run_id)
    return result
