"""Removing what finished runs and batches have left behind."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession, functions as F

from marginalia.plans import replay
from marginalia.plans.runs import StateFolder, run_time
from marginalia.operators import batches
from marginalia.settings import RESULT_TTL_DAYS

# Folders of single batches and of single runs, below the state folder.
OF_BATCHES = ("requests", "results", "pending_items/newsletters", "pending_items/inbox")
OF_RUNS = ("scored", "scored_inbox", "reconciled/newsletters", "reconciled/inbox", "status/newsletters", "status/inbox")


def purge(spark: SparkSession, folder: StateFolder, now: str, ttl_days: int = RESULT_TTL_DAYS) -> list[str]:
    """Delete folders last written over ``ttl_days`` ago; returns their paths.

    Batches that still wait and runs whose dead letters are still open keep theirs.
    """
    live = batches.live(folder.pending_batches(spark), run_time(now)).select(F.col("batch_id").alias("name"))
    letters = replay.open_letters(spark, folder)
    runs = live.limit(0) if letters is None else letters.select(F.col("run_id").alias("name")).distinct()
    limit = dt.datetime.fromisoformat(now).replace(tzinfo=dt.UTC).timestamp() * 1000 - ttl_days * 86_400_000
    removed = []
    for kinds, kept in ((OF_BATCHES, live), (OF_RUNS, runs)):
        old = [path for kind in kinds for path in _written_before(spark, folder.path(kind), limit)]
        if not old:
            continue
        # Only names of old folders come back to the driver, never rows of a table.
        names = spark.createDataFrame([(path, path.rsplit("=", 1)[1]) for path in old], "path string, name string")
        removed += [row["path"] for row in names.join(kept, "name", "left_anti").toLocalIterator()]
    for path in removed:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return sorted(removed)


def _written_before(spark: SparkSession, path: str, limit: float) -> list[str]:
    """Folders ``key=value`` of a path that were last written before a time in milliseconds."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    found = [(s.getPath().getName(), s.getModificationTime()) for s in system.listStatus(where)]
    return [f"{path}/{name}" for name, written in found if "=" in name and written < limit]
