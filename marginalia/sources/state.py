"""State between runs: versioned snapshots and the notes table.

Every write makes a new ``v=N`` folder; the newest one with ``_SUCCESS`` is current, so
a reader never sees half a write and no job overwrites what it reads. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from marginalia.operators.keyed import last_per_key
from marginalia.operators.notes import KEY

FULL = "_FULL"


class Versions:
    """Version folders under one path, on any file system Spark can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._make = jvm.org.apache.hadoop.fs.Path
        self._fs = self._make(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _has(self, version: int, marker: str) -> bool:
        return self._fs.exists(self._make(f"{self.folder(version)}/{marker}"))

    def folder(self, version: int) -> str:
        return f"{self.path}/v={version}"

    def complete(self) -> list[int]:
        if not self._fs.exists(self._make(self.path)):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(self._make(self.path))]
        found = sorted(int(name[2:]) for name in names if name[:2] == "v=" and name[2:].isdigit())
        return [version for version in found if self._has(version, "_SUCCESS")]

    def publish(self, df: DataFrame, partition_by: list[str] | None = None, marker: str | None = None) -> int:
        """Write the next version. A half-written one of a failed run is replaced."""
        done = self.complete()
        version = (done[-1] + 1) if done else 1
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.folder(version))
        if marker:
            self._fs.create(self._make(f"{self.folder(version)}/{marker}")).close()
        return version

    def is_full(self, version: int) -> bool:
        return self._has(version, FULL)

    def since_full(self) -> list[int]:
        """The newest version that holds everything, and the increments after it."""
        done = self.complete()
        full = [version for version in done if self.is_full(version)]
        return [version for version in done if not full or version >= full[-1]]

    def read(self, versions: list[int]) -> DataFrame:
        """Rows of some versions, their version in ``v``."""
        return self.spark.read.option("basePath", self.path).parquet(*map(self.folder, versions))


def read_snapshot(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The current snapshot; no snapshot gives no rows."""
    versions = Versions(spark, path)
    done = versions.complete()
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(versions.folder(done[-1]))


def write_snapshot(df: DataFrame, path: str) -> int:
    return Versions(df.sparkSession, path).publish(df)


def append_increment(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Add rows without rewriting the table."""
    return Versions(df.sparkSession, path).publish(df, partition_by)


def read_increments(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows since the last full version, with their version in ``v``; None if there are none."""
    versions = Versions(spark, path)
    live = versions.since_full()
    return versions.read(live) if live else None


def current_notes(spark: SparkSession, path: str) -> DataFrame | None:
    """The notes table: the last row of every (folder, filename).

    A full version holds each name once. Only the increments after it are ranked; the
    full version itself is read without a sort and loses the names that were rewritten.
    """
    versions = Versions(spark, path)
    live = versions.since_full()
    if not live:
        return None
    full, later = (live[:1], live[1:]) if versions.is_full(live[0]) else ([], live)
    if not later:
        return versions.read(full).drop("v")
    newest = last_per_key(versions.read(later), KEY, F.col("v").desc(), F.col("seq").desc()).drop("v")
    if not full:
        return newest
    kept = versions.read(full).drop("v").join(newest.select(*KEY), KEY, "left_anti")
    return kept.unionByName(newest)


def compact_notes(spark: SparkSession, path: str) -> int | None:
    """Write the current notes as one full version, so that readers skip the earlier ones."""
    notes = current_notes(spark, path)
    if notes is None:
        return None
    return Versions(spark, path).publish(notes, ["folder"], marker=FULL)
