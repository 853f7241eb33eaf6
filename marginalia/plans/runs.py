"""What runs share: the state folder, materialising scored rows, writing in safe order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from marginalia import schemas
from marginalia.sources import state


_WHOLE = "batch_id IS NOT NULL AND expires_at IS NOT NULL"


@dataclass(frozen=True)
class StateFolder:
    """Tables of one installation, all under one shared folder."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def sync_state(self, spark: SparkSession) -> DataFrame:
        return state.read_snapshot(spark, self.path("sync_state"), schemas.SYNC_STATE)

    def pending_batches(self, spark: SparkSession) -> DataFrame:
        """Pending batches; entries without an id or an end are left out, see ``broken_batches``."""
        return self._stored_batches(spark).filter(_WHOLE)

    def broken_batches(self, spark: SparkSession) -> DataFrame:
        """Entries of the pending state that no run can use, with the reason."""
        lacks = F.concat_ws(", ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in ("batch_id", "expires_at")))
        return self._stored_batches(spark).filter(f"NOT ({_WHOLE})").withColumn("problem", F.concat(F.lit("missing: "), lacks))

    def _stored_batches(self, spark: SparkSession) -> DataFrame:
        return state.read_snapshot(spark, self.path("pending_batches"), schemas.PENDING_BATCH)

    def label_names(self, spark: SparkSession) -> DataFrame:
        """The labels there are, with their ids."""
        return state.read_snapshot(spark, self.path("labels"), schemas.LABEL)

    def labels(self, spark: SparkSession) -> DataFrame:
        found = state.read_increments(spark, self.path("message_labels"))
        if found is None:
            return spark.createDataFrame([], "message_id string, label string")
        return found.select("message_id", "label")


@dataclass(frozen=True)
class RunResult:
    """Frames of a finished run. They read the materialised scored rows, not the scorer."""

    scored: DataFrame
    notes: DataFrame
    report: DataFrame
    dead_letters: DataFrame


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write once and read back: notes, marks, labels and the report must all see the same
    scores, and a lost executor must not make the scorer run again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, path: str, counts: dict[str, F.Column]) -> tuple[DataFrame, dict[str, int]]:
    """``materialise``, and aggregates of the rows that are observed while they are written."""
    seen = Observation()
    fixed = materialise(df.observe(seen, *(value.alias(name) for name, value in counts.items())), path)
    return fixed, seen.get


def run_time(now: str) -> F.Column:
    """The time of a run is a parameter, so that a repeated run gives the same rows."""
    return F.lit(now).cast("timestamp")


def write_part(df: DataFrame, folder: StateFolder, table: str, run_id: str) -> None:
    """Rows of one run in a folder of their own: a repeated run replaces what it wrote."""
    df.write.mode("overwrite").parquet(folder.path(f"{table}/run_id={run_id}"))


def write_run_report(report: DataFrame, folder: StateFolder, run_id: str, now: str) -> None:
    write_part(report.withColumn("run_ts", run_time(now)), folder, "run_report", run_id)


def write_global_run(spark: SparkSession, folder: StateFolder, now: str) -> None:
    state.write_snapshot(spark.range(1).select(run_time(now).alias("global_last_run")), folder.path("run_state"))


def global_last_run(spark: SparkSession, folder: StateFolder) -> DataFrame:
    from pyspark.sql.types import StructField, StructType, TimestampType

    return state.read_snapshot(
        spark, folder.path("run_state"), StructType([StructField("global_last_run", TimestampType())])
    )
