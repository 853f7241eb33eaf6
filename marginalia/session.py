"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "marginalia", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # HTML and note bodies are wide rows: keep Arrow batches within a few MB.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.parquet.filterPushdown": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure a reliable checkpoint folder is set and return it.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="marginalia-", dir="/tmp")
    context.setCheckpointDir(configured)
    return configured


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for the Arrow functions."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="marginalia-", dir="/tmp")) / "marginalia"
    archive = shutil.make_archive(str(target), "zip", root_dir=package.parent, base_dir=package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
