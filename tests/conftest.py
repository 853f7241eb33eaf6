from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from marginalia.session import build_session, ship_package

    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    session.sparkContext.addPyFile(str(ROOT / "tests" / "helpers.py"))
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of an expression over one row of literal columns."""

    def value(expression, schema: str = "x int", *row):
        return spark.createDataFrame([tuple(row) or (0,)], schema).select(expression.alias("v")).first()["v"]

    return value


@pytest.fixture
def each(spark):
    """Values of an expression over a column of strings, in order."""
    from pyspark.sql import functions as F

    def values(expression, inputs: list):
        rows = spark.createDataFrame(list(enumerate(inputs)), "i int, s string")
        found = rows.select("i", expression(F.col("s")).alias("v")).orderBy("i").collect()
        return [row["v"] for row in found]

    return values
