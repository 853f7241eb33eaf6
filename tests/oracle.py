"""Runs a Spark query and its SQL side by side and compares the rows as bags."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from pathlib import Path

import duckdb


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list):
        return tuple(value)
    return value


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    table = df.select(*names).toArrow()
    return names, Counter(tuple(_plain(v) for v in row.values()) for row in table.to_pylist())


def sql_rows(folder: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    table = con.execute(sql).to_arrow_table()
    names = sorted(table.column_names)
    return names, Counter(tuple(_plain(v) for v in row.values()) for row in table.select(names).to_pylist())


def differences(spark, run, sql: str, folder: str) -> str | None:
    names, got = spark_rows(run(spark, folder))
    wanted_names, wanted = sql_rows(folder, sql)
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if got != wanted:
        extra, lacking = list((got - wanted).items())[:2], list((wanted - got).items())[:2]
        return f"rows {sum(got.values())} vs {sum(wanted.values())}; extra {extra}; lacking {lacking}"[:3000]
    return None
