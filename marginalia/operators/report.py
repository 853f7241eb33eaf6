"""Run reports, dead letters, error lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia.operators.keyed import dense_ordinals


def error_text(style: str) -> Column:
    """Wording of one error: with the source in front for newsletters."""
    title_and_error = F.concat(F.coalesce("title", F.lit("")), F.lit(": "), F.col("error"))
    if style == "newsletters":
        return F.concat(F.lit("["), F.col("source"), F.lit("] "), title_and_error)
    return title_and_error


def fetch_error_text(source: Column, error: Column) -> Column:
    return F.concat(F.lit("Gmail fetch failed for "), source, F.lit(": "), error)


def counts(failed: Column, counted: Column | None = None) -> dict[str, Column]:
    """Aggregates of a run report; ``counted`` says which rows count."""
    counted = F.lit(True) if counted is None else counted
    return {
        "items_processed": F.count_if(counted),
        "items_created": F.count_if(counted & ~failed),
        # Nothing is ever skipped: every scored item is written.
        "items_skipped": F.lit(0).cast("bigint"),
        "errors": F.count_if(counted & failed),
    }


def _row(values: DataFrame, name: str, batch: bool) -> DataFrame:
    return values.select(F.lit(f"{name} (batch)" if batch else name).alias("pipeline"), "*")


def run_report(processed: DataFrame, name: str, batch: bool = False) -> DataFrame:
    """One row of counts."""
    found = counts(F.col("error").isNotNull())
    return _row(processed.agg(*(value.alias(key) for key, value in found.items())), name, batch)


def stated_report(spark: SparkSession, observed: dict[str, int], name: str, batch: bool = False) -> DataFrame:
    """The report of a run whose counts were observed while its rows were written."""
    keys = counts(F.lit(False))
    return _row(spark.range(1).select(*(F.lit(int(observed.get(key, 0))).cast("bigint").alias(key) for key in keys)), name, batch)


def created_per_source(processed: DataFrame, source: str = "source") -> DataFrame:
    return processed.groupBy(source).agg(F.count_if(F.col("error").isNull()).alias("created"))


def dead_letters(processed: DataFrame, stage: Column, style: str, keep: list[str | Column]) -> DataFrame:
    """Failed rows with the step they failed in, the reason and the number of tries, so that they can be replayed."""
    tries = F.col("attempt") if "attempt" in processed.columns else F.lit(1)
    return processed.filter(F.col("error").isNotNull()).select(
        *keep, stage.alias("stage"), F.col("error"), error_text(style).alias("message"), tries.cast("int").alias("attempt")
    )


def fetch_letters(failures: DataFrame, columns: list[str]) -> DataFrame:
    """(source, error) of sources that could not be fetched → dead letters of no item."""
    own = {
        "source": F.col("source"), "stage": F.lit("fetch"), "error": F.col("error"),
        "message": fetch_error_text(F.col("source"), F.col("error")), "attempt": F.lit(1),
    }
    return failures.select(*(own.get(c, F.lit(None)).alias(c) for c in columns))


def in_order(letters: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Letters with their place (1, 2, …) in processing order; ``order`` identifies a letter."""
    places = dense_ordinals(letters.select(*order), order, name).select(*order, (F.col(name) + 1).alias(name))
    same = [letters[c].eqNullSafe(places[c]) for c in order]
    return letters.join(places, reduce(lambda a, b: a & b, same)).select(*(letters[c] for c in letters.columns), places[name])
