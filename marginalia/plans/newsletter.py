"""Newsletter run: new messages of registered sources → scored notes, labels, marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import text
from marginalia.operators import incremental, notes, report, scoring
from marginalia.operators.scoring import Scorer
from marginalia.plans.runs import (
    RunResult, StateFolder, materialise_counted, run_time, write_global_run, write_part, write_run_report,
)
from marginalia.schemas import FRONT_MATTER
from marginalia.settings import JobSettings
from marginalia.sources import messages as mail, state


def new_items(
    messages: DataFrame, sources: DataFrame, sync_state: DataFrame, now: str, settings: JobSettings
) -> DataFrame:
    """Items of all sources that are newer than the mark of their source.

    Of landed messages (``messages.land``) only the folders are read that some source needs.
    Cheap filters come first: scan bound, sender match, mark, then page limit; the
    message bodies are unpacked only for what is left.
    """
    cutoffs = incremental.source_cutoffs(
        sources.select("name"), sync_state, run_time(now), settings.lookback_days
    )
    if "slice" in messages.columns:
        messages = incremental.landed_search(messages, sources, cutoffs, run_time(now)).drop("slice")
    possible = incremental.coarse_search(messages, cutoffs)
    matched = incremental.match_senders(possible, sources)
    fresh = matched.join(cutoffs.withColumnRenamed("name", "source"), "source").filter(
        incremental.is_new(F.col("internal_ts"))
    )
    if settings.max_per_source is not None:
        fresh = incremental.newest_per_source(fresh, settings.max_per_source)
    return mail.to_items(fresh)


def note_rows(scored: DataFrame, now: str, settings: JobSettings) -> DataFrame:
    """Rows of the notes table for the items that were scored."""
    front = notes.newsletter_front_matter(run_time(now))
    written = notes.with_text(scored.filter("error IS NULL"), front, F.col("content"))
    return written.select(
        F.lit(settings.notes_folder).alias("folder"),
        text.safe_filename(F.col("title")).alias("filename"),
        *(F.col("front")[name].alias(name) for name in FRONT_MATTER.names),
        F.col("analysis.summary").alias("summary"),
        F.col("analysis.key_takeaways").alias("key_takeaways"),
        "content",
        "rendered",
        # Oldest first: of two notes with one name the newer message is kept.
        F.struct(F.col("internal_ts"), F.col("item_id")).alias("seq"),
    )


def commit(
    scored: DataFrame, folder: StateFolder, now: str, run_id: str, settings: JobSettings,
    observed: dict[str, int] | None = None, fetch_failures: DataFrame | None = None,
) -> RunResult:
    """Write notes, labels, dead letters and marks, in this order: a run that dies in
    between is repeated by the next one, which writes the same notes again."""
    spark = scored.sparkSession
    result = outcome(scored, now, settings, "newsletters", observed=observed, fetch_failures=fetch_failures)
    state.append_increment(result.notes, folder.path("notes"), ["folder"])
    ok = scored.filter("error IS NULL")
    labels = notes.label_messages(folder.labels(spark), ok, settings.newsletter_label)
    state.append_increment(labels, folder.path("message_labels"))
    wanted = spark.range(1).select(F.lit(settings.newsletter_label).alias("label"))
    state.write_snapshot(notes.ensure_labels(folder.label_names(spark), wanted), folder.path("labels"))
    write_part(result.dead_letters, folder, "dead_letters", run_id)
    marks = incremental.new_marks(scored, F.col("error").isNull())
    advanced = incremental.advance_marks(folder.sync_state(spark), marks)
    state.write_snapshot(advanced, folder.path("sync_state"))
    write_global_run(spark, folder, now)
    write_run_report(result.report, folder, run_id, now)
    return result


# Messages that could not be read are dead letters, but count as never fetched.
_FETCHED = "stage <> 'extract'"


def outcome(
    scored: DataFrame, now: str, settings: JobSettings, name: str, batch: bool = False,
    observed: dict[str, int] | None = None, fetch_failures: DataFrame | None = None,
) -> RunResult:
    """What a run gives. With ``observed`` counts the report reads no row; a source that could not be
    fetched is an error of the run and a dead letter, the other sources are not touched by it."""
    letters = report.dead_letters(scored, F.col("stage"), "newsletters", ["item_id", "message_id", "source", "internal_ts"])
    if observed is None:
        counts = report.run_report(scored.filter(_FETCHED), name, batch)
    else:
        counts = report.stated_report(scored.sparkSession, observed, name, batch)
    if fetch_failures is not None:
        letters = letters.unionByName(report.fetch_letters(fetch_failures, letters.columns))
        counts = counts.withColumn("errors", F.col("errors") + fetch_failures.agg(F.count("*")).scalar())
    return RunResult(scored=scored, notes=note_rows(scored, now, settings), report=counts, dead_letters=letters)


def run(
    spark: SparkSession,
    messages: DataFrame,
    sources: DataFrame,
    folder: StateFolder,
    scorer: Scorer,
    system_prompt: str,
    now: str,
    run_id: str,
    settings: JobSettings = JobSettings(),
    write: bool = True,
    fetch_failures: DataFrame | None = None,
) -> RunResult:
    """One synchronous run. With ``write=False`` items are scored but nothing is stored.

    ``fetch_failures`` (source, error) are sources whose messages could not be landed.
    """
    items = new_items(messages, sources, folder.sync_state(spark), now, settings)
    unreadable = F.col("error").isNotNull()
    staged = items.withColumns(
        {
            "hint": F.col("newsletter_name"),
            "stage": F.when(unreadable, "extract").otherwise("score"),
        }
    )
    # One pass: messages that could not be read go along without being scored.
    whole = scoring.score(staged, scorer, system_prompt, failed=F.col("error"), limit=settings.prompt_max_chars, in_flight=settings.in_flight, per_second=settings.per_second)
    if not write:
        return outcome(whole, now, settings, "newsletters", fetch_failures=fetch_failures)
    seen = report.counts(F.col("error").isNotNull(), F.expr(_FETCHED))
    fixed, observed = materialise_counted(whole, folder.path(f"scored/run_id={run_id}"), seen)
    return commit(fixed, folder, now, run_id, settings, observed, fetch_failures)
