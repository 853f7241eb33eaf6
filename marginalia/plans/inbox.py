"""Inbox run: unprocessed notes and PDF files → enriched, scored, merged, moved notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia.functions import lists, text, urls
from marginalia.operators import enrich, merge, notes, report, scoring
from marginalia.operators.keyed import last_per_key
from marginalia.operators.scoring import Scorer
from marginalia.plans import moves
from marginalia.plans.runs import RunResult, StateFolder, materialise_counted, run_time, write_part, write_run_report
from marginalia.schemas import FRONT_MATTER
from marginalia.settings import JobSettings
from marginalia.sources import state, vault


def inbox_items(
    notes_files: DataFrame, pdf_files: DataFrame, pages: DataFrame | None, settings: JobSettings
) -> tuple[DataFrame, DataFrame]:
    """(items with hint, quarantined notes). Pages are the crawled web pages, if there are any."""
    parsed = vault.parse_notes(notes_files)
    items = vault.scan_inbox(parsed, pdf_files)
    with_pages = settings.enrich_from_web and pages is not None
    if with_pages:
        enriched = enrich.keep_longest(items, enrich.one_per_url(enrich.articles(enrich.wanted_pages(pages, items))))
    else:
        nothing = F.lit(None).cast("string")
        cleaned = urls.clean_url(F.col("source_url"))
        # Without crawled pages addresses are still cleaned, unless enrichment is off.
        source = cleaned if settings.enrich_from_web else F.col("source_url")
        enriched = items.withColumns({"source_url": source, "web_author": nothing, "web_date": nothing})
    hint = text.content_hint(F.col("title"), urls.network_location(F.col("source_url")))
    return enriched.withColumn("hint", hint), vault.quarantined(parsed)


def note_rows(scored: DataFrame, vocabulary: Column, now: str, settings: JobSettings) -> DataFrame:
    """Notes of scored items: merged notes under their own name, wrapper notes for PDF files."""
    as_of = run_time(now)
    ok = scored.filter("error IS NULL")
    tagged = merge.resolve_tags(ok, vocabulary, suggested="analysis.tags")
    existing = vault.existing_entries(F.col("existing")) | {"author": F.col("existing_author")}
    item = {
        "title": F.col("title"),
        "source_url": F.col("source_url"),
        "web_author": F.col("web_author"),
        "web_date": F.col("web_date"),
        "published": existing["published"],
    }
    status_and_tags = {"status": F.col("status"), "tags": F.col("merged_tags")}
    merged = merge.merged_front_matter(item, existing, F.col("analysis"), as_of) | status_and_tags
    merged["gmail_url"] = F.lit(None).cast("string")
    plain = {
        "message_id": F.lit(None).cast("string"), "newsletter_name": F.lit(None).cast("string"),
        "published": F.lit(None).cast("date"), "author": lists.empty_list(),
    }
    markdown = _rows(tagged.filter("NOT is_pdf"), merged, F.col("filename"), F.col("content"), None, settings)
    wrapper = notes.pdf_front_matter(as_of)
    pdf = _rows(
        tagged.filter("is_pdf").withColumns(plain),
        wrapper,
        text.safe_filename(F.col("title")),
        F.lit(""),
        F.col("filename"),
        settings,
    )
    return markdown.unionByName(pdf)


def _rows(
    tagged: DataFrame, front: dict[str, Column], filename: Column, content: Column,
    pdf_filename: Column | None, settings: JobSettings,
) -> DataFrame:
    return notes.with_text(tagged, front, content, pdf_filename).select(
        F.lit(settings.notes_folder).alias("folder"),
        filename.alias("filename"),
        *(F.col("front")[name].alias(name) for name in FRONT_MATTER.names),
        F.col("analysis.summary").alias("summary"),
        F.col("analysis.key_takeaways").alias("key_takeaways"),
        content.alias("content"),
        "rendered",
        F.struct(F.lit(None).cast("timestamp").alias("internal_ts"), F.col("item_id")).alias("seq"),
    )


def without_done(files: DataFrame, folder: StateFolder, run_id: str) -> DataFrame:
    """Inbox files no other run has made into a note; failed ones are tried again.

    A run that is repeated under its id works on the same files again.
    """
    path = folder.path("inbox_done")
    spark = files.sparkSession
    if not vault.path_exists(spark, path):
        return files
    done = spark.read.parquet(path).filter(F.col("run_id").cast("string") != run_id)
    return files.join(done.select("path").distinct(), "path", "left_anti")


def outcome(
    scored: DataFrame, vocabulary: Column, now: str, settings: JobSettings, batch: bool = False, observed: dict[str, int] | None = None
) -> RunResult:
    """What a run gives. With ``observed`` counts the report reads no row."""
    stated = observed is not None
    return RunResult(
        scored=scored,
        notes=note_rows(scored, vocabulary, now, settings),
        report=report.stated_report(scored.sparkSession, observed, "inbox", batch) if stated else report.run_report(scored, "inbox", batch),
        dead_letters=report.dead_letters(scored, F.col("stage"), "inbox", ["item_id"]),
    )


def asset_digests(scored: DataFrame, pdf_files: DataFrame) -> DataFrame:
    """(path, length, sha256) of the PDF files that became notes; only paths and digests are joined."""
    kept = scored.filter("error IS NULL AND is_pdf").select(F.col("original_path").alias("path"))
    return notes.file_digests(pdf_files).join(kept, "path", "left_semi")


def log_moves(result: RunResult, notes_files: DataFrame, pdf_files: DataFrame, folder: StateFolder, run_id: str, settings: JobSettings) -> None:
    """The intent to write the run's notes and assets as files and to remove their originals."""
    done = result.scored.filter("error IS NULL AND NOT is_pdf").select(F.col("original_path").alias("path"))
    originals = notes_files.select("path", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256")).join(done, "path", "left_semi")
    # Of notes that share a name the last one is the file.
    last = last_per_key(result.notes, notes.KEY, F.col("seq").desc())
    moves.log(moves.intents(last, originals, asset_digests(result.scored, pdf_files), settings.assets_folder), folder, run_id)


def commit(
    scored: DataFrame, pdf_files: DataFrame, vocabulary: Column, folder: StateFolder, now: str, run_id: str,
    settings: JobSettings, observed: dict[str, int] | None = None,
) -> RunResult:
    result = outcome(scored, vocabulary, now, settings, observed=observed)
    state.append_increment(result.notes, folder.path("notes"), ["folder"])
    write_part(notes.asset_rows(asset_digests(scored, pdf_files), settings.assets_folder), folder, "assets", run_id)
    write_part(result.dead_letters, folder, "dead_letters_inbox", run_id)
    done = scored.filter("error IS NULL").select(F.col("original_path").alias("path"))
    write_part(done, folder, "inbox_done", run_id)
    write_run_report(result.report, folder, run_id, now)
    return result


def run(
    spark: SparkSession,
    notes_files: DataFrame | str,
    pdf_files: DataFrame | str,
    pages: DataFrame | None,
    taxonomy: DataFrame,
    folder: StateFolder,
    scorer: Scorer,
    system_prompt: str,
    now: str,
    run_id: str,
    settings: JobSettings = JobSettings(),
    write: bool = True,
    vault_root: str | None = None,
) -> RunResult:
    """One run over the inbox. With ``vault_root`` notes and assets are written there as files and their
    originals removed; what an earlier run left of that is finished first. Give the inbox as its path
    then, so that it is listed after that."""
    from marginalia.sources.registry import vocabulary

    moving = write and vault_root is not None
    if moving:
        moves.finish_all(spark, folder, vault_root)
    if isinstance(notes_files, str):
        notes_files = vault.read_notes(spark, notes_files)
    if isinstance(pdf_files, str):
        pdf_files = vault.read_pdfs(spark, pdf_files)
    notes_files, pdfs = (without_done(files, folder, run_id) for files in (notes_files, pdf_files))
    items, quarantined = inbox_items(notes_files, pdfs, pages, settings)
    scored = scoring.score(items, scorer, system_prompt, limit=settings.prompt_max_chars, in_flight=settings.in_flight, per_second=settings.per_second).withColumn("stage", F.lit("score"))
    if not write:
        return outcome(scored, vocabulary(taxonomy), now, settings)
    seen = report.counts(F.col("error").isNotNull())
    fixed, observed = materialise_counted(scored, folder.path(f"scored_inbox/run_id={run_id}"), seen)
    write_part(quarantined, folder, "quarantine", run_id)
    result = commit(fixed, pdf_files, vocabulary(taxonomy), folder, now, run_id, settings, observed)
    if moving:
        log_moves(result, notes_files, pdfs, folder, run_id, settings)
        moves.finish(spark, folder, vault_root, run_id)
    return result
