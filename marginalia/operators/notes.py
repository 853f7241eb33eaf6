"""Notes: projections from items, upserts, moves, assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions import frontmatter, lists, render, text
from marginalia.operators.keyed import last_per_key

KEY = ["folder", "filename"]


def newsletter_front_matter(as_of: Column) -> dict[str, Column]:
    """Front matter of a newsletter item; its tags are taken as the scorer gave them."""
    none_text, none_int = F.lit(None).cast("string"), F.lit(None).cast("int")
    return {
        "title": F.col("title"),
        "source": F.coalesce("source_url", F.lit("")),
        "author": F.col("author"),
        "newsletter": F.col("newsletter_name"),
        "published": F.col("published"),
        "gmail_url": text.message_link(F.col("message_id")),
        "created": F.to_date(as_of),
        "description": F.col("analysis.description"),
        "type": F.lit("newsletter"),
        "status": F.lit("classified"),
        "rating": none_int,
        "journal": none_text,
        "doi": none_text,
        "year": none_int,
        "isbn": none_text,
        "tags": F.col("analysis.tags"),
    }


def pdf_front_matter(as_of: Column) -> dict[str, Column]:
    """Front matter of the wrapper note of a PDF; typed paper unless it is a book."""
    kind = F.col("analysis.content_type")
    base = newsletter_front_matter(as_of)
    web_author = text.blank_to_null(F.col("web_author"))
    return base | {
        "author": F.when(web_author.isNotNull(), F.array(text.wikilink(web_author))).otherwise(lists.empty_list()),
        "newsletter": F.lit(None).cast("string"),
        "published": F.lit(None).cast("date"),
        "gmail_url": F.lit(None).cast("string"),
        "type": F.when(kind.isin("paper", "book"), kind).otherwise(F.lit("paper")),
        "status": F.col("status"),
        "tags": F.col("merged_tags"),
    }


def with_text(
    scored: DataFrame, front_matter: dict[str, Column], content: Column, pdf_filename: Column | None = None
) -> DataFrame:
    """Scored items with ``front`` (front matter struct) and ``rendered`` (whole note text).

    Every step is a column of its own, so that the YAML writer runs once per note although
    each layout contains its result.
    """
    staged = scored.withColumn("front", F.struct(*(column.alias(name) for name, column in front_matter.items())))
    with_yaml = staged.withColumn("_yaml", frontmatter.front_matter_yaml(F.col("front")))
    note = render.render_note(
        render.layout_for(F.col("front.type")),
        F.col("_yaml"),
        F.col("analysis.summary"),
        F.col("analysis.key_takeaways"),
        content,
        pdf_filename,
    )
    return with_yaml.withColumn("rendered", note).drop("_yaml")


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming notes replace notes of the same folder and name; the last one wins.

    Both frames carry ``run_ts`` and ``seq``. A name that many notes share is reduced to
    one row per task before the shuffle.
    """
    both = current.unionByName(incoming, allowMissingColumns=True)
    return last_per_key(both, KEY, F.col("run_ts").desc(), F.col("seq").desc())


def collisions(incoming: DataFrame) -> DataFrame:
    """Names that one run writes more than once: only the last of them survives."""
    return incoming.groupBy(*KEY).agg(F.count("*").alias("written")).filter("written > 1")


def move(notes: DataFrame, processed: DataFrame, inbox_folder: str, notes_folder: str) -> DataFrame:
    """Notes with the processed inbox keys in the notes folder, under the name they had.

    A moved note replaces one of the same name that is already there. The table is read once.
    """
    done = processed.select(
        F.lit(inbox_folder).alias("folder"), "filename", F.lit(True).alias("_moved")
    ).distinct()
    placed = notes.join(done, KEY, "left").withColumns(
        {
            "_moved": F.coalesce("_moved", F.lit(False)),
            "folder": F.when(F.col("_moved"), F.lit(notes_folder)).otherwise(F.col("folder")),
        }
    )
    return last_per_key(placed, KEY, F.col("_moved").desc()).drop("_moved")


def file_digests(files: DataFrame) -> DataFrame:
    """binaryFile rows → path, length, sha256; the content goes no further than the scan."""
    return files.select("path", "length", F.sha2(F.col("content"), 256).alias("sha256"))


def asset_rows(digests: DataFrame, folder: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return digests.select(F.lit(folder).alias("folder"), name.alias("filename"), "length", "sha256")


def asset_manifest(files: DataFrame, folder: str) -> DataFrame:
    """binaryFile rows → assets table rows, content replaced by its digest."""
    return asset_rows(file_digests(files), folder)


def ensure_labels(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(label, label_id) with a row for every name; a label that exists keeps its id."""
    wanted = names.select("label").distinct().join(labels.select("label"), "label", "left_anti")
    return labels.select("label", "label_id").unionByName(
        wanted.withColumn("label_id", F.concat(F.lit("label-"), F.sha2("label", 256)))
    )


def label_messages(labelled: DataFrame, messages: DataFrame, label: str) -> DataFrame:
    """Label rows a run adds: one per message that has an id and lacks the label."""
    wanted = (
        messages.filter(F.coalesce("message_id", F.lit("")) != "")
        .select("message_id", F.lit(label).alias("label"))
        .distinct()
    )
    return wanted.join(labelled.select("message_id", "label"), ["message_id", "label"], "left_anti")
