"""Checked queries: reading notes, merging metadata, writing and moving notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia.catalog import inputs, scored
from marginalia.catalog.inputs import CUTOFFS, ITEMS, SPACES, TAXONOMY, text_of
from marginalia.catalog.registry import query
from marginalia.catalog.scored import CLIPS, RULE_SCORES, TYPE_RULES, WORD_RULES
from marginalia.functions import frontmatter, lists, render, text
from marginalia.functions.text import SPACE_CLASS
from marginalia.operators import merge, notes, scoring
from marginalia.settings import ASSETS_FOLDER, INBOX_FOLDER, NOTES_FOLDER
from marginalia.sources import registry, vault

_NONE = "CAST(NULL AS VARCHAR)"
FILENAMES = rf"""
cleaned AS (
  SELECT *, trim(regexp_replace(regexp_replace(title, '[<>:"/\\|?*]', '', 'g'), '{SPACE_CLASS}+', ' ', 'g'),
                 {SPACES}) AS name
  FROM items),
named AS (
  SELECT * EXCLUDE (name), CASE WHEN length(name) <= 200 THEN name
                WHEN contains(left(name, 200), ' ') THEN regexp_replace(left(name, 200), ' [^ ]*$', '')
                ELSE left(name, 200) END || '.md' AS filename
  FROM cleaned)"""


def note_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a Markdown file with front matter, some with a broken header or number."""
    doc, lang = F.col("doc_id"), F.col("lang")
    status = (
        F.when(doc % 4 == 0, "status: classified\n").when(doc % 4 == 1, "status:\n").when(doc % 4 == 2, "status: needs-tags\n").otherwise("")
    )
    title = F.when(doc % 9 == 0, "title: [cut\n").when(doc % 9 == 1, "").otherwise(text_of('title: "Doc ', doc, '"\n'))
    rating = F.when(doc % 7 == 3, "4.6").otherwise("4")
    header = text_of(
        "---\n", title, status, "url: ' https://clip.example/", doc, " '\nsource: ''\ncreated: 2023-05-06\n",
        "tags:\n  - clippings\n  - ", lang, "\nrating: ", rating, "\nauthor: Ann\n---\n\n",
    )
    return inputs.table(spark, folder, "documents").select(
        text_of("file:/vault/00 Inbox/note ", doc, ".md").alias("path"),
        F.concat(header, F.col("text")).alias("text"),
    )


NOTE_FILES = f"""
note_files AS (
  SELECT 'file:/vault/00 Inbox/note ' || doc_id || '.md' AS original_path, 'note ' || doc_id || '.md' AS filename,
         CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'note ' || doc_id ELSE 'Doc ' || doc_id END AS title,
         trim(text, {SPACES}) AS content, 'https://clip.example/' || doc_id AS source_url,
         CASE doc_id % 4 WHEN 0 THEN 'classified' WHEN 2 THEN 'needs-tags' ELSE 'inbox' END AS existing_status,
         'clippings|' || lang AS tags, 4 AS rating, DATE '2023-05-06' AS created, doc_id % 9 = 0 OR doc_id % 7 = 3 AS bad
  FROM documents)"""


@query(
    "parse_notes",
    f"""WITH {NOTE_FILES}
    SELECT original_path, filename, title, md5(content) AS content_md5, source_url, existing_status, tags,
           'Ann' AS author, rating, created
    FROM note_files WHERE NOT bad""",
)
def parse_notes(spark: SparkSession, folder: str) -> DataFrame:
    parsed = vault.parse_notes(note_files(spark, folder)).filter("error IS NULL")
    entries = vault.existing_entries(F.col("existing"))
    return parsed.select(
        "original_path",
        "filename",
        "title",
        F.md5("content").alias("content_md5"),
        "source_url",
        "existing_status",
        F.array_join("existing_tags", "|").alias("tags"),
        F.array_join("existing_author", "|").alias("author"),
        entries["rating"].alias("rating"),
        entries["created"].cast("date").alias("created"),
    )


@query("quarantined_notes", f"WITH {NOTE_FILES} SELECT original_path FROM note_files WHERE bad")
def quarantined_notes(spark: SparkSession, folder: str) -> DataFrame:
    return vault.quarantined(vault.parse_notes(note_files(spark, folder))).select("original_path")


@query(
    "unprocessed_notes",
    f"""WITH {NOTE_FILES}
    SELECT filename, existing_status FROM note_files WHERE NOT bad AND existing_status <> 'classified'""",
)
def unprocessed_notes(spark: SparkSession, folder: str) -> DataFrame:
    return vault.unprocessed(vault.parse_notes(note_files(spark, folder))).select("filename", "existing_status")


@query(
    "inbox_scan",
    f"""WITH {NOTE_FILES}
    SELECT original_path, filename, title, md5(content) AS content_md5, source_url, false AS is_pdf
    FROM note_files WHERE NOT bad AND existing_status <> 'classified'
    UNION ALL
    SELECT 'file:/vault/00 Inbox/page.' || page_id || '.pdf', 'page.' || page_id || '.pdf', 'page.' || page_id,
           md5('[PDF file: page.' || page_id || '.pdf]'), '', true FROM pages""",
)
def inbox_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Notes, and every page as a PDF file that is only named, not read."""
    pdfs = inputs.table(spark, folder, "pages").select(
        text_of("file:/vault/00 Inbox/page.", F.col("page_id"), ".pdf").alias("path")
    )
    scanned = vault.scan_inbox(vault.parse_notes(note_files(spark, folder)), pdfs)
    return scanned.select(
        "original_path", "filename", "title", F.md5("content").alias("content_md5"), "source_url", "is_pdf"
    )


@query(
    "asset_manifest",
    f"""SELECT '{ASSETS_FOLDER}' AS folder, 'doc ' || doc_id || '.pdf' AS filename,
           octet_length(encode(text)) AS length, sha256(text) AS sha256 FROM documents""",
)
def asset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    files = inputs.table(spark, folder, "documents").select(
        text_of("file:/vault/00 Inbox/doc ", F.col("doc_id"), ".pdf").alias("path"),
        F.octet_length("text").cast("bigint").alias("length"),
        F.encode("text", "UTF-8").alias("content"),
    )
    return notes.asset_manifest(files, ASSETS_FOLDER)


MERGE_INPUT = f"""{CUTOFFS}, {ITEMS},
stated AS (
  SELECT i.*, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Existing ' || doc_id END AS ex_title,
         CASE doc_id % 4 WHEN 0 THEN 'https://item.example/' || doc_id ELSE '' END AS item_url,
         CASE doc_id % 5 WHEN 0 THEN 'https://old.example/' || doc_id WHEN 1 THEN '' END AS ex_source,
         CASE doc_id % 6 WHEN 0 THEN '[[Ann]]|Bob' ELSE '' END AS ex_author,
         CASE doc_id % 7 WHEN 0 THEN 'Web ' || lang WHEN 1 THEN '' END AS web_author,
         CASE doc_id % 5 WHEN 0 THEN DATE '2023-02-03' END AS ex_created,
         CASE doc_id % 4 WHEN 1 THEN 'paper' WHEN 2 THEN '' END AS ex_type,
         CASE doc_id % 8 WHEN 0 THEN '' ELSE 'scored ' || lang END AS description,
         CASE doc_id % 6 WHEN 0 THEN DATE '2022-01-02' WHEN 1 THEN DATE '2021-05-06'
                         WHEN 2 THEN DATE '2020-07-08' WHEN 3 THEN NULL ELSE DATE '2020-07-08' END AS published,
         CASE doc_id % 3 WHEN 0 THEN 0 END AS rating
  FROM items i)"""


@query(
    "frontmatter_merge",
    f"""WITH {MERGE_INPUT}
    SELECT doc_id, coalesce(nullif(ex_title, ''), nullif(title, '')) AS title,
           coalesce(nullif(item_url, ''), nullif(ex_source, ''), '') AS source,
           CASE WHEN ex_author <> '' THEN ex_author WHEN web_author <> '' THEN '[[' || web_author || ']]'
                ELSE '' END AS author,
           coalesce(ex_created, (SELECT as_of FROM clock)::DATE) AS created,
           coalesce(nullif(ex_type, ''), 'note') AS type,
           coalesce(nullif(description, ''), 'old ' || source) AS description, published, rating
    FROM stated""",
)
def frontmatter_merge(spark: SparkSession, folder: str) -> DataFrame:
    doc, lang = F.col("doc_id"), F.col("lang")
    none = F.lit(None).cast("string")
    now = inputs.as_of(inputs.message_bounds(spark, folder))
    item = {
        "title": F.col("title"),
        "source_url": F.when(doc % 4 == 0, text_of("https://item.example/", doc)).otherwise(""),
        "web_author": F.when(doc % 7 == 0, text_of("Web ", lang)).when(doc % 7 == 1, ""),
        "web_date": F.when(doc % 6 == 0, "2019-01-01").when(doc % 6 == 1, "2021-05-06").when(doc % 6 == 3, "garbage"),
        "published": F.when(doc % 6 != 3, "2020-07-08"),
    }
    existing = {
        "title": F.when(doc % 3 == 0, "").when(doc % 3 == 1, text_of("Existing ", doc)),
        "source": F.when(doc % 5 == 0, text_of("https://old.example/", doc)).when(doc % 5 == 1, ""),
        "author": F.when(doc % 6 == 0, F.array(F.lit(" [[Ann]] "), F.lit(""), F.lit("Bob"))),
        "created": F.when(doc % 5 == 0, "2023-02-03").when(doc % 5 == 1, "1999-01-01"),
        "type": F.when(doc % 4 == 1, "paper").when(doc % 4 == 2, ""),
        "description": text_of("old ", F.col("source")),
        "published": F.when(doc % 6 == 0, "2022-01-02T10:00:00").when(doc % 6 == 1, "2000-06-11"),
        "rating": F.when(doc % 3 == 0, 0),
        "newsletter": none, "journal": none, "doi": none, "isbn": none, "year": F.lit(None).cast("int"),
    }
    analysis = F.struct(
        F.lit("note").alias("content_type"),
        F.when(doc % 8 == 0, "").otherwise(text_of("scored ", lang)).alias("description"),
    )
    merged = merge.merged_front_matter(item, existing, analysis, now)
    merged["author"] = F.array_join(merged["author"], "|")
    shown = ("title", "source", "author", "created", "type", "description", "published", "rating")
    return inputs.items(spark, folder).select("doc_id", *(merged[name].alias(name) for name in shown))


def newsletter_items(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as scored newsletter items; one in ten has no message id."""
    doc = F.col("doc_id")
    return inputs.items(spark, folder).withColumns(
        {
            "message_id": F.when(doc % 10 != 0, text_of("m", doc)).otherwise(""),
            "newsletter_name": F.col("source"),
            "source_url": F.lit(""),
            "author": F.array(text.wikilink(F.col("source"))),
            "published": F.lit("2024-01-05").cast("date"),
            "analysis": scoring.rule_analysis(F.col("content"), WORD_RULES, TYPE_RULES),
        }
    )


@query(
    "newsletter_notes",
    f"""WITH {CUTOFFS}, {ITEMS}, {RULE_SCORES}
    SELECT doc_id, title, '' AS source, '[[' || source || ']]' AS author, source AS newsletter,
           'https://mail.google.com/mail/u/0/#all/m' || CASE WHEN doc_id % 10 <> 0 THEN doc_id END AS gmail_url,
           (SELECT as_of FROM clock)::DATE AS created, description, 'newsletter' AS type, 'classified' AS status,
           array_to_string(tags, '|') AS tags
    FROM rule_scores""",
)
def newsletter_notes(spark: SparkSession, folder: str) -> DataFrame:
    now = inputs.as_of(inputs.message_bounds(spark, folder))
    fields = notes.newsletter_front_matter(now)
    flat = fields | {"author": F.array_join(fields["author"], "|"), "tags": F.array_join(fields["tags"], "|")}
    shown = ("title", "source", "author", "newsletter", "gmail_url", "created", "description", "type", "status", "tags")
    return newsletter_items(spark, folder).select("doc_id", *(flat[name].alias(name) for name in shown))


def _named(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.items(spark, folder).withColumns(
        {"folder": F.lit(NOTES_FOLDER), "filename": text.safe_filename(F.col("title"))}
    )


@query(
    "notes_upsert",
    f"""WITH {ITEMS}, {FILENAMES},
    written AS (
      SELECT filename, doc_id, lang, 1 AS run_ts, doc_id AS seq FROM named
      UNION ALL SELECT filename, doc_id, lang, 2, -doc_id FROM named WHERE lang <> 'en')
    SELECT '{NOTES_FOLDER}' AS folder, filename, doc_id, lang, run_ts, seq FROM written
    QUALIFY row_number() OVER (PARTITION BY filename ORDER BY run_ts DESC, seq DESC) = 1""",
)
def notes_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written once, then the non-English ones again in reverse order."""
    named = _named(spark, folder).select("folder", "filename", "doc_id", "lang")
    old = named.withColumns({"run_ts": F.lit(1), "seq": F.col("doc_id")})
    new = named.filter("lang <> 'en'").withColumns({"run_ts": F.lit(2), "seq": -F.col("doc_id")})
    return notes.upsert(old, new)


@query(
    "note_collisions",
    f"""WITH {ITEMS}, {FILENAMES}
    SELECT '{NOTES_FOLDER}' AS folder, filename, count(*) AS written FROM named GROUP BY filename HAVING count(*) > 1""",
)
def note_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return notes.collisions(_named(spark, folder))


@query(
    "inbox_move",
    f"""WITH placed AS (
      SELECT CASE WHEN l.doc_id IS NOT NULL THEN '{NOTES_FOLDER}' ELSE '{INBOX_FOLDER}' END AS folder,
             'doc ' || d.doc_id || '.md' AS filename, 'inbox' AS origin, l.doc_id IS NOT NULL AS moved
      FROM documents d LEFT JOIN labels l USING (doc_id)
      UNION ALL
      SELECT '{NOTES_FOLDER}', 'doc ' || doc_id || '.md', 'old', false FROM documents WHERE lang = 'en')
    SELECT folder, filename, origin FROM placed
    QUALIFY row_number() OVER (PARTITION BY folder, filename ORDER BY moved DESC) = 1""",
)
def inbox_move(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents leave the inbox; English ones meet an older note of their name."""
    name = text_of("doc ", F.col("doc_id"), ".md").alias("filename")
    docs = inputs.table(spark, folder, "documents")
    inbox = docs.select(F.lit(INBOX_FOLDER).alias("folder"), name, F.lit("inbox").alias("origin"))
    old = docs.filter("lang = 'en'").select(F.lit(NOTES_FOLDER).alias("folder"), name, F.lit("old").alias("origin"))
    done = inputs.table(spark, folder, "labels").select(name)
    return notes.move(inbox.unionByName(old), done, INBOX_FOLDER, NOTES_FOLDER)


@query(
    "render_layouts",
    f"""WITH {ITEMS}, {RULE_SCORES},
    drawn AS (
      SELECT *, '---' || chr(10) || lang || chr(10) || '---' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10)
                || '> [!abstract] AI-Generated Summary (EN)' || chr(10) || '> ' || summary || chr(10) || chr(10) AS head,
             array_to_string(list_transform(takeaways, lambda t: '- ' || t || chr(10)), '') AS bullets,
             '## My Notes' || repeat(chr(10), 4) || '## Related' || repeat(chr(10), 2) AS tail,
             CASE WHEN doc_id % 3 = 0 THEN '## Embedded PDF' || chr(10) || chr(10) || '![[' || doc_id || '.pdf]]'
                  || chr(10) || chr(10) ELSE '' END AS pdf,
             CASE WHEN content_type IN ('paper', 'book') THEN content_type
                  WHEN doc_id % 5 = 0 THEN 'paper' WHEN doc_id % 5 = 1 THEN 'book' ELSE 'clipping' END AS layout
      FROM rule_scores)
    SELECT doc_id, layout, md5(CASE layout
      WHEN 'paper' THEN head || '## Key Contributions' || repeat(chr(10), 2) || bullets || repeat(chr(10), 2)
                        || '## Methodology' || repeat(chr(10), 4) || '## Key Findings' || repeat(chr(10), 4) || pdf || tail
      WHEN 'book' THEN head || '## Key Ideas' || repeat(chr(10), 2) || bullets || repeat(chr(10), 2)
                       || '## Chapter Notes' || repeat(chr(10), 4) || '## Quotes' || repeat(chr(10), 4) || tail
      ELSE head || '## Key Takeaways' || repeat(chr(10), 2) || bullets || repeat(chr(10), 2)
           || '## Content' || repeat(chr(10), 2) || content || repeat(chr(10), 2) || tail END) AS note_md5
    FROM drawn""",
)
def render_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """Every layout over whole contents, with a stand-in for the YAML block."""
    doc = F.col("doc_id")
    scored_items = inputs.items(spark, folder).withColumn(
        "analysis", scoring.rule_analysis(F.col("content"), WORD_RULES, TYPE_RULES)
    )
    kind = F.col("analysis.content_type")
    wanted = F.when(kind.isin("paper", "book"), kind).when(doc % 5 == 0, "paper").when(doc % 5 == 1, "book").otherwise(kind)
    drawn = scored_items.withColumn("layout", render.layout_for(wanted)).withColumn(
        "layout", F.when(F.col("layout") == "newsletter", "clipping").otherwise(F.col("layout"))
    )
    note = render.render_note(
        F.col("layout"),
        text_of("---\n", F.col("lang"), "\n---"),
        F.col("analysis.summary"),
        F.col("analysis.key_takeaways"),
        F.col("content"),
        F.when(doc % 3 == 0, text_of(doc, ".pdf")),
    )
    return drawn.select("doc_id", "layout", F.md5(note).alias("note_md5"))


INBOX_RESULT = f"""{TAXONOMY}, {CLIPS},
known AS (SELECT list(tag) AS tags FROM taxonomy),
{RULE_SCORES.replace("FROM items", "FROM enriched")}"""


@query(
    "inbox_flagship",
    f"""WITH {INBOX_RESULT},
    tagged AS (
      SELECT r.*, len(list_filter(r.tags, lambda t: list_contains(k.tags, t))) > 0 AS ok
      FROM rule_scores r CROSS JOIN known k)
    SELECT CASE WHEN ok THEN 'classified' ELSE 'needs-tags' END AS status, content_type, count(*) AS notes,
           sum(length(content))::BIGINT AS chars, count(*) FILTER (source_url <> '') AS with_source
    FROM tagged GROUP BY ALL""",
)
def inbox_flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Clips enriched from pages, scored, tags checked: notes per status and type."""
    known = registry.vocabulary(inputs.taxonomy(spark, folder))
    enriched = scored.enriched_clips(spark, folder).withColumns(
        {
            "analysis": scoring.rule_analysis(F.col("content"), WORD_RULES, TYPE_RULES),
            "existing_tags": lists.empty_list(),
        }
    )
    tagged = merge.resolve_tags(enriched, known, suggested="analysis.tags")
    return tagged.groupBy("status", F.col("analysis.content_type").alias("content_type")).agg(
        F.count("*").alias("notes"),
        F.sum(F.length("content")).alias("chars"),
        F.count_if(F.col("source_url") != "").alias("with_source"),
    )
