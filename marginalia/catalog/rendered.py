"""Checked queries: whole notes as text, with their YAML headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.catalog import inputs
from marginalia.catalog.inputs import CUTOFFS, ITEMS, text_of
from marginalia.catalog.registry import query
from marginalia.catalog.scored import RULE_SCORES, TYPE_RULES, WORD_RULES
from marginalia.catalog.written import FILENAMES, newsletter_items
from marginalia.functions import frontmatter, lists, text, yamltext
from marginalia.operators import merge, notes, scoring
from marginalia.sources import registry, vault

_BREAK = r"[\n\x{85}\x{2028}\x{2029}]"
_TOKENS = r" +|[\n\x{85}\x{2028}\x{2029}]+|[^ \n\x{85}\x{2028}\x{2029}]+"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _styled(value: str) -> str:
    """SQL columns of a text: is it quoted, and its tokens; no tokens where it needs double quotes."""
    double = rf"[^\n\x20-\x7e\x{{85}}\x{{a0}}-\x{{fefe}}\x{{ff00}}-\x{{fffd}}\x{{10000}}-\x{{10fffe}}]| {_BREAK}|{_BREAK} "
    single = f"{_BREAK}|^ | $|{yamltext._INDICATORS}"
    return f"""regexp_matches({value}, {_literal(single)}) OR regexp_full_match({value}, {_literal(yamltext._OTHER_TYPES)}) AS {value}_quoted,
    CASE WHEN NOT regexp_matches({value}, {_literal(double)}) THEN regexp_extract_all(
      CASE WHEN {value}_quoted THEN replace({value}, chr(39), repeat(chr(39), 2)) ELSE {value} END, {_literal(_TOKENS)}) END AS {value}_tokens"""


def _yaml(value: str, lead: int) -> str:
    """SQL of a styled text folded at the width: a fold over words, runs of spaces and line breaks."""
    state = "{{'t': '', 'at': 0, 'out': {out}, 'col': {col}}}"
    start = state.format(out="''", col=f"{lead} + CASE WHEN {value}_quoted THEN 2 ELSE 1 END")
    broken = state.format(out="a.out || CASE WHEN x.t[1] = chr(10) THEN chr(10) ELSE '' END || x.t || '  '", col="2")
    folded = f"""list_reduce(list_prepend({start}, list_transform({value}_tokens, lambda t, i: {{'t': t, 'at': i::INTEGER, 'out': '', 'col': 0}})),
      lambda a, x: CASE
        WHEN x.t = ' ' AND a.col > {yamltext.WIDTH} AND x.at > 1 AND x.at < len({value}_tokens) THEN {state.format(out="a.out || chr(10) || '  '", col="2")}
        WHEN regexp_matches(x.t, {_literal("^" + _BREAK)}) THEN {broken}
        ELSE {state.format(out="a.out || x.t", col="(a.col + length(x.t))::INTEGER")} END).out"""
    quote = f"CASE WHEN {value}_quoted THEN chr(39) ELSE '' END"
    return f"{quote} || {folded} || {quote}"


BLOCKS = f"""{CUTOFFS}, {ITEMS}, {RULE_SCORES},
styled AS (SELECT *, {_styled("title")}, {_styled("description")} FROM rule_scores),
blocks AS (
  SELECT *, concat_ws(chr(10), '---', 'title: ' || {_yaml("title", 6)}, 'source: ' || repeat(chr(39), 2),
    'author:', '- ' || chr(39) || '[[' || source || ']]' || chr(39), 'newsletter: ' || source,
    'published: ' || chr(39) || '2024-01-05' || chr(39),
    'gmail_url: https://mail.google.com/mail/u/0/#all/m' || CASE WHEN doc_id % 10 <> 0 THEN doc_id END,
    'created: ' || chr(39) || (SELECT as_of FROM clock)::DATE || chr(39), 'description: ' || {_yaml("description", 12)},
    'type: newsletter', 'status: classified',
    CASE WHEN len(tags) = 0 THEN 'tags: []' ELSE 'tags:' || array_to_string(list_transform(tags, lambda t: chr(10) || '- ' || t), '') END,
    '---') AS front_matter
  FROM styled)"""
_SUMMARY = """repeat(chr(10), 2) || '## Summary' || repeat(chr(10), 2) || '> [!abstract] AI-Generated Summary (EN)' || chr(10) || '> '"""
_CLOSING = "'## My Notes' || repeat(chr(10), 4) || '## Related' || repeat(chr(10), 2)"


@query("render_frontmatter", f"WITH {BLOCKS} SELECT doc_id, front_matter FROM blocks")
def render_frontmatter(spark: SparkSession, folder: str) -> DataFrame:
    now = inputs.as_of(inputs.message_bounds(spark, folder))
    front = F.struct(*(column.alias(name) for name, column in notes.newsletter_front_matter(now).items()))
    staged = newsletter_items(spark, folder).select("doc_id", front.alias("front"))
    return staged.select("doc_id", frontmatter.front_matter_yaml(F.col("front")).alias("front_matter"))


@query(
    "render_notes",
    f"""WITH {BLOCKS}, {FILENAMES.replace("FROM items", "FROM blocks")}
    SELECT filename, front_matter || {_SUMMARY} || summary || repeat(chr(10), 2)
           || '## Key Takeaways' || repeat(chr(10), 2)
           || array_to_string(list_transform(takeaways, lambda t: '- ' || t || chr(10)), '') || repeat(chr(10), 2)
           || '## Content' || repeat(chr(10), 2) || content || repeat(chr(10), 2) || {_CLOSING} AS note
    FROM named""",
)
def render_notes(spark: SparkSession, folder: str) -> DataFrame:
    now = inputs.as_of(inputs.message_bounds(spark, folder))
    items = newsletter_items(spark, folder)
    written = notes.with_text(items, notes.newsletter_front_matter(now), F.col("content"))
    return written.select(text.safe_filename(F.col("title")).alias("filename"), F.col("rendered").alias("note"))


@query(
    "pdf_notes",
    f"""WITH {CUTOFFS},
    files AS (SELECT 'page ' || page_id AS name, '[PDF file: page ' || page_id || '.pdf]' AS content, repeat(chr(39), 2) AS blank FROM pages)
    SELECT name || '.md' AS filename, 'needs-tags' AS status,
           concat_ws(chr(10), '---', 'title: ' || name, 'source: ' || blank, 'author: []',
             'created: ' || chr(39) || (SELECT as_of FROM clock)::DATE || chr(39), 'description: ' || chr(39) || content[:length(content) - 4] || chr(39),
             'type: paper', 'status: needs-tags', 'journal: ' || blank, 'doi: ' || blank, 'year: null', 'tags: []', '---')
           || {_SUMMARY} || content || repeat(chr(10), 2) || '## Key Contributions' || repeat(chr(10), 2) || '- ' || content || repeat(chr(10), 3)
           || '## Methodology' || repeat(chr(10), 4) || '## Key Findings' || repeat(chr(10), 4)
           || '## Embedded PDF' || repeat(chr(10), 2) || '![[' || name || '.pdf]]' || repeat(chr(10), 2) || {_CLOSING} AS note
    FROM files""",
)
def pdf_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Wrapper notes of pages taken as PDF files, tags checked against the taxonomy."""
    now = inputs.as_of(inputs.message_bounds(spark, folder))
    pdfs = inputs.table(spark, folder, "pages", "page_id").select(
        text_of("file:/vault/00 Inbox/page ", F.col("page_id"), ".pdf").alias("path")
    )
    items = vault.pdf_items(pdfs).withColumns(
        {
            "analysis": scoring.rule_analysis(F.col("content"), WORD_RULES, TYPE_RULES),
            "message_id": F.lit(None).cast("string"),
            "newsletter_name": F.lit(None).cast("string"),
            "author": lists.empty_list(),
            "published": F.lit(None).cast("date"),
            "web_author": F.lit(None).cast("string"),
        }
    )
    known = registry.vocabulary(inputs.taxonomy(spark, folder))
    tagged = merge.resolve_tags(items, known, suggested="analysis.tags")
    written = notes.with_text(tagged, notes.pdf_front_matter(now), F.lit(""), F.col("filename"))
    name = text.safe_filename(F.col("title")).alias("filename")
    return written.select(name, "status", F.col("rendered").alias("note"))
