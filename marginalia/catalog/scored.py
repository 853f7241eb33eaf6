"""Checked queries: page articles, enrichment, scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.catalog import inputs
from marginalia.catalog.fields import CLEAN_URL
from marginalia.catalog.inputs import ITEMS, SPACES, text_of
from marginalia.catalog.registry import query
from marginalia.functions import html, replies
from marginalia.functions.text import blank_to_null
from marginalia.operators import enrich, scoring


@query("page_text")
def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.table(spark, folder, "pages").select("page_id", html.page_text(F.col("html")).alias("text"))


@query("page_markdown")
def page_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.table(spark, folder, "pages").select("page_id", html.page_markdown(F.col("html")).alias("markdown"))


@query("page_articles")
def page_articles(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.articles(inputs.table(spark, folder, "pages"))


# Documents as captured clips of the page with the same number, their address with tracking.
def clips(spark: SparkSession, folder: str) -> DataFrame:
    links = inputs.table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), "url")
    tail = F.when(F.contains("url", F.lit("?")), text_of(F.col("url"), "&utm_medium=clip")).otherwise(F.col("url"))
    return (
        inputs.items(spark, folder)
        .join(links, "doc_id", "left")
        .withColumns({"source_url": F.coalesce(tail, F.lit("")), "is_pdf": F.lit(False)})
        .drop("url")
    )


_CLEAN_CLIP = CLEAN_URL.replace("url", "source_url").replace("clean_source_url", "clean_url")
CLIPS = f"""{ITEMS},
clips AS (
  SELECT i.*, coalesce(CASE WHEN contains(p.url, '?') THEN p.url || '&utm_medium=clip' ELSE p.url END, '')
              AS source_url
  FROM items i LEFT JOIN pages p ON p.page_id = i.doc_id),
crawled AS (
  SELECT {CLEAN_URL} AS clean_url, page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text,
         nullif(regexp_extract(html, '<html lang="([a-z]*)"', 1), '') AS author
  FROM pages WHERE html <> ''),
articles AS (
  SELECT * FROM crawled
  QUALIFY row_number() OVER (PARTITION BY clean_url ORDER BY length(text) DESC, page_id) = 1),
enriched AS (
  SELECT c.* REPLACE (CASE WHEN c.source_url <> '' THEN {_CLEAN_CLIP} ELSE '' END AS source_url,
                      CASE WHEN length(a.text) > length(c.content) THEN a.text ELSE c.content END AS content),
         a.author AS web_author
  FROM clips c LEFT JOIN articles a ON a.clean_url = {_CLEAN_CLIP} AND c.source_url <> '')"""


def enriched_clips(spark: SparkSession, folder: str) -> DataFrame:
    """Clips enriched with tag-free page text; the page language stands in for an author."""
    pages = inputs.table(spark, folder, "pages").filter(F.col("html") != "")
    crawled = pages.select(
        "page_id",
        "url",
        F.regexp_replace("html", "<[^>]*>", "").alias("text"),
        blank_to_null(F.regexp_extract("html", '<html lang="([a-z]*)"', 1)).alias("author"),
        F.lit(None).cast("string").alias("date"),
    )
    return enrich.keep_longest(clips(spark, folder), enrich.one_per_url(crawled))


@query(
    "enrich_keep_longest",
    f"""WITH {CLIPS}
    SELECT doc_id, source_url, md5(content) AS content_md5, length(content)::INTEGER AS content_chars, web_author
    FROM enriched""",
)
def enrich_keep_longest(spark: SparkSession, folder: str) -> DataFrame:
    return enriched_clips(spark, folder).select(
        "doc_id",
        "source_url",
        F.md5("content").alias("content_md5"),
        F.length("content").alias("content_chars"),
        "web_author",
    )


@query("enriched_articles")
def enriched_articles(spark: SparkSession, folder: str) -> DataFrame:
    """The same with text and metadata from the HTML reader, which reads wanted pages only."""
    captured = clips(spark, folder)
    wanted = enrich.wanted_pages(inputs.table(spark, folder, "pages"), captured)
    return enrich.keep_longest(captured, enrich.one_per_url(enrich.articles(wanted))).select(
        "doc_id", "source_url", "content", "web_author", "web_date"
    )


# Key words of the rule scorer: common words of the four languages, and marks of a type.
WORD_RULES = (
    (" the ", "lang/en"), (" und ", "lang/de"), (" que ", "lang/fr"), (" para ", "lang/es"),
    ("http", "topic/links"), ("@", "topic/contacts"),
)
TYPE_RULES = (("abstract", "paper"), ("isbn", "book"), ("http", "clipping"))

_CASES = ", ".join(f"CASE WHEN contains(lower(content), '{w}') THEN '{t}' END" for w, t in WORD_RULES)
_KINDS = " ".join(f"WHEN contains(lower(content), '{w}') THEN '{t}'" for w, t in TYPE_RULES)
RULE_SCORES = f"""
rule_scores AS (
  SELECT *, regexp_extract(trim(content, {SPACES}), '^(?:[^.!?]*[.!?]*){{1,3}}') AS summary,
         list_filter(list_transform(string_split(trim(content, {SPACES}), chr(10)),
                                    lambda x: trim(x, {SPACES})), lambda x: x <> '') AS takeaways,
         list_filter([{_CASES}], lambda t: t IS NOT NULL) AS tags,
         CASE {_KINDS} ELSE 'note' END AS content_type,
         regexp_extract(trim(content, {SPACES}), '^[^.!?]*[.!?]*') AS description
  FROM items)"""


@query(
    "rule_scores",
    f"""WITH {ITEMS}, {RULE_SCORES}
    SELECT doc_id, summary, array_to_string(takeaways, chr(10)) AS takeaways,
           array_to_string(tags, '|') AS tags, content_type, description
    FROM rule_scores""",
)
def rule_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = inputs.items(spark, folder).withColumn(
        "analysis", scoring.rule_analysis(F.col("content"), WORD_RULES, TYPE_RULES)
    )
    return scored.select(
        "doc_id",
        "analysis.summary",
        F.array_join("analysis.key_takeaways", "\n").alias("takeaways"),
        F.array_join("analysis.tags", "|").alias("tags"),
        "analysis.content_type",
        "analysis.description",
    )


class HintScorer:
    """A plug-in that fails for some texts, no German and nothing without a hint, and gives
    the tags of French texts as one text."""

    def open(self, system_prompt: str) -> Callable[[str, str | None], dict]:
        told = len(system_prompt)

        def analyze(content: str, hint: str | None) -> dict:
            if hint is None:
                raise ValueError("no hint")
            if hint == "de":
                return {"summary": "kurz", "key_takeaways": [], "tags": [], "content_type": "note"}
            return {
                "summary": f"told {told}", "key_takeaways": [hint],
                "tags": f"lang/{hint}, x" if hint == "fr" else ["lang/" + hint],
                "content_type": "note", "description": "about " + hint,
            }

        return analyze


@query(
    "error_isolation",
    """SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN 'told 9' END AS summary,
           CASE WHEN lang IN ('en', 'fr') THEN 'lang/' || lang END AS tag,
           CASE WHEN lang = 'es' THEN 'no hint'
                WHEN lang = 'de' THEN 'Missing or invalid fields: description' END AS error
    FROM documents""",
)
def error_isolation(spark: SparkSession, folder: str) -> DataFrame:
    """A Python scorer over all documents: failing rows carry their error, the rest are scored."""
    asked = inputs.items(spark, folder).withColumn("hint", F.when(F.col("lang") != "es", F.col("lang")))
    return scoring.score(asked, HintScorer(), "tags only").select(
        "doc_id", "analysis.summary", F.col("analysis.tags")[0].alias("tag"), "error"
    )


@query(
    "parse_results",
    f"""WITH {ITEMS}
    SELECT doc_id,
      CASE WHEN doc_id % 6 IN (0, 1, 5) THEN title END AS summary,
      CASE doc_id % 6 WHEN 0 THEN lang || '|' || source WHEN 1 THEN lang || '|' || source WHEN 5 THEN '' END AS tags,
      CASE doc_id % 6 WHEN 0 THEN source WHEN 1 THEN source WHEN 5 THEN source END AS takeaways,
      CASE doc_id % 6 WHEN 2 THEN 'No classify_content tool use in response'
                      WHEN 3 THEN 'Tool input is not valid JSON: cut ' || doc_id
                      WHEN 4 THEN 'Missing or invalid fields: key_takeaways, description' END AS error
    FROM items""",
)
def parse_results(spark: SparkSession, folder: str) -> DataFrame:
    """Replies with proper input, input as text, another tool, cut text, lacking fields, no tags."""
    doc, form = F.col("doc_id"), F.col("doc_id") % 6

    def fields(tags: F.Column, takeaways: F.Column, description: F.Column) -> F.Column:
        return F.to_json(
            F.struct(
                F.col("title").alias("summary"), takeaways.alias("key_takeaways"), tags.alias("tags"),
                F.lit("note").alias("content_type"), description.alias("description"),
            )
        )

    both = F.array("lang", "source")
    nothing = F.lit(None).cast("string")
    data = (
        F.when(form == 4, fields(both, F.array(doc), nothing))
        .when(form == 5, fields(F.lit(None).cast("array<string>"), F.array("source"), F.col("lang")))
        .otherwise(fields(both, F.array("source"), F.col("lang")))
    )
    as_text = F.to_json(F.struct(F.when(form == 3, text_of("cut ", doc)).otherwise(data).alias("t")))
    quoted = F.substr(as_text, F.lit(6), F.length(as_text) - 6)
    given = F.when(form.isin(1, 3), quoted).otherwise(data)
    name = F.when(form == 2, "other_tool").otherwise("classify_content")
    message = text_of(
        '{"content":[{"type":"text","text":"x"},{"type":"tool_use","name":"', name, '","input":', given, "}]}"
    )
    parsed = inputs.items(spark, folder).select("doc_id", replies.parse_reply(message).alias("r"))
    return parsed.select(
        "doc_id",
        "r.analysis.summary",
        F.array_join("r.analysis.tags", "|").alias("tags"),
        F.array_join("r.analysis.key_takeaways", "|").alias("takeaways"),
        "r.error",
    )
