"""Checked queries: scalar and list operators over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia.catalog import inputs
from marginalia.catalog.inputs import CUTOFFS, ITEMS, SPACES, TAXONOMY, text_of
from marginalia.catalog.registry import query
from marginalia.functions import dates, frontmatter, html, lists, replies, text, urls
from marginalia.functions.text import SPACE_CLASS
from marginalia.operators import merge
from marginalia.sources import registry


@query(
    "safe_filenames",
    rf"""WITH named AS (
      SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[<>:"/\\|?*]', '', 'g'),
                                         '{SPACE_CLASS}+', ' ', 'g'), {SPACES}) AS name
      FROM documents),
    cut AS (SELECT *, left(name, 200) AS head FROM named)
    SELECT doc_id, CASE WHEN length(name) <= 200 THEN name
                        WHEN contains(head, ' ') THEN regexp_replace(head, ' [^ ]*$', '')
                        ELSE head END || '.md' AS filename
    FROM cut""",
)
def safe_filenames(spark: SparkSession, folder: str) -> DataFrame:
    """The whole text stands in for the title, so that the cut is reached."""
    return inputs.table(spark, folder, "documents").select(
        "doc_id", text.safe_filename(F.col("text")).alias("filename")
    )


@query(
    "analysis_prompts",
    """WITH prompts AS (
      SELECT doc_id, CASE WHEN lang <> 'en' THEN 'Content source hint: ' || source || chr(10) ELSE '' END
             || 'Analyze the following content:' || chr(10) || chr(10) || left(text, 6000)
             || CASE WHEN length(text) > 6000 THEN chr(10) || chr(10) || '[... truncated, '
                     || (length(text) - 6000) || ' chars omitted]' ELSE '' END AS prompt
      FROM documents)
    SELECT doc_id, md5(prompt) AS prompt_md5, length(prompt)::INTEGER AS prompt_chars FROM prompts""",
)
def analysis_prompts(spark: SparkSession, folder: str) -> DataFrame:
    hint = F.when(F.col("lang") != "en", F.col("source")).otherwise("")
    prompts = inputs.table(spark, folder, "documents").select(
        "doc_id", text.analysis_prompt(F.col("text"), hint).alias("prompt")
    )
    return prompts.select("doc_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"))


TITLES = rf"""
titles AS (
  SELECT page_id, url, html, nullif(trim(replace(replace(replace(replace(replace(replace(
           regexp_extract(html, '{html.TITLE_PATTERN}', 1), '&lt;', '<'), '&gt;', '>'),
           '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), {SPACES}), '') AS title,
         regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1) AS domain
  FROM pages)"""


@query("page_titles", f"WITH {TITLES} SELECT page_id, title FROM titles")
def page_titles(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.table(spark, folder, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


@query(
    "page_metadata",
    rf"""WITH {TITLES}
    SELECT page_id, title,
           CASE page_id % 3 WHEN 0 THEN 'Ann & Bob ' || page_id || ' ' || chr((200 + page_id % 50)::INTEGER) || ' © 20…'
                            WHEN 1 THEN 'O''Hare <' || page_id || '>' END AS author,
           CASE page_id % 4 WHEN 0 THEN '2024-0' || (page_id % 9 + 1) || '-1' || page_id % 10
                            WHEN 1 THEN '2023-12-0' || (page_id % 9 + 1) END AS date,
           CASE page_id % 5 WHEN 0 THEN 'https://x.example/' || page_id || '?a=1&b=2&lang=en'
                            WHEN 1 THEN 'https://og.example/' || page_id END AS canonical_url
    FROM titles""",
)
def page_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with tags of many spellings before them: names, order, quotes, references, empty values."""
    page = F.col("page_id")
    code = (200 + page % 50).cast("string")
    author = (
        F.when(page % 3 == 0, text_of('<META content="Ann &amp; Bob ', page, " &#", code, ';&#32;&copy 20&hellip;"\n Name=\'Author\'>'))
        .when(page % 3 == 1, text_of('<meta name="author" content=""><meta property="article:author" content="O&#x27;Hare &lt;', page, '&gt">'))
        .otherwise('<meta name="authors" content="nobody">')
    )
    date = (
        F.when(page % 4 == 0, text_of("<meta itemprop='datePublished' content='2024-0", page % 9 + 1, "-1", page % 10, "T10:00:00Z'/>"))
        .when(page % 4 == 1, text_of('<meta name="date" content="2023-12-0', page % 9 + 1, '">'))
        .otherwise('<meta name="date" content="last week">')
    )
    link = (
        F.when(page % 5 == 0, text_of('<link href="https://x.example/', page, '?a=1&amp;b=2&lang=en" rel=\'canonical\'>'))
        .when(page % 5 == 1, text_of('<link rel="icon" href="/i.png"><meta property="og:url" content=" https://og.example/', page, ' ">'))
        .otherwise('<link rel="stylesheet" href="/s.css">')
    )
    # The page's own title stays the first one.
    whole = F.concat(author, date, F.col("html"), link)
    return inputs.table(spark, folder, "pages").select("page_id", html.page_metadata(whole).alias("_meta")).select("page_id", "_meta.*")


@query("domains", f"WITH {TITLES} SELECT page_id, domain FROM titles")
def domains(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.table(spark, folder, "pages").select("page_id", urls.network_location(F.col("url")).alias("domain"))


@query("domain_counts", f"WITH {TITLES} SELECT domain, count(*) AS n FROM titles GROUP BY domain")
def domain_counts(spark: SparkSession, folder: str) -> DataFrame:
    return domains(spark, folder).groupBy("domain").agg(F.count("*").alias("n"))


@query(
    "hints",
    f"""WITH {TITLES},
    stated AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE title END AS title,
                      CASE WHEN page_id % 3 = 0 THEN '' ELSE domain END AS domain FROM titles)
    SELECT page_id, nullif(concat_ws(' ', nullif(title, ''), '(' || nullif(domain, '') || ')'), '') AS hint
    FROM stated""",
)
def hints(spark: SparkSession, folder: str) -> DataFrame:
    page = F.col("page_id")
    title = F.when(page % 5 == 0, "").otherwise(html.page_title(F.col("html")))
    domain = F.when(page % 3 == 0, "").otherwise(urls.network_location(F.col("url")))
    return inputs.table(spark, folder, "pages").select("page_id", text.content_hint(title, domain).alias("hint"))


_TRACKED = ", ".join(f"'{key}'" for key in urls.TRACKING_KEYS)
CLEAN_URL = rf"""CASE WHEN regexp_extract(url, '^[^?#]*\?([^#]*)', 1) = '' THEN url ELSE
      regexp_extract(url, '^[^?#]*') || coalesce('?' || nullif(array_to_string(list_transform(list_filter(
        string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
        lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_')
                  AND lower(split_part(p, '=', 1)) NOT IN ({_TRACKED})),
        lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&'), ''), '')
      || coalesce('#' || nullif(regexp_extract(url, '#(.*)$', 1), ''), '') END"""


@query(
    "clean_urls",
    f"""SELECT page_id, {CLEAN_URL} AS clean_url,
           'https://Ex.com/a?id=' || page_id || '&empty=&t=a+b+c~%2A%25zz#sec' AS clean_variant
    FROM pages""",
)
def clean_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Page addresses, and one made from the page id that needs every repair."""
    variant = text_of("HTTPS://Ex.com/a?UTM_x=1&Ref=2&id=", F.col("page_id"), "&&empty&t=a%20b+c~*%zz#sec")
    return inputs.table(spark, folder, "pages").select(
        "page_id",
        urls.clean_url(F.col("url")).alias("clean_url"),
        urls.clean_url(variant).alias("clean_variant"),
    )


@query(
    "source_url_pick",
    """WITH meta AS (
      SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '  ' END AS source,
             CASE WHEN page_id % 3 = 0 THEN ' ' || url || ' ' END AS u,
             CASE WHEN page_id % 5 = 0 THEN 'https://link.example/' || page_id END AS link,
             CASE WHEN page_id % 2 = 0 THEN '' END AS clipped,
             CASE WHEN page_id % 7 = 0 THEN 'https://perma.example/' || page_id END AS perma
      FROM pages)
    SELECT page_id, coalesce(nullif(trim(source), ''), nullif(trim(u), ''), nullif(trim(link), ''),
                             nullif(trim(clipped), ''), nullif(trim(perma), ''), '') AS source_url
    FROM meta""",
)
def source_url_pick(spark: SparkSession, folder: str) -> DataFrame:
    page, url = F.col("page_id"), F.col("url")
    picked = frontmatter.source_url(
        F.when(page % 4 == 0, url).when(page % 4 == 1, "  "),
        F.when(page % 3 == 0, text_of(" ", url, " ")),
        F.when(page % 5 == 0, text_of("https://link.example/", page)),
        F.when(page % 2 == 0, ""),
        F.when(page % 7 == 0, text_of("https://perma.example/", page)),
    )
    return inputs.table(spark, folder, "pages").select("page_id", picked.alias("source_url"))


@query(
    "sane_dates",
    f"""WITH {CUTOFFS},
    days AS (SELECT o_orderkey, (o_orderdate + to_years((o_orderkey % 32)::INTEGER))::DATE AS d,
                    o_orderkey % 7 AS form FROM orders)
    SELECT o_orderkey, CASE WHEN form < 5 AND year(d) BETWEEN 2005 AND year(c.as_of) + 1 THEN d END AS day
    FROM days CROSS JOIN clock c""",
)
def sane_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Order days shifted by up to 31 years, written in five readable and two unreadable forms."""
    now = inputs.as_of(inputs.message_bounds(spark, folder))
    key = F.col("o_orderkey")
    day = F.to_date(F.add_months("o_orderdate", (key % 32 * 12).cast("int")))
    form = key % 7
    week = F.concat(
        F.extract(F.lit("YEAROFWEEK"), day).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
        F.lit("-"),
        (F.weekday(day) + 1).cast("string"),
    )
    written = (
        F.when(form == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(form == 1, F.date_format(day, "yyyyMMdd"))
        .when(form == 2, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 3, week)
        .when(form == 4, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .when(form == 5, F.date_format(day, "dd.MM.yyyy"))
        .otherwise(F.date_format(day, "yyyy-02-31"))
    )
    orders = inputs.table(spark, folder, "orders", "o_orderkey", "o_orderdate")
    return orders.select("o_orderkey", dates.sane_date(written, now).alias("day"))


@query(
    "str_lists",
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN source WHEN 1 THEN lang || '|' || source
                       WHEN 5 THEN doc_id || '|' || lang ELSE '' END AS items
    FROM documents""",
)
def str_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Text, list with blanks and nulls, number, null, blank, mixed list."""
    doc, lang, source = F.col("doc_id"), F.col("lang"), F.col("source")
    form = doc % 6
    meta = (
        F.when(form == 0, text_of('{"v":"  ', source, ' "}'))
        .when(form == 1, text_of('{"v":[" ', lang, '", null, "  ", "', source, '"]}'))
        .when(form == 2, text_of('{"v":', doc, "}"))
        .when(form == 3, '{"v":null}')
        .when(form == 4, '{"v":"   "}')
        .otherwise(text_of('{"v":[', doc, ', "', lang, '"]}'))
    )
    value = F.try_variant_get(F.parse_json(meta), "$.v", "variant")
    return inputs.table(spark, folder, "documents").select(
        "doc_id", F.array_join(lists.variant_list(value), "|").alias("items")
    )


SUGGESTED = """
suggested AS (
  SELECT doc_id, ['clippings', 'lang/' || lang, 'clippings'] AS existing_tags,
         CASE doc_id % 4
           WHEN 0 THEN ['topic/' || source, ' lang/' || lang || ' ', 'topic/unknown', 'topic/' || source]
           WHEN 1 THEN ['topic/' || lang, 'clippings'] WHEN 2 THEN ['lang/' || lang, '']
           ELSE [] END AS tags
  FROM documents)"""


def suggested(spark: SparkSession, folder: str) -> DataFrame:
    lang, source = F.col("lang"), F.col("source")
    form = F.col("doc_id") % 4
    given = (
        F.when(
            form == 0,
            F.array(text_of("topic/", source), text_of(" lang/", lang, " "), F.lit("topic/unknown"), text_of("topic/", source)),
        )
        .when(form == 1, F.array(text_of("topic/", lang), F.lit("clippings")))
        .when(form == 2, F.array(text_of("lang/", lang), F.lit("")))
        .otherwise(lists.empty_list())
    )
    return inputs.table(spark, folder, "documents").select(
        "doc_id",
        F.array(F.lit("clippings"), text_of("lang/", lang), F.lit("clippings")).alias("existing_tags"),
        given.alias("tags"),
    )


@query(
    "tag_merge",
    f"""WITH {TAXONOMY}, {SUGGESTED},
    valid AS (
      SELECT s.*, list_filter(list_transform(tags, lambda t: trim(t)),
                              lambda t: list_contains(v.known, t)) AS kept
      FROM suggested s CROSS JOIN (SELECT list(tag) AS known FROM taxonomy) v)
    SELECT doc_id, CASE WHEN len(kept) > 0 THEN 'classified' ELSE 'needs-tags' END AS status,
           array_to_string(existing_tags || list_filter(kept,
             lambda t, i: NOT list_contains(existing_tags, t) AND list_position(kept, t) = i), '|') AS merged_tags
    FROM valid""",
)
def tag_merge(spark: SparkSession, folder: str) -> DataFrame:
    known = registry.vocabulary(inputs.taxonomy(spark, folder))
    merged = merge.resolve_tags(suggested(spark, folder), known)
    return merged.select("doc_id", F.array_join("merged_tags", "|").alias("merged_tags"), "status")


@query(
    "tag_rejects",
    f"""WITH {TAXONOMY}, {SUGGESTED},
    one AS (SELECT doc_id, trim(unnest(tags)) AS tag FROM suggested)
    SELECT doc_id, tag FROM one WHERE tag <> '' AND tag NOT IN (SELECT tag FROM taxonomy)""",
)
def tag_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return merge.tag_rejects(suggested(spark, folder), inputs.taxonomy(spark, folder), "doc_id")


def _raw_takeaways() -> Column:
    doc, first = F.col("doc_id"), F.col("title")
    quoted = F.to_json(F.array(first, F.col("source")))
    form = doc % 7
    return (
        F.when(form == 0, text_of("- ", first, "\n-\n\n  - ", F.col("source"), "\nplain"))
        .when(form == 1, text_of("  ", quoted, "\n"))
        .when(form == 2, text_of(quoted, " and more"))
        .when(form == 3, text_of("[", doc, ", 2]"))
        .when(form == 4, " \n- \n")
        .when(form == 5, text_of('["', F.col("source")))
        .otherwise(F.col("content"))
    )


@query(
    "takeaway_repair",
    rf"""WITH {ITEMS},
    lines AS (
      SELECT *, list_transform(list_filter(string_split(trim(content, {SPACES}), chr(10)),
                  lambda x: trim(x, {SPACES}) NOT IN ('', '-')),
                  lambda x: trim(trim(x, '- '), {SPACES})) AS body
      FROM items)
    SELECT doc_id, CASE doc_id % 7
      WHEN 0 THEN trim(trim(title, '- '), {SPACES}) || '|' || source || '|plain'
      WHEN 1 THEN title || '|' || source
      WHEN 2 THEN to_json([title, source])::VARCHAR || ' and more'
      WHEN 3 THEN NULL
      WHEN 5 THEN '["' || source
      WHEN 6 THEN CASE WHEN starts_with(trim(content, {SPACES}), '[') THEN trim(content, {SPACES})
                       WHEN len(body) > 0 THEN array_to_string(body, '|')
                       ELSE 'Unable to extract takeaways' END
      ELSE 'Unable to extract takeaways' END AS takeaways
    FROM lines""",
)
def takeaway_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Bullet text, JSON list, JSON with a tail, numbers, blank, cut JSON, the whole text."""
    repaired = replies.repair_takeaways(_raw_takeaways())
    return inputs.items(spark, folder).select("doc_id", F.array_join(repaired, "|").alias("takeaways"))


@query(
    "tag_repair",
    f"""WITH {ITEMS}
    SELECT doc_id, CASE doc_id % 5
      WHEN 0 THEN lang || '|' || source WHEN 1 THEN source WHEN 4 THEN NULL ELSE '' END AS tags
    FROM items""",
)
def tag_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Comma-separated, JSON list, cut JSON, blank, JSON numbers."""
    doc, lang, source = F.col("doc_id"), F.col("lang"), F.col("source")
    form = doc % 5
    raw = (
        F.when(form == 0, text_of(" ", lang, " , ,", source, ","))
        .when(form == 1, text_of(' ["', source, '"] '))
        .when(form == 2, text_of('["', source, '"'))
        .when(form == 3, "  ")
        .otherwise(text_of("[", doc, "]"))
    )
    return inputs.items(spark, folder).select("doc_id", F.array_join(replies.repair_tags(raw), "|").alias("tags"))
