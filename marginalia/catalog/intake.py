"""Checked queries: incremental intake, sender matching, marks, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.catalog import inputs
from marginalia.catalog.inputs import CUTOFFS, MESSAGES, NEW_MESSAGES, SENDERS, text_of
from marginalia.catalog.registry import query
from marginalia.functions import text
from marginalia.operators import incremental, notes
from marginalia.settings import NEWSLETTER_LABEL
from marginalia.sources import messages as mail


def fresh_messages(spark: SparkSession, folder: str) -> DataFrame:
    bounds = inputs.message_bounds(spark, folder)
    return incremental.new_messages(inputs.messages(spark, folder), inputs.cutoffs(bounds))


def _base64url(content: F.Column) -> F.Column:
    coded = F.base64(F.encode(content, "UTF-8"))
    return F.replace(F.replace(coded, F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))


@query(
    "incremental_messages",
    f"WITH {NEW_MESSAGES} SELECT message_id, source, internal_ts FROM fresh",
)
def incremental_messages(spark: SparkSession, folder: str) -> DataFrame:
    return fresh_messages(spark, folder).select("message_id", "source", "internal_ts")


@query("source_cutoffs", f"WITH {CUTOFFS} SELECT * FROM cutoffs")
def source_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.cutoffs(inputs.message_bounds(spark, folder))


@query(
    "coarse_search",
    f"""WITH {MESSAGES}, {CUTOFFS}
    SELECT message_id, internal_ts FROM messages
    WHERE internal_ts >= (SELECT min(search_from) FROM cutoffs)""",
)
def coarse_search(spark: SparkSession, folder: str) -> DataFrame:
    marks = inputs.cutoffs(inputs.message_bounds(spark, folder))
    return incremental.coarse_search(inputs.messages(spark, folder), marks).select("message_id", "internal_ts")


@query(
    "display_names",
    f"""WITH {MESSAGES}
    SELECT message_id, CASE WHEN contains(from_header, '<')
                            THEN trim(trim(split_part(from_header, '<', 1)), '"')
                            ELSE from_header END AS display_name
    FROM messages""",
)
def display_names(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.messages(spark, folder).select(
        "message_id", text.display_name(F.col("from_header")).alias("display_name")
    )


@query(
    "sender_match",
    f"""WITH {MESSAGES}, {SENDERS},
    addressed AS (
      SELECT *, lower(coalesce(nullif(regexp_extract(from_header, '<([^<>]*)>', 1), ''), from_header)) AS address,
             CASE WHEN contains(from_header, '<') THEN lower(trim(trim(split_part(from_header, '<', 1)), '"'))
                  ELSE lower(from_header) END AS shown
      FROM messages)
    SELECT m.message_id, s.name AS source FROM addressed m JOIN senders s
      ON CASE WHEN s.sender_name <> '' THEN contains(m.shown, lower(s.sender_name))
              ELSE s.email = m.address END""",
)
def sender_match(spark: SparkSession, folder: str) -> DataFrame:
    unmatched = inputs.messages(spark, folder).select("message_id", "from_header")
    return incremental.match_senders(unmatched, inputs.senders(spark, folder)).select("message_id", "source")


@query(
    "top_k_per_source",
    f"""WITH {MESSAGES}
    SELECT source, message_id, (row_number() OVER newest)::INTEGER AS rank FROM messages
    WINDOW newest AS (PARTITION BY source ORDER BY internal_ts DESC, message_id DESC)
    QUALIFY row_number() OVER newest <= 50""",
)
def top_k_per_source(spark: SparkSession, folder: str) -> DataFrame:
    narrow = inputs.messages(spark, folder).select("source", "message_id", "internal_ts")
    return incremental.newest_per_source(narrow, 50).select("source", "message_id", "rank")


@query(
    "message_items",
    f"""WITH {MESSAGES},
    named AS (
      SELECT *, CASE WHEN contains(from_header, '<') THEN trim(trim(split_part(from_header, '<', 1)), '"')
                     ELSE from_header END AS shown
      FROM messages)
    SELECT message_id || '/' || source AS item_id, subject AS title,
           CASE WHEN event_id % 11 = 5 THEN '' ELSE 'value ' || event_id END AS content,
           CASE WHEN event_id % 11 = 5 THEN 'undecodable message body' END AS error,
           '[[' || coalesce(nullif(shown, ''), source) || ']]' AS author,
           date_trunc('milliseconds', internal_ts)::DATE AS published, source AS newsletter_name, thread_id,
           strftime(date_trunc('milliseconds', internal_ts), '%Y-%m-%d %H:%M:%S') AS internal_date
    FROM named""",
)
def message_items(spark: SparkSession, folder: str) -> DataFrame:
    """Raw messages (headers, epoch milliseconds, base64url body, some of them cut) → items."""
    body = _base64url(text_of("  value ", F.col("event_id"), "\n"))
    body = F.when(F.col("event_id") % 11 == 5, "A").otherwise(body)
    part = F.struct(F.lit("text/plain").alias("mimeType"), F.struct(body.alias("data")).alias("body"))

    def header(name: str, value: str | F.Column) -> F.Column:
        return F.struct(F.lit(name).alias("name"), (F.lit(value) if isinstance(value, str) else value).alias("value"))

    raw = inputs.messages(spark, folder).select(
        "message_id",
        "thread_id",
        "source",
        F.unix_millis(F.col("internal_ts").cast("timestamp")).alias("internal_date"),
        F.array(
            header("SUBJECT", "replaced by the later one"),
            header("from", F.col("from_header")),
            header("Subject", F.col("subject")),
        ).alias("headers"),
        F.to_json(F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(part).alias("parts"))).alias("payload"),
    )
    return mail.to_items(mail.with_headers(raw)).select(
        "item_id",
        "title",
        "content",
        "error",
        F.array_join("author", "|").alias("author"),
        "published",
        "newsletter_name",
        "thread_id",
        F.date_format("internal_ts", "yyyy-MM-dd HH:mm:ss").alias("internal_date"),
    )


# What ends a word that HTML shows as it is.
_MAIL_GAP = r"\x00-\x20<>&\x7f-\x{a0}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}"
_MAIL_WORD = f"[^{_MAIL_GAP}]+"


@query(
    "mime_bodies",
    """SELECT d.doc_id, md5(d.text) AS plain_md5, md5(p.html) AS html_md5
    FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""",
)
def mime_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Document text and page HTML as nested multipart mails, read back part by part."""
    from marginalia.functions import mime

    def part(kind: str, column: str) -> F.Column:
        return F.struct(F.lit(kind).alias("mimeType"), F.struct(_base64url(F.col(column)).alias("data")).alias("body"))

    pages = inputs.table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), "html")
    docs = inputs.table(spark, folder, "documents", "doc_id", "text").join(pages, "doc_id", "left")
    inner = F.struct(
        F.lit("multipart/alternative").alias("mimeType"),
        F.array(part("text/plain", "text"), part("text/html", "html")).alias("parts"),
    )
    payload = F.to_json(F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(inner).alias("parts")))
    parts = docs.select("doc_id", mime.walk(payload).alias("parts"))
    return parts.select(
        "doc_id",
        F.md5(mime.decode_part(F.col("parts.plain"))).alias("plain_md5"),
        F.md5(mime.decode_part(F.col("parts.html"))).alias("html_md5"),
    )


@query(
    "service_messages",
    f"""WITH mails AS (
      SELECT d.doc_id, source, array_to_string(regexp_extract_all(d.text, '{_MAIL_WORD}'), ' ') AS words,
             trim(d.text, {inputs.SPACES}) AS plain
      FROM documents d)
    SELECT 's' || doc_id || '/' || source AS item_id, 'Number ' || doc_id AS title, '[[' || source || ']]' AS author,
           md5(CASE WHEN doc_id % 2 = 0 THEN words ELSE plain END) AS content_md5,
           make_date(2024, 1, (1 + doc_id % 28)::INTEGER) AS published
    FROM mails""",
)
def service_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as mails in the service's own JSON, half of them HTML, three levels down, → items."""
    docs = inputs.table(spark, folder, "documents", "doc_id", "source", "text")
    # Gaps are replaced: taking words out one by one copies the whole text for each.
    words = F.trim(F.regexp_replace("text", f"[{_MAIL_GAP}]+", " "))
    page = F.concat(F.lit("<html><head><style>p {}</style></head><body><nav>Home</nav><article><p>"), words, F.lit("</p></article></body></html>"))

    def part(kind: str, body: F.Column) -> F.Column:
        return F.struct(F.lit(kind).alias("mimeType"), F.struct(_base64url(body).alias("data")).alias("body"))

    def within(kind: str, *parts: F.Column) -> F.Column:
        return F.struct(F.lit(kind).alias("mimeType"), F.array(*parts).alias("parts"))

    marked = F.when(F.col("doc_id") % 2 == 0, page).otherwise("")
    tree = within("multipart/mixed", within("multipart/related", within("multipart/alternative", part("text/plain", F.col("text")), part("text/html", marked))))
    headers = F.array(
        F.struct(F.lit("SUBJECT").alias("name"), text_of("Number ", F.col("doc_id")).alias("value")),
        F.struct(F.lit("From").alias("name"), F.lit("<mail@example.com>").alias("value")),
    )
    noon = F.make_timestamp(F.lit(2024), F.lit(1), (1 + F.col("doc_id") % 28).cast("int"), F.lit(12), F.lit(0), F.lit(0))
    mails = docs.select(
        F.to_json(
            F.struct(
                text_of("s", F.col("doc_id")).alias("id"),
                F.unix_millis(noon).cast("string").alias("internalDate"),
                F.struct(tree["mimeType"].alias("mimeType"), tree["parts"].alias("parts"), headers.alias("headers")).alias("payload"),
                F.lit("unread").alias("labelIds"),
            )
        ).alias("value")
    )
    owners = docs.select(text_of("s", F.col("doc_id")).alias("message_id"), "source")
    items = mail.to_items(mail.with_headers(mail.from_service(mails)).join(owners, "message_id"))
    return items.select("item_id", "title", F.array_join("author", "|").alias("author"), F.md5("content").alias("content_md5"), "published")


def scored_messages(spark: SparkSession, folder: str) -> DataFrame:
    """New messages; those of kind `error` with a low value count as failed."""
    failed = (F.col("source") == "error") & (F.col("value") < 10)
    fresh = fresh_messages(spark, folder)
    return fresh.withColumns(
        {"title": F.col("subject"), "error": F.when(failed, text_of("low value in ", F.col("message_id")))}
    )


SCORED = f"""{NEW_MESSAGES},
scored AS (
  SELECT *, subject AS title,
         CASE WHEN source = 'error' AND value < 10 THEN 'low value in ' || message_id END AS error
  FROM fresh)"""


@query(
    "sync_advance",
    f"""WITH {SCORED},
    found AS (SELECT source, max(internal_ts) FILTER (error IS NULL) AS last_sync FROM scored GROUP BY source)
    SELECT source, greatest(s.last_sync, f.last_sync) AS last_sync
    FROM sync_state s FULL JOIN (SELECT * FROM found WHERE last_sync IS NOT NULL) f USING (source)""",
)
def sync_advance(spark: SparkSession, folder: str) -> DataFrame:
    marks = incremental.new_marks(scored_messages(spark, folder), F.col("error").isNull())
    return incremental.advance_marks(inputs.sync_state(inputs.message_bounds(spark, folder)), marks)


@query(
    "label_messages",
    f"""WITH {SCORED},
    labelled AS (SELECT message_id FROM messages WHERE value > 50)
    SELECT message_id, 'Newsletters' AS label FROM scored
    WHERE error IS NULL AND message_id NOT IN (SELECT message_id FROM labelled)""",
)
def label_messages(spark: SparkSession, folder: str) -> DataFrame:
    labelled = inputs.messages(spark, folder).filter("value > 50").select(
        "message_id", F.lit(NEWSLETTER_LABEL).alias("label")
    )
    written = scored_messages(spark, folder).filter("error IS NULL")
    return notes.label_messages(labelled, written, NEWSLETTER_LABEL)


@query(
    "label_dim",
    """WITH had AS (SELECT source AS label, 'given-' || source AS label_id FROM documents GROUP BY source),
    wanted AS (SELECT event_type AS label FROM events UNION SELECT source FROM documents)
    SELECT label, coalesce(h.label_id, 'label-' || sha256(label)) AS label_id
    FROM wanted LEFT JOIN had h USING (label)""",
)
def label_dim(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of all message kinds and document sources; those of the sources exist already."""
    kinds = inputs.messages(spark, folder).select(F.col("source").alias("label")).distinct()
    sources = inputs.table(spark, folder, "documents").select(F.col("source").alias("label")).distinct()
    had = sources.withColumn("label_id", text_of("given-", F.col("label")))
    return notes.ensure_labels(had, kinds.unionByName(sources))


@query(
    "registry_check",
    """WITH registry AS (
      SELECT CASE WHEN s_acctbal >= 0 THEN 'user' || s_suppkey || '@example.com' END AS email,
             CASE WHEN s_nationkey > 0 THEN s_name END AS name
      FROM supplier),
    checked AS (
      SELECT CASE WHEN email IS NULL AND name IS NULL THEN 'missing: email, name'
                  WHEN email IS NULL THEN 'missing: email' WHEN name IS NULL THEN 'missing: name' END AS problem
      FROM registry),
    tags AS (
      SELECT 'descriptive' AS kind, source AS tag FROM documents GROUP BY source
      UNION ALL SELECT 'functional', lang FROM documents GROUP BY lang)
    SELECT 'sources' AS part, coalesce(problem, 'ok') AS item, count(*) AS n FROM checked GROUP BY ALL
    UNION ALL SELECT 'taxonomy', kind, count(*) FROM tags GROUP BY ALL""",
)
def registry_check(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that lack a required field, and the number of tags of each kind."""
    from marginalia.sources import registry

    senders = inputs.table(spark, folder, "supplier").select(
        F.when(F.col("s_acctbal") >= 0, text_of("user", F.col("s_suppkey"), "@example.com")).alias("email"),
        F.when(F.col("s_nationkey") > 0, F.col("s_name")).alias("name"),
    )
    problems = registry.checked(senders).groupBy(F.coalesce("problem", F.lit("ok")).alias("item"))
    tags = inputs.taxonomy(spark, folder).groupBy(F.col("kind").alias("item"))

    def part(name: str, groups) -> DataFrame:
        return groups.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "item", "n")

    return part("sources", problems).unionByName(part("taxonomy", tags))


@query("taxonomy_dim", f"WITH {inputs.TAXONOMY} SELECT * FROM taxonomy")
def taxonomy_dim(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.taxonomy(spark, folder)


def _prompt_sql() -> str:
    from marginalia.sources.registry import INSTRUCTIONS

    return f"""WITH {inputs.TAXONOMY}, {inputs.RULES}
    SELECT replace(replace('{INSTRUCTIONS}', '{{tags}}',
             (SELECT string_agg('  - ' || tag || ': ' || scope, chr(10) ORDER BY kind, ord) FROM taxonomy)),
             '{{rules}}', (SELECT string_agg('  - ' || rule, chr(10) ORDER BY ord) FROM rules)) AS prompt"""


@query("system_prompt", _prompt_sql())
def system_prompt(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.sources import registry

    tags = inputs.taxonomy(spark, folder)
    return registry.system_prompt(tags, inputs.rules(tags))
