"""The given tables in the roles the jobs expect, in Spark and as SQL for the oracle.

Every role is a projection or aggregate of a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from marginalia.functions.dates import expiry
from marginalia.functions.text import SPACE_CHARS, first_line
from marginalia.operators.incremental import source_cutoffs

SPACES = f"'{SPACE_CHARS}'"


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One of the given tables; its footer is read once per process, not once per query."""
    path = f"{folder}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path).select(*columns or "*")


def text_of(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# --- messages -----------------------------------------------------------------------------

MESSAGES = """
messages AS (
  SELECT event_id, user_id, value,
         'm' || event_id AS message_id, 't' || user_id AS thread_id,
         ts AS internal_ts, event_type AS source,
         CASE event_id % 4
           WHEN 0 THEN '"User ' || user_id || '" <user' || user_id || '@example.com>'
           WHEN 1 THEN 'User ' || user_id || ' <User' || user_id || '@Example.com>'
           WHEN 2 THEN 'user' || user_id || '@example.com'
           ELSE '<user' || user_id || '@example.com>' END AS from_header,
         event_type || ' digest ' || json_extract_string(props, '$.k') AS subject
  FROM events)"""


def messages(spark: SparkSession, folder: str) -> DataFrame:
    user, kind = F.col("user_id"), F.pmod("event_id", F.lit(4))
    address = text_of("user", user, "@example.com")
    sender = (
        F.when(kind == 0, text_of('"User ', user, '" <', address, ">"))
        .when(kind == 1, text_of("User ", user, " <User", user, "@Example.com>"))
        .when(kind == 2, address)
        .otherwise(text_of("<", address, ">"))
    )
    events = table(spark, folder, "events")
    return events.select(
        "event_id",
        "user_id",
        "value",
        text_of("m", F.col("event_id")).alias("message_id"),
        text_of("t", user).alias("thread_id"),
        F.col("ts").alias("internal_ts"),
        F.col("event_type").alias("source"),
        sender.alias("from_header"),
        text_of(F.col("event_type"), " digest ", F.get_json_object("props", "$.k")).alias("subject"),
    )


# Marks exist for three kinds of source; the others look back seven days from the newest message.
CUTOFFS = """
bounds AS (SELECT event_type AS name, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1),
clock AS (SELECT max(last_ts) AS as_of FROM bounds),
sync_state AS (
  SELECT name AS source,
         first_ts + CASE name WHEN 'click' THEN INTERVAL 20 DAY WHEN 'view' THEN INTERVAL 25 DAY
                              ELSE INTERVAL 12 DAY END AS last_sync
  FROM bounds WHERE name IN ('click', 'view', 'error')),
cutoffs AS (
  SELECT b.name, s.last_sync,
         date_trunc('day', coalesce(s.last_sync, c.as_of - INTERVAL 7 DAY))::TIMESTAMP AS search_from
  FROM bounds b CROSS JOIN clock c LEFT JOIN sync_state s ON s.source = b.name)"""

NEW_MESSAGES = f"""{MESSAGES}, {CUTOFFS},
fresh AS (
  SELECT m.* FROM messages m JOIN cutoffs c ON c.name = m.source
  WHERE CASE WHEN c.last_sync IS NOT NULL THEN m.internal_ts > c.last_sync
             ELSE m.internal_ts >= c.search_from END)"""


def message_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """First and last message per source."""
    kinds = table(spark, folder, "events").groupBy(F.col("event_type").alias("name"))
    return kinds.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def as_of(bounds: DataFrame) -> Column:
    """The time of the run: the newest message."""
    return bounds.agg(F.max("last_ts")).scalar()


def sync_state(bounds: DataFrame) -> DataFrame:
    days = F.when(F.col("name") == "click", 20).when(F.col("name") == "view", 25).otherwise(12)
    return bounds.filter(F.col("name").isin("click", "view", "error")).select(
        F.col("name").alias("source"), (F.col("first_ts") + F.make_dt_interval(days)).alias("last_sync")
    )


def cutoffs(bounds: DataFrame) -> DataFrame:
    found = source_cutoffs(bounds.select("name"), sync_state(bounds), as_of(bounds))
    return found.withColumn("search_from", F.col("search_from").cast("timestamp_ntz"))


# Senders: suppliers as registered sources, a third of them with a sender name, a third with an empty one.
SENDERS = """
senders AS (
  SELECT s_suppkey AS ord, 'user' || s_suppkey || '@example.com' AS email, s_name AS name,
         CASE s_suppkey % 3 WHEN 0 THEN 'USER ' || s_suppkey WHEN 1 THEN '' END AS sender_name
  FROM supplier)"""


def senders(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.alias("ord"),
        text_of("user", key, "@example.com").alias("email"),
        F.col("s_name").alias("name"),
        F.when(key % 3 == 0, text_of("USER ", key)).when(key % 3 == 1, "").alias("sender_name"),
    )


# --- documents ----------------------------------------------------------------------------

ITEMS = f"""
items AS (
  SELECT doc_id, doc_id::VARCHAR AS item_id, lang, source, text AS content,
         trim(split_part(text, chr(10), 1), {SPACES}) AS title
  FROM documents)"""


def items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id",
        F.col("doc_id").cast("string").alias("item_id"),
        "lang",
        "source",
        F.col("text").alias("content"),
        first_line(F.col("text")).alias("title"),
    )


# Taxonomy: sources as descriptive tags, languages as functional ones, scopes with their use.
TAXONOMY = """
usage AS (
  SELECT 'descriptive' AS kind, 'topic/' || source AS tag, count(*) AS n FROM documents GROUP BY source
  UNION ALL
  SELECT 'functional', 'lang/' || lang, count(*) FROM documents GROUP BY lang),
taxonomy AS (
  SELECT kind, (row_number() OVER (PARTITION BY kind ORDER BY tag) - 1)::INTEGER AS ord, tag,
         'used by ' || n || ' documents' AS scope
  FROM usage)"""


def taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, ord, tag, scope): pre-aggregated per source and language in one pass.

    It stands for configuration; here its size is that of the distinct sources and languages.
    """
    pairs = table(spark, folder, "documents").groupBy("source", "lang").count()

    def tags(kind: str, prefix: str, column: str) -> DataFrame:
        return pairs.groupBy(text_of(prefix, F.col(column)).alias("tag")).agg(
            F.lit(kind).alias("kind"), F.sum("count").alias("n")
        )

    used = tags("descriptive", "topic/", "source").unionByName(tags("functional", "lang/", "lang"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("tag")) - 1
    return used.select(
        "kind", place.alias("ord"), "tag", text_of("used by ", F.col("n"), " documents").alias("scope")
    )


# Rules of the taxonomy: one per language, stating how often it occurs.
RULES = """
rules AS (
  SELECT (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS ord,
         'Use lang/' || lang || ' for ' || n || ' documents' AS rule
  FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang))"""


def rules(taxonomy_tags: DataFrame) -> DataFrame:
    uses = F.replace("scope", F.lit("used by"), F.lit("for"))
    return taxonomy_tags.filter("kind = 'functional'").select(
        "ord", text_of("Use ", F.col("tag"), " ", uses).alias("rule")
    )


# --- batches ------------------------------------------------------------------------------

# Five documents make a batch. A label is a result; an unlabelled document has none.
BATCHES = f"""{CUTOFFS},
pending_items AS (
  SELECT 'batch' || (doc_id // 5) AS batch_id, 'doc' || doc_id AS custom_id, doc_id, source,
         trim(split_part(text, chr(10), 1), {SPACES}) AS title
  FROM documents),
batches AS (
  SELECT 'batch' || no AS batch_id,
         CASE WHEN no % 2 = 0 THEN 'newsletters' ELSE 'inbox' END AS pipeline,
         CASE WHEN no % 4 = 3 THEN 'in_progress' ELSE 'ended' END AS processing_status,
         c.as_of - to_days((no * 7 % 40)::INTEGER) AS submitted_at,
         c.as_of - to_days((no * 7 % 40)::INTEGER) + INTERVAL 29 DAY AS expires_at
  FROM (SELECT DISTINCT doc_id // 5 AS no FROM documents) CROSS JOIN clock c),
results AS (
  SELECT 'batch' || (doc_id // 5) AS batch_id, 'doc' || doc_id AS custom_id, doc_id, quality, toxic, 1 AS seq,
         CASE WHEN toxic = 1 THEN 'errored' ELSE 'succeeded' END AS type
  FROM labels
  UNION ALL
  SELECT 'batch' || (doc_id // 5), 'doc' || doc_id, doc_id, quality, toxic, 2,
         CASE WHEN toxic = 1 THEN 'canceled' ELSE 'expired' END
  FROM labels WHERE quality = 0 AND doc_id % 3 = 0),
classified AS (
  SELECT *, CASE WHEN type = 'succeeded' AND doc_id % 7 = 0 THEN 'Missing or invalid fields: summary'
                 WHEN type = 'succeeded' THEN NULL
                 WHEN type = 'errored' THEN 'API error: toxic text ' || doc_id
                 ELSE 'Request ' || type END AS error
  FROM results),
last_results AS (
  SELECT * FROM classified
  QUALIFY row_number() OVER (PARTITION BY batch_id, custom_id ORDER BY seq DESC) = 1),
counts AS (
  SELECT batch_id, count(*) FILTER (type = 'succeeded') AS succeeded,
         count(*) FILTER (type = 'errored') AS errored, count(*) FILTER (type = 'expired') AS expired,
         count(*) FILTER (type = 'canceled') AS canceled
  FROM last_results GROUP BY batch_id),
sized AS (SELECT batch_id, count(*) AS items FROM pending_items GROUP BY batch_id),
status AS (
  SELECT b.*, coalesce(s.items, 0) AS items, coalesce(c.succeeded, 0) AS succeeded,
         coalesce(c.errored, 0) AS errored, coalesce(c.expired, 0) AS expired,
         coalesce(c.canceled, 0) AS canceled,
         coalesce(c.errored, 0) + coalesce(c.expired, 0) AS failed,
         CASE WHEN b.processing_status = 'ended'
              THEN coalesce(c.succeeded + c.errored + c.expired + c.canceled, 0)
              ELSE coalesce(s.items, 0) END AS total,
         CASE WHEN b.processing_status = 'in_progress' THEN 'in_progress'
              WHEN coalesce(c.canceled, 0) > 0 AND c.succeeded = 0 AND c.errored = 0 THEN 'cancelled'
              WHEN coalesce(c.errored, 0) > 0 AND c.succeeded = 0 THEN 'error'
              ELSE 'complete' END AS state
  FROM batches b LEFT JOIN sized s USING (batch_id) LEFT JOIN counts c USING (batch_id)),
reconciled AS (
  SELECT p.*, b.pipeline,
         CASE WHEN r.custom_id IS NULL THEN 'no result returned by provider' ELSE r.error END AS error
  FROM pending_items p JOIN batches b USING (batch_id)
  LEFT JOIN last_results r USING (batch_id, custom_id))"""


def batch_number() -> Column:
    return F.expr("doc_id div 5")


def pending_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        text_of("batch", batch_number()).alias("batch_id"),
        text_of("doc", F.col("doc_id")).alias("custom_id"),
        "doc_id",
        "source",
        first_line(F.col("text")).alias("title"),
    )


def batches(spark: SparkSession, folder: str, now: Column) -> DataFrame:
    numbers = table(spark, folder, "documents").select(batch_number().alias("no")).distinct()
    number = F.col("no")
    submitted = now - F.make_dt_interval((number * 7 % 40).cast("int"))
    return numbers.select(
        text_of("batch", number).alias("batch_id"),
        F.when(number % 2 == 0, "newsletters").otherwise("inbox").alias("pipeline"),
        F.when(number % 4 == 3, "in_progress").otherwise("ended").alias("processing_status"),
        submitted.alias("submitted_at"),
        expiry(submitted).alias("expires_at"),
    )


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Raw results with reply text. A later `expired` or `canceled` replaces an earlier one."""
    ids = [
        text_of("batch", batch_number()).alias("batch_id"),
        text_of("doc", F.col("doc_id")).alias("custom_id"),
        "doc_id", "quality", "toxic",
    ]
    labels = table(spark, folder, "labels")
    doc = F.col("doc_id")
    reply = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.lit("tool_use").alias("type"),
                    F.lit("classify_content").alias("name"),
                    F.struct(
                        F.when(doc % 7 != 0, text_of("Document ", doc)).alias("summary"),
                        F.array(text_of("quality ", F.col("quality"))).alias("key_takeaways"),
                        F.array(text_of("quality/", F.col("quality"))).alias("tags"),
                        F.lit("note").alias("content_type"),
                        text_of("About ", doc).alias("description"),
                    ).alias("input"),
                )
            ).alias("content")
        )
    )
    toxic = F.col("toxic") == 1
    first = labels.select(
        *ids,
        F.lit(1).alias("seq"),
        F.when(toxic, "errored").otherwise("succeeded").alias("type"),
        F.when(~toxic, reply).alias("message"),
        F.when(toxic, text_of("toxic text ", doc)).alias("error"),
    )
    later = labels.filter((F.col("quality") == 0) & (doc % 3 == 0)).select(
        *ids,
        F.lit(2).alias("seq"),
        F.when(toxic, "canceled").otherwise("expired").alias("type"),
        F.lit(None).cast("string").alias("message"),
        F.lit(None).cast("string").alias("error"),
    )
    return first.unionByName(later)
