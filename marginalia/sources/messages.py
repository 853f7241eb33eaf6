"""Landed mail messages → items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia import schemas
from marginalia.functions import dates, html, mime, text
from marginalia.functions.planning import pinned
from marginalia.operators import incremental


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Message table or JSON-lines drop folder, typed, with ``internal_ts`` and ``from_header``."""
    return with_headers(spark.read.schema(schemas.MESSAGE).format(fmt).load(path))


def land(messages: DataFrame, path: str) -> None:
    """Add typed messages (``with_headers``) to a landed table, one folder per day and part of the senders."""
    address = incremental.sender_address(F.col("from_header"))
    sliced = messages.withColumn("slice", incremental.slice_of(F.col("internal_ts"), address))
    sliced.repartition("slice").write.mode("append").partitionBy("slice").parquet(path)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """The landed table; runs over it read the folders that their sources need."""
    return spark.read.parquet(path)


def read_service(spark: SparkSession, path: str) -> DataFrame:
    """Messages as the mail service gives them, one JSON object a line, typed like ``read_messages``."""
    return with_headers(from_service(spark.read.text(path)))


def from_service(lines: DataFrame) -> DataFrame:
    """``value``: a message in the service's own layout (id, threadId, internalDate as text, the headers
    inside payload) → a row of ``schemas.MESSAGE``. A line that is no such object gives an empty row,
    which becomes a dead letter."""
    # A join by message_id brings a filter on it, which would parse every line once more.
    read = lines.select(pinned(F.try_parse_json("value")).alias("_m"))

    def entry(path: str, kind: str) -> Column:
        return F.try_variant_get("_m", path, kind)

    return read.select(
        entry("$.id", "string").alias("message_id"),
        F.coalesce(entry("$.threadId", "string"), F.lit("")).alias("thread_id"),
        # A missing or unreadable date is the epoch.
        F.coalesce(entry("$.internalDate", "string").try_cast("long"), F.lit(0)).cast("long").alias("internal_date"),
        entry("$.payload.headers", "array<struct<name:string,value:string>>").alias("headers"),
        F.to_json(entry("$.payload", "variant")).alias("payload"),
    )


def with_headers(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {
            "internal_ts": dates.from_epoch_ms(F.col("internal_date")),
            "from_header": F.coalesce(mime.header(F.col("headers"), "from"), F.lit("")),
            "subject": F.coalesce(mime.header(F.col("headers"), "subject"), F.lit("Untitled")),
        }
    )


def to_items(messages: DataFrame, source: str = "source") -> DataFrame:
    """Message rows (already matched to a source) → items.

    A payload that cannot be read, or a body that cannot be decoded, gives ``error`` instead
    of content.
    """
    walked = messages.withColumn("_parts", mime.walk(F.col("payload")))
    bodies = walked.withColumns(
        {"_html": mime.decode_part(F.col("_parts.html")), "_plain": mime.decode_part(F.col("_parts.plain"))}
    )
    broken = [F.col(f"_parts.{kind}").isNotNull() & F.col(f"_{kind}").isNull() for kind in ("html", "plain")]
    has_html = F.coalesce("_html", F.lit("")) != ""
    shown = text.display_name(F.col("from_header"))
    return bodies.select(
        # A message that matches two sources is two items.
        F.concat_ws("/", "message_id", source).alias("item_id"),
        F.lit("gmail").alias("source_type"),
        F.col("subject").alias("title"),
        mime.choose_body(html.mail_text(F.col("_html")), has_html, F.col("_plain")).alias("content"),
        F.lit("").alias("source_url"),
        F.array(text.wikilink(text.first_truthy(shown, F.col(source)))).alias("author"),
        F.to_date("internal_ts").alias("published"),
        F.col(source).alias("newsletter_name"),
        F.col(source).alias("source"),
        F.col("message_id"),
        F.col("thread_id"),
        F.col("internal_ts"),
        F.when(F.col("_parts").isNull(), F.lit("unreadable message payload"))
        .when(broken[0] | broken[1], F.lit("undecodable message body"))
        .alias("error"),
    )
