"""Table and struct types shared by the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

HEADER = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])

# A landed mail message. `payload` is the MIME tree as JSON text.
MESSAGE = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("internal_date", T.LongType()),
        T.StructField("headers", T.ArrayType(HEADER)),
        T.StructField("payload", T.StringType()),
    ]
)

ANALYSIS = T.StructType(
    [
        T.StructField("summary", T.StringType()),
        T.StructField("key_takeaways", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("content_type", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

YAML_RESULT = T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())])

# The types a scorer may return.
CONTENT_TYPES = ("newsletter", "clipping", "paper", "book", "tool", "note")

FRONT_MATTER = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("author", T.ArrayType(T.StringType())),
        T.StructField("newsletter", T.StringType()),
        T.StructField("published", T.DateType()),
        T.StructField("gmail_url", T.StringType()),
        T.StructField("created", T.DateType()),
        T.StructField("description", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("journal", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("isbn", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

NOTE = T.StructType(
    [
        T.StructField("folder", T.StringType()),
        T.StructField("filename", T.StringType()),
        *FRONT_MATTER.fields,
        T.StructField("summary", T.StringType()),
        T.StructField("key_takeaways", T.ArrayType(T.StringType())),
        T.StructField("content", T.StringType()),
    ]
)

SOURCE = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("email", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("sender_name", T.StringType()),
    ]
)

SYNC_STATE = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("last_sync", T.TimestampType())]
)

LABEL = T.StructType([T.StructField("label", T.StringType()), T.StructField("label_id", T.StringType())])

PENDING_BATCH = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("pipeline", T.StringType()),
        T.StructField("submitted_at", T.TimestampType()),
        T.StructField("expires_at", T.TimestampType()),
    ]
)

RESULT = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("custom_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)
