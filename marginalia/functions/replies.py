"""Repair and validation of scorer replies, all as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marginalia import schemas
from marginalia.functions.lists import empty_list
from marginalia.functions.planning import let
from marginalia.functions.text import strip

# Name of the tool block, and what stands in for unreadable takeaways.
TOOL_NAME = "classify_content"
NO_TAKEAWAYS = "Unable to extract takeaways"


def strict_json(text: Column) -> Column:
    """The text as VARIANT if the whole of it is one JSON value, else null.

    The JSON reader stops after the first value and ignores what follows. Text
    that is valid both inside ``[]`` and inside ``{"v":}`` has nothing following.
    """
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_map = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(in_list.isNotNull() & in_map.isNotNull(), F.try_parse_json(text))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text(value: Column) -> Column:
    """A variant as text if it is a string, else null."""
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _text_list(value: Column) -> Column:
    """A variant as a list if all its elements are strings, else null."""
    return let(
        F.try_variant_get(value, "$", "array<string>"),
        lambda items: F.when(
            _kind(value).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(items, F.isnull), items
        ),
    )


def _json_list(body: Column, broken: Column) -> Column:
    return let(
        strict_json(body), lambda parsed: F.when(parsed.isNull(), broken).otherwise(_text_list(parsed))
    )


def _bullets(body: Column) -> Column:
    lines = F.filter(F.split(body, "\n"), lambda line: ~strip(line).isin("", "-"))
    return let(
        F.transform(lines, lambda line: strip(F.trim(line, F.lit("- ")))),
        lambda items: F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(NO_TAKEAWAYS))),
    )


def repair_takeaways(text: Column) -> Column:
    """Takeaways given as one text. Null means a JSON list with elements that are no text."""
    return let(
        strip(text),
        lambda body: F.when(
            F.startswith(body, F.lit("[")), _json_list(body, broken=F.array(body))
        ).otherwise(_bullets(body)),
    )


def repair_tags(text: Column) -> Column:
    """Tags given as one text: JSON list or comma-separated; broken JSON gives none."""
    return let(
        strip(text),
        lambda body: F.when(
            F.startswith(body, F.lit("[")), _json_list(body, broken=empty_list())
        ).otherwise(F.filter(F.transform(F.split(body, ","), strip), lambda t: t != "")),
    )


def _read_fields(data: Column) -> Column:
    def entry(name: str) -> Column:
        return F.try_variant_get(data, f"$.{name}", "variant")

    return F.struct(
        let(entry("summary"), _text).alias("summary"),
        let(
            entry("key_takeaways"),
            lambda v: F.when(_kind(v) == "STRING", repair_takeaways(_text(v))).otherwise(_text_list(v)),
        ).alias("key_takeaways"),
        let(
            entry("tags"),
            lambda v: F.when(_kind(v) == "STRING", repair_tags(_text(v)))
            .when(v.isNull(), empty_list())
            .otherwise(_text_list(v)),
        ).alias("tags"),
        let(entry("content_type"), lambda v: F.when(_text(v).isin(*schemas.CONTENT_TYPES), _text(v))).alias("content_type"),
        let(entry("description"), _text).alias("description"),
    )


def read_analysis(reply: Column) -> Column:
    """``struct<analysis, error>`` of a scorer's reply given as JSON text of its fields."""
    return let(F.try_parse_json(reply), lambda data: let(_read_fields(data), lambda f: _judge(data, data, f)))


def _judge(raw: Column, data: Column, fields: Column) -> Column:
    """Every field must be there; the first thing that is wrong is the error."""
    absent = F.concat_ws(", ", *(F.when(fields[n].isNull(), F.lit(n)) for n in schemas.ANALYSIS.names))
    error = (
        F.when(raw.isNull(), F.lit(f"No {TOOL_NAME} tool use in response"))
        .when(data.isNull(), F.concat(F.lit("Tool input is not valid JSON: "), F.coalesce(_text(raw), F.lit(""))))
        .when(absent != "", F.concat(F.lit("Missing or invalid fields: "), absent))
    )
    return let(
        error, lambda e: F.struct(F.when(e.isNull(), fields).alias("analysis"), e.alias("error"))
    )


def parse_reply(message: Column) -> Column:
    """``struct<analysis, error>`` of a reply: exactly one of the two is set."""
    blocks = F.try_variant_get(F.try_parse_json(message), "$.content", "array<variant>")
    chosen = F.filter(
        blocks,
        lambda b: (F.try_variant_get(b, "$.type", "string") == "tool_use")
        & (F.try_variant_get(b, "$.name", "string") == TOOL_NAME),
    )
    tool_input = F.try_variant_get(F.try_element_at(chosen, F.lit(1)), "$.input", "variant")

    def judged(raw: Column) -> Column:
        read = F.when(_kind(raw) == "STRING", strict_json(_text(raw))).otherwise(raw)
        return let(read, lambda data: let(_read_fields(data), lambda f: _judge(raw, data, f)))

    return let(tool_input, judged)
