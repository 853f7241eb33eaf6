"""Mail message parts: walking the MIME tree, choosing and decoding bodies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marginalia.functions.planning import let
from marginalia.functions.text import blank_to_null, strip

NODE = "struct<path:array<int>,node:variant>"
DATA = "struct<path:array<int>,data:string>"


def _children(level: Column) -> Column:
    """The parts of all nodes of a level, each with its place in the tree."""

    def of(parent: Column) -> Column:
        parts = F.try_variant_get(parent["node"], "$.parts", "array<variant>")
        return F.transform(parts, lambda node, at: F.struct(F.concat(parent["path"], F.array(at)).alias("path"), node.alias("node")))

    return F.flatten(F.filter(F.transform(level, of), lambda parts: parts.isNotNull()))


def _earliest(before: Column, level: Column, mime_type: str) -> Column:
    """The first part of a type with data, depth first: of those known and those of a level."""

    def data(n: Column) -> Column:
        fits = F.try_variant_get(n["node"], "$.mimeType", "string") == mime_type
        return F.when(fits, blank_to_null(F.try_variant_get(n["node"], "$.body.data", "string")))

    found = F.transform(level, lambda n: F.struct(n["path"].alias("path"), data(n).alias("data")))
    return F.least(before, F.array_min(F.filter(found, lambda f: f["data"].isNotNull())))


def walk(payload: Column) -> Column:
    """``struct<html, plain>``: the data of the first part of each type; null if the payload is no object.

    The tree (JSON text of any depth) is walked level by level; a level is deeper by at least one
    bracket, so there are no more levels than brackets. Only the nodes of one level and the two
    chosen parts are held.
    """
    nothing = F.lit(None).cast(DATA)

    def walked(root: Column) -> Column:
        level = F.array(F.struct(F.array().cast("array<int>").alias("path"), root.alias("node"))).cast(f"array<{NODE}>")
        begin = F.struct(level.alias("level"), nothing.alias("html"), nothing.alias("plain"))

        def deeper(known: Column, _: Column) -> Column:
            return F.struct(
                _children(known["level"]).alias("level"),
                _earliest(known["html"], known["level"], "text/html").alias("html"),
                _earliest(known["plain"], known["level"], "text/plain").alias("plain"),
            )

        def chosen(known: Column) -> Column:
            return F.struct(known["html"]["data"].alias("html"), known["plain"]["data"].alias("plain"))

        brackets = F.octet_length(payload) - F.octet_length(F.replace(payload, F.lit("["), F.lit("")))
        return F.aggregate(F.sequence(F.lit(0), brackets), begin, deeper, chosen)

    is_object = F.startswith(F.ltrim(payload, F.lit(" \t\r\n")), F.lit("{"))
    return let(F.when(is_object, F.try_parse_json(payload)), lambda root: F.when(root.isNotNull(), walked(root)))


def decode_part(data: Column) -> Column:
    """base64url → text; null for data that cannot be decoded.

    Characters outside the alphabet are ignored, padding may lack, and bytes that are no
    UTF-8 become U+FFFD. Well-formed data, in lines or not, is decoded as it is; only other
    data is searched for such characters.
    """
    kind = F.lit("base64")
    usual = F.replace(F.replace(data, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    cleaned = F.regexp_replace(usual, "[^A-Za-z0-9+/]", "")
    return F.make_valid_utf8(F.coalesce(F.try_to_binary(usual, kind), F.try_to_binary(cleaned, kind)).cast("string"))


def header(headers: Column, name: str) -> Column:
    """Value of a header, any letter case; the last one wins when it is repeated."""
    same = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.try_element_at(same, F.lit(-1))["value"]


def choose_body(html_text: Column, html_present: Column, plain: Column) -> Column:
    """Text of the HTML body if the mail has one, else the plain body, else ''; trimmed."""
    chosen = F.when(html_present, html_text).otherwise(blank_to_null(plain))
    return strip(F.coalesce(chosen, F.lit("")))
