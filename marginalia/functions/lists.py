"""List-valued metadata: normalising, merging, checking against a taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marginalia.functions.planning import let
from marginalia.functions.text import strip


def empty_list() -> Column:
    return F.array().cast("array<string>")


def clean_list(values: Column) -> Column:
    """Trimmed non-empty elements in order; null becomes an empty list."""
    trimmed = F.transform(values, strip)
    return F.coalesce(F.filter(trimmed, lambda v: v.isNotNull() & (v != "")), empty_list())


def variant_list(value: Column) -> Column:
    """A front-matter value as a list: text → one element, list → elements, else empty."""

    def read(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return (
            F.when(kind == "STRING", clean_list(F.array(F.try_variant_get(v, "$", "string"))))
            .when(F.startswith(kind, F.lit("ARRAY")), clean_list(F.try_variant_get(v, "$", "array<string>")))
            .otherwise(empty_list())
        )

    return let(value, read)


def valid_tags(suggested: Column, vocabulary: Column) -> Column:
    """Suggested tags that are in the vocabulary, once each, in suggested order."""
    return F.array_intersect(clean_list(suggested), vocabulary)


def rejected_tags(suggested: Column, vocabulary: Column) -> Column:
    return F.filter(clean_list(suggested), lambda t: ~F.array_contains(vocabulary, t))


def merge_tags(existing: Column, valid: Column) -> Column:
    """Existing tags verbatim (repeats kept), then the valid tags not among them."""
    return F.concat(existing, F.array_except(valid, existing))


def tag_status(valid: Column) -> Column:
    return F.when(F.size(valid) > 0, F.lit("classified")).otherwise(F.lit("needs-tags"))
