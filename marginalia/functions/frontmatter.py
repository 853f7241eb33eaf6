"""Front matter of Markdown notes: reading it and writing it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date

import pandas as pd
import yaml
from pyspark.sql import Column, functions as F

from marginalia import schemas
from marginalia.functions.planning import let, once
from marginalia.functions.text import first_truthy, strip
from marginalia.functions.yamltext import entries

FENCE = r"(?m)^-{3,}\s*$"
# Keys that may hold the original address, in order of preference.
URL_KEYS = ("source", "url", "link", "clipped_url", "permalink")


def split_note(text: Column) -> Column:
    """``struct<header, body>``; header is null when the note has none.

    A note that does not begin with a fence is not searched for one.
    """
    whole = strip(text)
    pieces = F.when(F.startswith(whole, F.lit("---")), F.split(whole, FENCE, 3)).otherwise(F.array(whole))

    def read(p: Column) -> Column:
        fenced = (F.size(p) == 3) & (p[0] == "")
        return F.struct(
            F.when(fenced, p[1]).alias("header"), F.when(fenced, strip(p[2])).otherwise(whole).alias("body")
        )

    return let(pieces, read)


def _plain(value: object) -> object:
    if isinstance(value, (list, tuple)):
        return [None if v is None else v if isinstance(v, str) else str(v) for v in value]
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    return value.isoformat() if isinstance(value, date) else str(value)


def _header_json(header: str) -> tuple[str | None, str | None]:
    try:
        loaded = yaml.load(header, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        return json.dumps(_plain(loaded) if isinstance(loaded, dict) else {}), None
    except Exception as problem:  # the note is set aside, the scan goes on
        return None, f"front matter: {type(problem).__name__}"


@once
@F.pandas_udf(schemas.YAML_RESULT)
def yaml_to_json(headers: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """YAML header → JSON text. Only the header crosses into Python, not the body."""
    for batch in headers:
        rows = [("{}", None) if h is None else _header_json(h) for h in batch]
        yield pd.DataFrame(rows, columns=["json", "error"])


def text_value(meta: Column, key: str) -> Column:
    """A scalar entry as text; null when absent or null."""
    return F.try_variant_get(meta, f"$.{key}", "string")


def string_only(meta: Column, key: str) -> Column:
    """The entry if it is a string, else null."""
    entry = F.try_variant_get(meta, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(entry) == "STRING", F.try_variant_get(entry, "$", "string"))


def source_url(*candidates: Column) -> Column:
    """First candidate that is not blank, trimmed; '' when there is none."""
    return F.coalesce(first_truthy(*(strip(c) for c in candidates)), F.lit(""))


def source_url_of(meta: Column) -> Column:
    return source_url(*(string_only(meta, key) for key in URL_KEYS))


def _present(value: Column, line: Column) -> Column:
    return F.when(value.isNotNull(), line)


def front_matter_yaml(front: Column) -> Column:
    """Front matter struct (``schemas.FRONT_MATTER``) → YAML block, fences included.

    Keys come in their fixed order; days are written as text; what a note lacks is left out, but
    for the fields that its type has always.
    """

    def day(name: str) -> Column:
        return F.coalesce(F.concat(F.lit("'"), front[name].cast("string"), F.lit("'")), F.lit("null"))

    kind, blank = front["type"], F.lit("")
    year = F.concat(F.lit("year: "), F.coalesce(front["year"].cast("int").cast("string"), F.lit("null")))
    texts = {name: front[name] for name in ("title", "source", "newsletter", "gmail_url", "description", "type", "status")}
    texts |= {name: F.coalesce(front[name], blank) for name in ("journal", "doi", "isbn")}

    def block(line: dict[str, Column]) -> Column:
        return F.concat_ws(
            "\n",
            F.lit("---"),
            line["title"],
            line["source"],
            line["author"],
            _present(front["newsletter"], line["newsletter"]),
            _present(front["published"], F.concat(F.lit("published: "), day("published"))),
            _present(front["gmail_url"], line["gmail_url"]),
            F.concat(F.lit("created: "), day("created")),
            line["description"],
            line["type"],
            line["status"],
            _present(front["rating"], F.concat(F.lit("rating: "), front["rating"].cast("int").cast("string"))),
            F.when(kind == "paper", F.concat_ws("\n", line["journal"], line["doi"], year)).when(
                kind == "book", F.concat_ws("\n", year, line["isbn"])
            ),
            line["tags"],
            F.lit("---"),
        )

    return entries(texts, {"author": front["author"], "tags": front["tags"]}, block)
