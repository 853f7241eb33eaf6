"""Character references of HTML (``&amp;``, ``&#8217;``, ``&eacute``) resolved by expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from marginalia.functions.planning import let

REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
REPLACEMENT = "\ufffd"
# Numbers that stand for another character, as the HTML standard reads them: those of the
# Windows code page, null and carriage return.
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
_OTHERS = {0: REPLACEMENT, 13: "\r"} | _WINDOWS
# Names that count without a semicolon, also as the beginning of a longer word.
_SHORT = {name: value for name, value in html5.items() if not name.endswith(";")}


def _table(entries: dict) -> Column:
    """A constant map; it is parsed once, while the query is planned."""
    return F.from_json(F.lit(json.dumps({str(k): v for k, v in entries.items()})), "map<string,string>")


def _void(code: Column) -> Column:
    """Is the number no character at all?"""
    controls = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
    return controls | code.between(0xFDD0, 0xFDEF) | (code % 0x10000 >= 0xFFFE)


def _numbered(code: Column, tables: Column) -> Column:
    text = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.coalesce(
        tables["numbers"][code.cast("string")],
        F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit(REPLACEMENT)).when(_void(code), F.lit("")).otherwise(text),
    )


def _named(name: Column, whole: Column, tables: Column) -> Column:
    short, full = tables["short"], tables["names"]
    lengths = F.sequence(F.length(name) - 1, F.lit(2), F.lit(-1))
    heads = F.filter(F.transform(F.when(F.length(name) > 2, lengths), lambda n: F.left(name, n)), lambda h: short[h].isNotNull())
    head = F.try_element_at(heads, F.lit(1))
    return F.coalesce(full[name], F.concat(short[head], F.substr(name, F.length(head) + 1)), whole)


def _resolved(reference: Column, tables: Column) -> Column:
    digits = F.regexp_extract(reference, "^&#([0-9]+)", 1)
    hexadecimal = F.regexp_extract(reference, "^&#[xX]([0-9a-fA-F]+)", 1)
    # A number of more digits than these is beyond all characters.
    decimal_code = F.when(F.length(F.ltrim(digits, F.lit("0"))) > 9, F.lit(1 << 30)).otherwise(digits.try_cast("long"))
    significant = F.ltrim(hexadecimal, F.lit("0"))
    hex_code = F.when(F.length(significant) > 7, F.lit(1 << 30)).otherwise(F.conv(hexadecimal, 16, 10).try_cast("long"))
    code = F.when(digits != "", decimal_code).when(hexadecimal != "", hex_code)
    return let(
        code,
        lambda c: F.when(c.isNotNull(), _numbered(c, tables)).otherwise(_named(F.substr(reference, F.lit(2)), reference, tables)),
    )


def unescape(text: Column) -> Column:
    """Every reference once, also those without a semicolon; what is none stays as it is."""
    tables = F.struct(_table(html5).alias("names"), _table(_SHORT).alias("short"), _table(_OTHERS).alias("numbers"))

    def joined(known: Column) -> Column:
        pieces, found = F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), 1)
        values = F.concat(F.transform(found, lambda reference: _resolved(reference, known)), F.array(F.lit("")))
        pairs = F.transform(F.arrays_zip(pieces.alias("p"), values.alias("v")), lambda z: F.array(z["p"], z["v"]))
        return F.array_join(F.flatten(pairs), "")

    # The tables stand once in the plan, and only a text with a reference is taken apart.
    return F.when(F.contains(text, F.lit("&")), let(tables, joined)).otherwise(text)
