"""Text expressions: trimming, names, file names, prompts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marginalia.settings import FILENAME_MAX_CHARS, PROMPT_MAX_CHARS

# The characters Unicode-aware trimming removes, and the same set as a class.
SPACE_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
         *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
SPACE_CLASS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Characters that may not appear in a file name.
FORBIDDEN_IN_FILENAME = r'[<>:"/\\|?*]'

# Wording of the scoring request.
HINT_PREFIX = "Content source hint: "
PROMPT_LEAD = "Analyze the following content:\n"


def strip(text: Column) -> Column:
    """Trim all Unicode white space on both sides."""
    return F.trim(text, F.lit(SPACE_CHARS))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def first_truthy(*candidates: Column) -> Column:
    """First value that is neither null nor empty; null if there is none."""
    return F.coalesce(*(blank_to_null(c) for c in candidates))


def display_name(from_header: Column) -> Column:
    """Human-readable part of a From header; the whole header when it has no ``<``."""
    header = F.coalesce(from_header, F.lit(""))
    before = F.trim(strip(F.substring_index(header, "<", 1)), F.lit('"'))
    return F.when(F.contains(header, F.lit("<")), before).otherwise(header)


def wikilink(name: Column) -> Column:
    return F.concat(F.lit("[["), name, F.lit("]]"))


def message_link(message_id: Column) -> Column:
    """Web link of a message; null when there is no id."""
    return F.concat(F.lit("https://mail.google.com/mail/u/0/#all/"), blank_to_null(message_id))


def safe_filename(title: Column, limit: int = FILENAME_MAX_CHARS) -> Column:
    """File name for a title: forbidden characters dropped, cut at a word boundary."""
    kept = F.regexp_replace(title, FORBIDDEN_IN_FILENAME, "")
    name = strip(F.regexp_replace(kept, SPACE_CLASS + "+", " "))
    head = F.substring(name, 1, limit)
    tail = F.locate(" ", F.reverse(head))
    cut = F.when(tail > 0, F.left(head, F.lit(limit) - tail)).otherwise(head)
    return F.concat(F.when(F.length(name) > limit, cut).otherwise(name), F.lit(".md"))


def content_hint(title: Column, domain: Column) -> Column:
    """``title (domain)``, either part optional; null when both are missing."""
    shown = F.when(F.coalesce(domain, F.lit("")) != "", F.concat(F.lit("("), domain, F.lit(")")))
    return blank_to_null(F.concat_ws(" ", blank_to_null(title), shown))


def analysis_prompt(content: Column, hint: Column, limit: int | None = PROMPT_MAX_CHARS) -> Column:
    """User message of a scoring request; content over the limit is cut and the cut is stated."""
    if limit is None:
        return F.concat_ws("\n", F.concat(F.lit(HINT_PREFIX), blank_to_null(hint)), F.lit(PROMPT_LEAD), content)
    size = F.length(content)
    omitted = F.concat(
        F.lit("\n[... truncated, "), (size - limit).cast("string"), F.lit(" chars omitted]")
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit(HINT_PREFIX), blank_to_null(hint)),
        F.lit(PROMPT_LEAD),
        F.when(size > limit, F.substring(content, 1, limit)).otherwise(content),
        F.when(size > limit, omitted),
    )


def first_line(text: Column) -> Column:
    return strip(F.substring_index(text, "\n", 1))


def padded_id(prefix: str, ordinal: Column) -> Column:
    """``prefix`` and at least four digits; wider numbers are not cut."""
    digits = ordinal.cast("string")
    return F.concat(
        F.lit(prefix), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    )


def hashed_id(item_id: Column) -> Column:
    """Order-free request id: 64 hex characters, so no global sort is needed."""
    return F.sha2(item_id.cast("string"), 256)
