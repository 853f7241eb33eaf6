"""Note layouts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What precedes the summary and what closes every note.
CALLOUT = "\n\n## Summary\n\n> [!abstract] AI-Generated Summary (EN)\n> "
CLOSING = "## My Notes\n\n\n\n## Related\n\n"

# Layouts by content type; any other type uses the clipping layout.
LAYOUTS = ("newsletter", "clipping", "paper", "book")


def layout_for(content_type: Column) -> Column:
    return F.when(content_type.isin(*LAYOUTS), content_type).otherwise(F.lit("clipping"))


def bullet_lines(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda t: F.concat(F.lit("- "), t, F.lit("\n"))), "")


def pdf_section(pdf_filename: Column) -> Column:
    """Embedded-file section, '' without a file name."""
    return F.coalesce(
        F.concat(F.lit("## Embedded PDF\n\n![["), pdf_filename, F.lit("]]\n\n")), F.lit("")
    )


def render_note(
    layout: Column,
    front_matter: Column,
    summary: Column,
    key_takeaways: Column,
    content: Column,
    pdf_filename: Column | None = None,
) -> Column:
    """Text of a whole note. Paper and book layouts do not show the content."""
    head = F.concat(front_matter, F.lit(CALLOUT), summary)
    bullets = bullet_lines(key_takeaways)
    pdf = pdf_section(F.lit(None).cast("string") if pdf_filename is None else pdf_filename)
    paper = F.concat(
        head, F.lit("\n\n## Key Contributions\n\n"), bullets,
        F.lit("\n\n## Methodology\n\n\n\n## Key Findings\n\n\n\n"), pdf, F.lit(CLOSING),
    )
    book = F.concat(
        head, F.lit("\n\n## Key Ideas\n\n"), bullets,
        F.lit("\n\n## Chapter Notes\n\n\n\n## Quotes\n\n\n\n" + CLOSING),
    )
    article = F.concat(
        head, F.lit("\n\n## Key Takeaways\n\n"), bullets,
        F.lit("\n\n## Content\n\n"), content, F.lit("\n\n" + CLOSING),
    )
    return F.when(layout == "paper", paper).when(layout == "book", book).otherwise(article)
