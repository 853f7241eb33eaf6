"""Merging scorer output with what a note already states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions import dates, lists, text


def resolve_tags(items: DataFrame, vocabulary: Column, existing: str = "existing_tags", suggested: str = "tags") -> DataFrame:
    """Adds ``merged_tags`` and ``status``; only tags of the vocabulary are taken over."""
    valid = lists.valid_tags(F.col(suggested), vocabulary)
    return (
        items.withColumn("_valid", valid)
        .withColumns(
            {
                "merged_tags": lists.merge_tags(lists.clean_list(F.col(existing)), F.col("_valid")),
                "status": lists.tag_status(F.col("_valid")),
            }
        )
        .drop("_valid")
    )


def tag_rejects(items: DataFrame, taxonomy: DataFrame, key: str, suggested: str = "tags") -> DataFrame:
    """One row per suggested tag that the taxonomy does not know."""
    exploded = items.select(key, F.explode(lists.clean_list(F.col(suggested))).alias("tag"))
    return exploded.join(taxonomy.select("tag"), "tag", "left_anti")


def merged_front_matter(item: dict[str, Column], existing: dict[str, Column], analysis: Column, as_of: Column) -> dict[str, Column]:
    """Columns of the merged front matter; empty text counts as missing where stated.

    ``existing['author']`` is a list, the other existing entries are text or numbers.
    """
    today = F.to_date(as_of)
    given_author = lists.clean_list(existing["author"])
    web_author = text.blank_to_null(item["web_author"])
    return {
        "title": text.first_truthy(existing["title"], item["title"]),
        "source": F.coalesce(text.first_truthy(item["source_url"], existing["source"]), F.lit("")),
        "author": F.when(F.size(given_author) > 0, given_author)
        .when(web_author.isNotNull(), F.array(text.wikilink(web_author)))
        .otherwise(lists.empty_list()),
        "created": F.coalesce(dates.sane_date(existing["created"], as_of), today),
        "type": text.first_truthy(existing["type"], analysis["content_type"]),
        "description": F.coalesce(text.first_truthy(analysis["description"], existing["description"]), F.lit("")),
        "newsletter": existing["newsletter"],
        "published": F.coalesce(
            dates.sane_date(existing["published"], as_of),
            dates.sane_date(item["web_date"], as_of),
            dates.sane_date(item["published"], as_of),
        ),
        "rating": existing["rating"],
        "journal": existing["journal"],
        "doi": existing["doi"],
        "year": existing["year"],
        "isbn": existing["isbn"],
    }
