"""Recovering full article text from crawled pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from marginalia.functions import html, text, urls
from marginalia.session import use_checkpoint_dir


def articles(pages: DataFrame) -> DataFrame:
    """page_id, url, html → what an article read yields; rows without HTML are dropped."""
    page = F.col("html")
    read = pages.filter(page != "").select("page_id", "url", html.page_markdown(page).alias("text"), html.page_metadata(page).alias("_meta"))
    return read.select("page_id", "url", "text", "_meta.*")


def wanted_pages(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Pages whose cleaned URL an item has; only these are worth reading."""
    links = items.filter(F.coalesce("source_url", F.lit("")) != "")
    keys = links.select(urls.clean_url(F.col("source_url")).alias("_key")).distinct()
    keyed = pages.withColumn("_key", urls.clean_url(F.col("url")))
    return keyed.join(keys, "_key", "left_semi").drop("_key")


@dataclass(frozen=True)
class Articles:
    """The article of every cleaned URL as a narrow row, and the texts, fetched by ``article``."""

    winners: DataFrame  # clean_url, article, chars, author, date
    texts: DataFrame  # article, text


def one_per_url(found: DataFrame) -> Articles:
    """One article per cleaned URL: the longest text, then the lowest page id.

    Texts are read once and written; only their lengths are ranked, one candidate per URL in
    every task before anything is shuffled.
    """
    use_checkpoint_dir(found.sparkSession)
    numbered = found.withColumn("article", F.monotonically_increasing_id())
    fixed = numbered.withColumn("clean_url", urls.clean_url(F.col("url"))).checkpoint()
    chars = F.length("text")
    best = F.struct(F.coalesce(chars, F.lit(-1)), -F.col("page_id"), -F.col("article"))
    row = F.struct("article", chars.alias("chars"), "author", "date")
    winners = fixed.groupBy("clean_url").agg(F.max_by(row, best).alias("_w")).select("clean_url", "_w.*")
    return Articles(winners, fixed.select("article", "text"))


def keep_longest(items: DataFrame, by_url: Articles, enabled: bool = True) -> DataFrame:
    """Items with cleaned URL, the longer of captured and crawled text, web author and date.

    Author and date are adopted even when the text is not; the canonical URL never is. What is
    adopted is decided on lengths; contents meet texts in the last join only, those that are longer.
    ``item_id`` identifies an item.
    """
    nothing = F.lit(None).cast("string")
    if not enabled:
        return items.withColumns({"web_author": nothing, "web_date": nothing})
    eligible = ~F.coalesce("is_pdf", F.lit(False)) & (F.coalesce("source_url", F.lit("")) != "")
    wanted = items.filter(eligible).select(
        F.col("item_id").alias("_item"), urls.clean_url(F.col("source_url")).alias("clean_url"),
        F.length(F.coalesce("content", F.lit(""))).alias("_own"),
    )
    decided = wanted.join(by_url.winners, "clean_url", "left")
    longer = decided.filter(F.col("chars") > F.col("_own")).select("_item", "article")
    fetched = longer.join(by_url.texts, "article").select(F.col("_item").alias("_for"), F.col("text").alias("_text"))
    facts = decided.select(
        "_item", F.col("clean_url").alias("_cleaned"), text.blank_to_null(F.col("author")).alias("web_author"),
        text.blank_to_null(F.col("date")).alias("web_date"),
    )
    joined = items.join(facts, F.col("item_id") == F.col("_item"), "left").join(fetched, F.col("item_id") == F.col("_for"), "left")
    return joined.withColumns(
        {"source_url": F.coalesce("_cleaned", "source_url"), "content": F.coalesce("_text", "content")}
    ).drop("_item", "_cleaned", "_for", "_text")
