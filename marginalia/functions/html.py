"""Readable text and metadata of crawled HTML."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, functions as F, types as T

from marginalia.functions.charrefs import unescape
from marginalia.functions.planning import let, once
from marginalia.functions.text import blank_to_null, first_truthy, strip

# Element groups that decide what is body text.
DROPPED = frozenset({"script", "style", "noscript", "template", "svg", "iframe"})
BOILERPLATE = frozenset({"nav", "footer", "header", "aside", "form"})
AD_CLASSES = frozenset({"ad", "ads", "advert", "advertisement", "comments", "comment"})
BLOCKS = frozenset(
    {"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "main", "blockquote",
     "pre", "figure", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "title", "body", "head"}
)
MAIN = frozenset({"article", "main"})
HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}
VOID = frozenset({"br", "hr", "img", "meta", "link", "input", "source", "wbr", "col", "area", "base"})


class _Reader(HTMLParser):
    """Collects text of one page; ``markup`` keeps headings, bold text and links."""

    def __init__(self, skip: frozenset[str], skip_ads: bool, markup: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.skip_ads, self.markup = skip, skip_ads, markup
        self.hidden: list[str] = []
        self.main_depth = 0
        self.whole: list[str] = []
        self.main: list[str] = []
        self.links: list[str] = []

    def _put(self, text: str) -> None:
        self.whole.append(text)
        if self.main_depth:
            self.main.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.append(tag)
            return
        classes = set((dict(attrs).get("class") or "").lower().split()) if self.skip_ads else set()
        if tag in self.skip or (classes & AD_CLASSES and tag not in VOID):
            self.hidden.append(tag)
            return
        if tag in MAIN:
            self.main_depth += 1
        if tag in BLOCKS:
            self._put("\n")
        if self.markup:
            if tag in HEADINGS:
                self._put(HEADINGS[tag])
            elif tag in ("b", "strong"):
                self._put("**")
            elif tag == "li":
                self._put("- ")
            elif tag == "a":
                self.links.append(dict(attrs).get("href") or "")
                self._put("[")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if not self.hidden and tag in BLOCKS:
            self._put("\n")

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if self.markup and tag in ("b", "strong"):
            self._put("**")
        if self.markup and tag == "a" and self.links:
            self._put(f"]({self.links.pop()})")
        if tag in BLOCKS:
            self._put("\n")
        if tag in MAIN and self.main_depth:
            self.main_depth -= 1

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self._put(data.replace("\n", " "))


def _tidy(pieces: list[str]) -> str:
    lines = (" ".join(line.split()) for line in "".join(pieces).split("\n"))
    return "\n".join(line for line in lines if line and line != "****")


def main_text(page: str, markup: bool = False) -> str | None:
    """Body text of a page without boilerplate; None when nothing is left."""
    reader = _Reader(DROPPED | BOILERPLATE | {"title"}, skip_ads=True, markup=markup)
    reader.feed(page)
    reader.close()
    return _tidy(reader.main) or _tidy(reader.whole) or None


def plain_markdown(page: str) -> str:
    """The whole page as Markdown, nothing judged to be boilerplate."""
    reader = _Reader(DROPPED | {"title"}, skip_ads=False, markup=True)
    reader.feed(page)
    reader.close()
    return _tidy(reader.whole)


def _guarded(convert, page: str | None) -> str | None:
    if not page:
        return None
    try:
        return convert(page)
    except Exception:  # a page that cannot be read counts as a page without a body
        return None


# Row by row: a worker holds the hundred pages that Spark sends at a time, not thousands in one Arrow batch.
_per_page = F.udf(returnType=T.StringType(), useArrow=False)


@once
@_per_page
def page_text(page: str | None) -> str | None:
    return _guarded(main_text, page)


@once
@_per_page
def page_markdown(page: str | None) -> str | None:
    return _guarded(lambda p: main_text(p, True), page)


@once
@_per_page
def mail_text(page: str | None) -> str | None:
    """Body text of an HTML mail; the whole mail as Markdown when no body is found."""
    return _guarded(main_text, page) or _guarded(plain_markdown, page)


# One pass over the page finds these; values are looked for in them only.
TITLE_PATTERN = "(?is)<title[^>]*>(.*?)</title>"
_TAGS = r"(?is)<(?:meta|link)\s[^>]*>"
_KEYS = r"""(?is)(?:name|property|itemprop)\s*=\s*["']([^"'>]*)["']"""
_REL = r"""(?is)rel\s*=\s*["']canonical["']"""


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in either kind of quotes; null when there is none or it is empty."""
    return first_truthy(
        F.regexp_extract(tag, rf"""(?is){name}\s*=\s*"([^">]*)\"""", 1),
        F.regexp_extract(tag, rf"""(?is){name}\s*=\s*'([^'>]*)'""", 1),
    )


def _described(tag: Column) -> Column:
    keys = F.transform(F.regexp_extract_all(tag, F.lit(_KEYS), 1), F.lower)
    href = F.when(F.rlike(tag, F.lit(_REL)), _attribute(tag, "href"))
    return F.struct(keys.alias("keys"), _attribute(tag, "content").alias("content"), href.alias("canonical"))


def _first(tags: Column, key: str) -> Column:
    """Content of the first tag of a name that has any."""
    named = F.filter(tags, lambda t: F.array_contains(t["keys"], key) & t["content"].isNotNull())
    return F.try_element_at(named, F.lit(1))["content"]


def _raw(page: Column) -> Column:
    """title, author, date and address as they stand in the page."""

    def picked(tags: Column) -> Column:
        linked = F.try_element_at(F.filter(tags, lambda t: t["canonical"].isNotNull()), F.lit(1))["canonical"]
        return F.array(
            F.regexp_extract(page, TITLE_PATTERN, 1),
            F.coalesce(_first(tags, "author"), _first(tags, "article:author")),
            F.coalesce(_first(tags, "article:published_time"), _first(tags, "datepublished"), _first(tags, "date")),
            F.coalesce(linked, _first(tags, "og:url")),
        )

    return let(F.transform(F.regexp_extract_all(page, F.lit(f"({_TAGS})"), 1), _described), picked)


def _shown(value: Column) -> Column:
    return blank_to_null(strip(unescape(value)))


def page_title(page: Column) -> Column:
    return _shown(F.regexp_extract(page, TITLE_PATTERN, 1))


def page_metadata(page: Column) -> Column:
    """``struct<title, author, date, canonical_url>``, each null where the page does not say it.

    The page is searched once for its title and once for its meta and link tags. Of several tags
    of a name the first with a value counts; a date counts when it begins with an ISO day.
    """

    def read(values: Column) -> Column:
        day = F.substring(values[2], 1, 10)
        return F.struct(
            values[0].alias("title"),
            values[1].alias("author"),
            F.when(F.rlike(day, F.lit(r"^\d{4}-\d\d-\d\d$")), day).alias("date"),
            values[3].alias("canonical_url"),
        )

    return let(F.transform(_raw(page), _shown), read)
