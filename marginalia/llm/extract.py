"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements. Paragraphs (text runs of `MIN_PARAGRAPH`
characters or more) earn points for length and commas and pass them to their ancestors, less
at each level; a container's points are discounted by its share of link text. The best
container is kept, or the article or main element around it, with siblings that score well
themselves. Inside them everything stays but elements that are not article text by kind (menus,
forms, scripts, …) or by what the words of their class, id or role say. Words are weighed: a name
made of such words alone drops its element, unless most points of the page lie in it; a name that
merely holds one drops an element only if it is mostly links, or has no text to speak of; a
heading is never dropped by its name. Tags are read as browsers read them, attribute by attribute.

Cases: null or empty html gives an empty text; so does a page without text; unclosed and
stray tags are repaired as browsers do, a tag that never ends hides the rest of the page; very
long, deeply nested and broken pages are read in one pass without recursion; repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

EXTRACTED = "page_id long, url string, text string, n_chars long"
MIN_PARAGRAPH = 25
SIBLING_SHARE = 0.2
LEVELS = 5

# Element names of HTML by their role here.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul button head title noscript iframe object canvas video audio map".split()
)
NEVER = frozenset(
    "nav footer aside form menu dialog button select option optgroup fieldset legend head title noscript iframe object "
    "canvas video audio map search dir".split()
)
NOT_TEXT_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup "
    "promo promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "toolbar widget contentinfo complementary alert alertdialog".split()
)
# Words that say nothing by themselves but complete a name of the kind above.
COMPANIONS = frozenset(
    "area bar block body bottom box buttons col column container content entry footer global header holder icon icons inner item "
    "items label left link links list main message meta module outer page panel post posts right row section site slot text title "
    "top unit user wrap wrapper".split()
)
# Names that hold one of these are what they say, whatever else they hold.
PLAIN_WORDS = frozenset("comment comments disqus navbar breadcrumb breadcrumbs advertisement gdpr".split())
# Share of the page's points with which an element stays in spite of its name, and of link text
# with which a name that only hints decides.
MOST_POINTS = 0.8
MOST_LINKS = 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p li td th dd dt pre blockquote h1 h2 h3 h4 h5 h6 figcaption caption summary".split())
# An open element of the first kind ends when one of the second begins, up to the third.
_ENDED_BY = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
    "tbody": ("thead tbody tfoot tr td th", "table"), "thead": ("thead tbody tfoot tr td th", "table"),
    "tfoot": ("thead tbody tfoot tr td th", "table"), "body": ("head title", ""),
}

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"[\s/]*+(?:>|(=?[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(\"?)|'([^']*+)('?)|([^\s>]*+)))?)")
RAW = frozenset("script style template svg math textarea xmp noembed".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of the tag whose name ends at `at`, the first of a name counts; and where the tag ends (-1: never)."""
    found: dict[str, str] = {}
    size = len(html)
    while at < size:
        if html[at] == ">":
            return found, at + 1
        part = _ATTRIBUTE.match(html, at)
        name, double, closed, single, ended, bare = part.groups()
        if name is None:
            return found, part.end()
        if (double is not None and not closed) or (single is not None and not ended):
            return found, -1
        if name:
            found.setdefault(name.lower(), double if double is not None else single if single is not None else bare or "")
        at = part.end() if part.end() > at else at + 1
    return found, -1


def _tags(html: str):
    """(where it begins, where it ends, name or None, is it an end tag, attributes) of all markup, in one pass."""
    at, size = 0, len(html)
    while (begin := html.find("<", at)) >= 0:
        head = _OPEN.match(html, begin)
        if head:
            name = head[2].lower()
            attributes, end = _attributes(html, head.end())
            if end < 0:
                yield begin, size, None, False, {}
                return
            if name in RAW and not head[1]:
                close = _RAW_END[name].search(html, end)
                end = close.start() if close else size
                yield begin, end, None, False, {}
            else:
                yield begin, end, name, bool(head[1]), attributes
        elif html.startswith("<!--", begin):
            close = html.find("-->", begin + 4)
            end = close + 3 if close >= 0 else size
            yield begin, end, None, False, {}
        elif html.startswith(("<!", "<?", "</"), begin):
            close = html.find(">", begin)
            end = close + 1 if close >= 0 else size
            yield begin, end, None, False, {}
        else:
            at = begin + 1
            continue
        at = end


class _Node:
    __slots__ = ("tag", "parent", "skip", "hint", "parts", "points", "chars", "linked", "told", "own_chars", "own_linked")

    def __init__(self, tag: str, parent: _Node | None, skip: bool, hint: int = 0) -> None:
        self.tag, self.parent, self.skip, self.hint = tag, parent, skip, hint
        self.parts: list[_Node | str] = []
        # Points passed on by paragraphs; text, link text and paragraph points inside; its own text.
        self.points = self.chars = self.linked = self.told = self.own_chars = self.own_linked = 0.0


def _named(token: str) -> int:
    """2: a name of what is no article text; 1: a name that holds such a word; 0: neither."""
    words = set(_WORD.findall(_CAMEL.sub("-", token).lower()))
    if not words & NOT_TEXT_WORDS:
        return 0
    return 2 if words & PLAIN_WORDS or words <= NOT_TEXT_WORDS | COMPANIONS else 1


def _kind(tag: str, attributes: dict[str, str], inside: set[str]) -> tuple[bool, int]:
    """Is an element no article text by its kind, and what does its name say?"""
    if tag in NEVER or (tag == "header" and not inside & {"article", "main"}):
        return True, 0
    if not attributes or tag in ("html", "body", "main", "article"):
        return False, 0
    style = "".join(attributes.get("style", "").lower().split())
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return True, 0
    tokens = [t for key in ("class", "role") for t in attributes.get(key, "").split()]
    hint = max(map(_named, tokens), default=0)
    own = _named(attributes.get("id", ""))
    return False, 0 if tag in HEADINGS else max(hint, own)


def _tree(html: str) -> list[_Node]:
    """All nodes in page order; the first is the root."""
    root = _Node("#root", None, False)
    nodes, stack, run, link = [root], [root], [], [False, 0]

    def flush() -> None:
        top = stack[-1]
        if run and not top.skip:
            text = " ".join(unescape("".join(run)).split())
            if text:
                top.parts.append(text)
                top.own_chars += len(text)
                top.own_linked += min(link[1], len(text))
        run.clear()
        link[1] = 0

    def close(depth: int) -> None:
        flush()
        link[0] = False
        del stack[depth:]

    at = 0
    for begin, end, name, ends, attributes in _tags(html):
        if begin > at:
            piece = html[at:begin]
            run.append(piece)
            if link[0]:
                link[1] += len(piece)
        at = end
        if name is None:
            continue
        if name in BLOCKS:
            if ends:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == name:
                        close(depth)
                        break
                else:
                    flush()
                continue
            flush()
            if stack[-1].tag == "p":
                close(len(stack) - 1)
            if name in _ENDED_BY:
                ended, limit = (x.split() for x in _ENDED_BY[name])
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in limit:
                        break
                    if stack[depth].tag in ended:
                        close(depth)
                        break
            top = stack[-1]
            never, hint = _kind(name, attributes, {n.tag for n in stack} if name == "header" else set())
            node = _Node(name, top, top.skip or never, hint)
            top.parts.append(node)
            nodes.append(node)
            stack.append(node)
        elif name in ("br", "hr", "wbr", "img", "input"):
            if name == "hr":
                flush()
            elif name == "br":
                run.append(" ")
        elif name == "a":
            link[0] = not ends
    if at < len(html):
        run.append(html[at:])
    flush()
    return nodes


def _points(text: str) -> float:
    """What a run of text counts: nothing if it is short, more for length and commas."""
    return 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3) if len(text) >= MIN_PARAGRAPH else 0.0


def _gather(nodes: list[_Node]) -> None:
    """Text, link text and points inside each element, without what is skipped."""
    for node in nodes:
        node.chars, node.linked = node.own_chars, node.own_linked
        node.told = sum(_points(text) for text in node.parts if isinstance(text, str))
    for node in reversed(nodes):
        up = node.parent
        if up and not node.skip:
            up.chars += node.chars
            up.linked += node.linked
            up.told += node.told


def _drop_named(nodes: list[_Node]) -> None:
    """Skips elements that their names, weighed against what they hold, say are no article text."""
    for node in nodes:
        if node.parent and node.parent.skip:
            node.skip = True
        elif node.hint and not node.skip:
            links = node.linked / node.chars if node.chars else 0.0
            if node.hint == 2:
                node.skip = not (node.told > MOST_POINTS * nodes[0].told and links < MOST_LINKS)
            else:
                node.skip = links >= MOST_LINKS or (not node.told and node.tag not in PARAGRAPHS)


def _blocks(node: _Node) -> list[str]:
    found, todo = [], [node]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            found.append(part)
        elif not part.skip:
            todo.extend(reversed(part.parts))
    return found


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by one newline."""
    if not html:
        return ""
    nodes = _tree(html)
    _gather(nodes)
    if any(node.hint for node in nodes):
        _drop_named(nodes)
        _gather(nodes)
    for node in nodes:
        if node.skip:
            continue
        for text in node.parts:
            if isinstance(text, str) and (points := _points(text)):
                holder = node.parent if node.tag in PARAGRAPHS and node.parent else node
                for level in range(LEVELS):
                    if holder is None:
                        break
                    holder.points += points / (1, 2, 6, 9, 12)[level]
                    holder = holder.parent
    worth = {id(n): n.points * (1 - n.linked / n.chars) if n.chars else 0.0 for n in nodes if not n.skip}
    best = max((n for n in nodes if not n.skip), key=lambda n: worth[id(n)])
    if not worth[id(best)]:
        # No paragraph is long enough: the article, the main element or else the page.
        named = [n for kind in ("article", "main", "body") for n in nodes if n.tag == kind and not n.skip and n.chars]
        return "\n".join(_blocks(named[0] if named else nodes[0]))
    above = best
    while above:
        if above.tag in ("article", "main"):
            best = above
        above = above.parent
    kept = [best]
    if best.parent and best.tag not in ("article", "main", "body", "html"):
        need = max(10, SIBLING_SHARE * worth[id(best)])
        kept = []
        for part in best.parent.parts:
            if part is best:
                kept.append(part)
            elif isinstance(part, _Node) and not part.skip and part.chars:
                density = part.linked / part.chars
                told = part.tag in PARAGRAPHS and (density < 0.25 and part.chars > 80 or density == 0 and part.tag[0] in "hp")
                if worth[id(part)] >= need or told:
                    kept.append(part)
    return "\n".join(block for node in kept for block in _blocks(node))


def _extract(batches):
    for batch in batches:
        texts = [main_text(html) for html in batch.column("html").to_pylist()]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html)."""
    kinds = {"page_id": "long", "url": "string", "html": "string"}
    return pages.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items())).mapInArrow(_extract, EXTRACTED)
