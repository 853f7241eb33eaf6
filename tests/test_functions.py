from __future__ import annotations

import base64
import datetime as dt
import json
import random
from html import entities, unescape
from urllib.parse import parse_qsl, urlencode, urlsplit

import pytest
import yaml
from pyspark.sql import functions as F

from marginalia.functions import charrefs, dates, frontmatter, html, lists, mime, render, replies, text, urls, yamltext


def test_display_name(each):
    headers = ["Harbour Notes <tide@quay.example>", '"Harbour Notes" <tide@quay.example>', "tide@quay.example", None, "<a@b>", ' "" <a@b>']
    assert each(text.display_name, headers) == ["Harbour Notes", "Harbour Notes", "tide@quay.example", "", "", ""]


def test_safe_filename(each):
    words = "ab " * 100
    titles = ["w" * 300, "a   b\t\nc", '<>:"/\\|?*', words, " x/y "]
    cut = words.strip()[:200].rsplit(" ", 1)[0]
    assert each(text.safe_filename, titles) == ["w" * 200 + ".md", "a b c.md", ".md", cut + ".md", "xy.md"]


def test_prompt_states_what_was_cut(each):
    short, long = each(lambda c: text.analysis_prompt(c, F.lit("Hint")), ["body", "x" * 6005])
    assert short == "Content source hint: Hint\nAnalyze the following content:\n\nbody"
    assert long.endswith("x\n\n[... truncated, 5 chars omitted]") and long.count("x") == 6000
    assert each(lambda c: text.analysis_prompt(c, F.lit(None).cast("string")), ["b"]) == [
        "Analyze the following content:\n\nb"
    ]


def test_hint(one):
    assert one(text.content_hint(F.lit("T"), F.lit("e.com"))) == "T (e.com)"
    assert one(text.content_hint(F.lit(""), F.lit("e.com"))) == "(e.com)"
    assert one(text.content_hint(F.lit(""), F.lit(""))) is None


def test_padded_id(one):
    assert one(text.padded_id("item", F.lit(7))) == "item0007"
    assert one(text.padded_id("ib", F.lit(12345))) == "ib12345"


URLS = {
    "https://e.com/?a": "https://e.com/?a=",
    "https://e.com/?a=b=c": "https://e.com/?a=b%3Dc",
    "https://e.com/?q=a%20b+c": "https://e.com/?q=a+b+c",
    "https://e.com/?x=~*/:": "https://e.com/?x=~%2A%2F%3A",
    "https://e.com/?q=%zz": "https://e.com/?q=%25zz",
    "https://e.com/?UTM_x=1&Ref=2": "https://e.com/",
    "https://e.com/a?": "https://e.com/a?",
    "https://e.com/a?x=1#": "https://e.com/a?x=1",
    "HTTPS://E.com/p?a=1": "https://E.com/p?a=1",
    "https://e.com/a#b?utm_x=1": "https://e.com/a#b?utm_x=1",
    "https://[bad/a?utm_x=1": "https://[bad/a?utm_x=1",
    "https://[::1]:80/a?utm_x=1&&é=ü": "https://[::1]:80/a?%C3%A9=%C3%BC",
}


def test_clean_url(each):
    assert dict(zip(URLS, each(urls.clean_url, list(URLS)))) == URLS


def _without_tracking(url: str) -> str:
    """The rule, one pair after the other: a tracking key in any letter case goes, the rest stays in order."""
    parts = urlsplit(url)
    pairs = parse_qsl(parts.query, keep_blank_values=True)
    kept = [(k, v) for k, v in pairs if not k.lower().startswith(urls.TRACKING_PREFIX) and k.lower() not in urls.TRACKING_KEYS]
    return parts._replace(query=urlencode(kept)).geturl()


def test_clean_url_drops_tracking_keys_only(each):
    draw = random.Random(11)
    tracking = [*urls.TRACKING_KEYS, urls.TRACKING_PREFIX, urls.TRACKING_PREFIX + "z9"]
    alone = [f"http://h.test/{n}?{cased}=v" for n, key in enumerate(tracking) for cased in (key, key.upper(), key.title())]
    # Keys that only look like one stay.
    near = [f"http://h.test/n?{k}=1" for key in tracking[:-1] for k in ("x" + key, key.rstrip("_") + "-")]
    mixed = []
    for _ in range(120):
        keys = [draw.choice([*tracking, "a", "b", "Z", "utmost", "referrer"]) for _ in range(draw.randrange(1, 7))]
        query = "&".join(f"{k}={draw.choice(['', '1', 'two', '3', 'x.y-z'])}" for k in keys)
        mixed.append("http://h.test/" + draw.choice(["", "p", "p/q.html"]) + "?" + query + draw.choice(["", "#part", "#a?ref=1"]))
    for cases in (alone, near, mixed):
        assert each(urls.clean_url, cases) == [_without_tracking(url) for url in cases]


def test_clean_url_keeps_what_the_standard_library_reads(each):
    queries = ["a=1&b=%F0%9F%98%80&c", "x=%2B%2b+&y=%", "k%3D=v%26&z==", "a;b=1&&&q=%E4"]
    got = each(urls.clean_url, [f"http://h/p?{q}" for q in queries])
    assert [urlsplit(u).query for u in got] == [urlencode(parse_qsl(q, keep_blank_values=True)) for q in queries]


def test_network_location(each):
    addresses = ["https://u:p@Ex.com:8080/a", "no scheme", "//h/x", None, "https://[bad/x", "mailto:a@b"]
    assert each(urls.network_location, addresses) == ["u:p@Ex.com:8080", "", "h", "", "", ""]


DATES = {
    "2000-06-11": None,
    "2026-02-30": None,
    "2026-03-07T12:00:00Z": dt.date(2026, 3, 7),
    "20260307": dt.date(2026, 3, 7),
    "20260307T12": None,
    "2026-W10-6": dt.date(2026, 3, 7),
    "2026-W10": dt.date(2026, 3, 2),
    "2026W106": dt.date(2026, 3, 7),
    "2025-W53-1": None,
    "2020-W53-5": dt.date(2021, 1, 1),
    "2028-01-01": None,
    "2027-12-31": dt.date(2027, 12, 31),
    "last week": None,
    "": None,
}


def test_sane_date(each):
    as_of = F.lit("2026-05-01").cast("date")
    assert dict(zip(DATES, each(lambda c: dates.sane_date(c, as_of), list(DATES)))) == DATES


def test_merge_tags(one):
    known = F.array(F.lit("a"), F.lit("b"))

    def merged(existing, suggested):
        lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        valid = lists.valid_tags(lit(suggested), known)
        return one(F.struct(lists.merge_tags(lists.clean_list(lit(existing)), valid), lists.tag_status(valid)))

    assert tuple(merged(["x", "x"], ["a", "a", "no"])) == (["x", "x", "a"], "classified")
    assert tuple(merged(["a"], ["a"])) == (["a"], "classified")
    assert tuple(merged([], [])) == ([], "needs-tags")
    assert tuple(merged(["x"], ["no", " b "])) == (["x", "b"], "classified")


def test_variant_list(each):
    values = ["null", '"  a "', '" "', '[" a ", null, "", 5]', "7", '{"a": 1}']
    assert each(lambda c: lists.variant_list(F.parse_json(c)), values) == [[], ["a"], [], ["a", "5"], [], []]


def test_repair_takeaways(each):
    cases = {
        '["a"': ['["a"'],
        '["a"] x': ['["a"] x'],
        '["a"]] [': ['["a"]] ['],
        "[1]": None,
        '["a", null]': None,
        ' ["a", "b"] ': ["a", "b"],
        "[]": [],
        "- a\n- \n-\n\nb": ["a", "b"],
        "--\n\t- a": ["", "- a"],
        "": ["Unable to extract takeaways"],
    }
    assert dict(zip(cases, each(replies.repair_takeaways, list(cases)))) == cases


def test_repair_tags(each):
    cases = {"a, b,,c": ["a", "b", "c"], '["a"': [], '["a"]': ["a"], "[1]": None, "": []}
    assert dict(zip(cases, each(replies.repair_tags, list(cases)))) == cases


def _reply(data, name="classify_content"):
    return json.dumps({"content": [{"type": "text", "text": "x"}, {"type": "tool_use", "name": name, "input": data}]})


GOOD = {"summary": "s", "key_takeaways": ["k"], "tags": ["t"], "content_type": "note", "description": "d"}


def test_parse_reply(each):
    no_tags = {k: v for k, v in GOOD.items() if k != "tags"}
    inputs = [
        _reply(GOOD), _reply(json.dumps(GOOD)), _reply(no_tags), _reply(GOOD | {"tags": "a, b"}),
        _reply(GOOD | {"key_takeaways": "- one\n- two"}), _reply(GOOD, "other"), _reply("{cut"),
        _reply(GOOD | {"summary": 5, "tags": None}), "not json", None,
    ]
    rows = each(replies.parse_reply, inputs)
    assert rows[0]["analysis"].asDict() == GOOD and rows[0]["error"] is None
    assert rows[1]["analysis"].asDict() == GOOD
    assert rows[2]["analysis"]["tags"] == []
    assert rows[3]["analysis"]["tags"] == ["a", "b"]
    assert rows[4]["analysis"]["key_takeaways"] == ["one", "two"]
    assert [r["analysis"] for r in rows[5:]] == [None] * 5
    assert [r["error"] for r in rows[5:]] == [
        "No classify_content tool use in response",
        "Tool input is not valid JSON: {cut",
        "Missing or invalid fields: summary, tags",
        "No classify_content tool use in response",
        "No classify_content tool use in response",
    ]


def _data(body: bytes) -> str:
    return base64.urlsafe_b64encode(body).decode()


def test_mime_bodies(each):
    html_part = {"mimeType": "text/html", "body": {"data": _data("<p>é</p>".encode())}}
    plain = {"mimeType": "text/plain", "body": {"data": _data(b"plain").rstrip("=")}}
    later = {"mimeType": "text/plain", "body": {"data": _data(b"later")}}
    bad = {"mimeType": "text/plain", "body": {"data": _data(b"a\xffb")}}
    empty = {"mimeType": "text/plain", "body": {"data": ""}}
    deep = plain
    for _ in range(30):
        deep = {"mimeType": "multipart/mixed", "parts": [{"mimeType": "image/png", "body": {"data": "eA=="}}, deep]}
    messages = [
        plain, html_part,
        {"mimeType": "multipart/alternative", "parts": [plain, html_part, later]},
        # Depth first: what lies in an earlier branch comes before what lies higher.
        {"mimeType": "multipart/mixed", "parts": [{"mimeType": "m", "parts": [empty, {"mimeType": "m", "parts": [bad]}]}, plain]},
        {"mimeType": "multipart/mixed"}, deep, {"mimeType": "m", "parts": [None, 3, {"body": None}, html_part]},
    ]
    payloads = [*map(json.dumps, messages), "{broken", "[1]", "7", None]
    rows = each(mime.walk, payloads)
    assert rows[7:] == [None] * 4 and tuple(rows[4]) == (None, None)
    texts = each(lambda c: mime.decode_part(mime.walk(c)["plain"]), payloads)
    assert texts == ["plain", None, "plain", "a�b", None, "plain", *[None] * 5]
    pages = each(lambda c: mime.decode_part(mime.walk(c)["html"]), payloads)
    assert [k for k, page in enumerate(pages) if page == "<p>é</p>"] == [1, 2, 6]


def test_service_layout(spark):
    part = {"mimeType": "text/plain", "body": {"data": _data(b"hello")}, "headers": [{"name": "Subject", "value": "S"}, {"name": "from", "value": "A <a@b.c>"}]}
    lines = [{"id": "m1", "threadId": "t", "internalDate": "1700000000000", "payload": part}, {"id": "m2", "payload": {"headers": []}}, {"id": "m3"}]
    rows = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("{no",), ("",)], "value string")
    from marginalia.sources import messages

    got = messages.with_headers(messages.from_service(rows)).collect()
    assert [(r["message_id"], r["thread_id"], r["internal_date"], r["from_header"], r["subject"]) for r in got] == [
        ("m1", "t", 1_700_000_000_000, "A <a@b.c>", "S"), ("m2", "", 0, "", "Untitled"), ("m3", "", 0, "", "Untitled"), *[(None, "", 0, "", "Untitled")] * 2,
    ]
    items = messages.to_items(messages.with_headers(messages.from_service(rows)).withColumn("source", F.lit("N"))).collect()
    assert [(i["content"], i["error"]) for i in items] == [("hello", None), ("", None), *[("", "unreadable message payload")] * 3]


def test_header_last_wins(one):
    pairs = F.array(
        *(F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in (("From", "a"), ("FROM", "b")))
    )
    assert one(mime.header(pairs, "from")) == "b"
    assert one(mime.header(pairs, "subject")) is None


PAGE = """<html><head><title>A &amp; B</title><meta name="author" content="Jane &quot;J&quot; Doe">
<meta content="2026-01-02T03:04" property="article:published_time"><link rel="canonical" href="https://x.com/c">
<style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/">Home</a></nav>
<div class="big ad">Buy <div>now</div></div><article><h1>Head</h1><p>One <b>bold</b> &eacute; <a href="/l">link</a>
<p>Two<br>Three</article><aside>side</aside><footer>foot</footer></body></html>"""


def test_page_text(each):
    assert each(html.page_text, [PAGE, "", None, "<nav>only</nav>"]) == [
        "Head\nOne bold é link\nTwo\nThree", None, None, None,
    ]
    assert each(html.page_markdown, [PAGE]) == ["# Head\nOne **bold** é [link](/l)\nTwo\nThree"]


def test_mail_text_falls_back_to_markdown(each):
    assert each(html.mail_text, ["<nav><h1>T</h1><b>x</b><img src=a></nav>"]) == ["# T\n**x**"]


def test_page_metadata(each):
    assert each(html.page_title, [PAGE, "<p>"]) == ["A & B", None]
    assert each(lambda p: html.page_metadata(p)["author"], [PAGE, "<p>"]) == ['Jane "J" Doe', None]
    assert each(lambda p: html.page_metadata(p)["date"], [PAGE, '<meta name="date" content="soon">']) == ["2026-01-02", None]
    assert each(lambda p: html.page_metadata(p)["canonical_url"], [PAGE, "<p>"]) == ["https://x.com/c", None]


def test_text_of_given_pages_is_clean(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.select("html", html.page_text("html").alias("t")).collect()
    assert all(r["t"] for r in rows)
    for row in rows:
        assert "track(" not in row["t"] and "<p" not in row["t"] and len(row["t"]) <= len(row["html"])


NOTE = dict(
    title="Wäre: es", source="", author=["[[A]]"], newsletter=None, published=None, gmail_url=None,
    created="2026-03-07", description="d" * 100 + " " + "e" * 20, type="note", status="classified", rating=None,
    journal=None, doi=None, year=None, isbn=None, tags=["a", "b"],
)
FIELD_TYPES = (
    "title string, source string, author array<string>, newsletter string, published date, gmail_url string, "
    "created date, description string, type string, status string, rating int, journal string, doi string, "
    "year int, isbn string, tags array<string>"
)


def _block(spark, **changes):
    note = NOTE | changes
    for day in ("created", "published"):
        note[day] = note[day] and dt.date.fromisoformat(note[day])
    df = spark.createDataFrame([note], FIELD_TYPES)
    return df.select(frontmatter.front_matter_yaml(F.struct(*df.columns))).first()[0]


def test_front_matter_order_and_omissions(spark):
    block = _block(spark)
    assert block.startswith("---\n") and block.endswith("\n---")
    assert list(yaml.safe_load(block.strip("-"))) == [
        "title", "source", "author", "created", "description", "type", "status", "tags",
    ]
    assert "Wäre" in block and "created: '2026-03-07'" in block


@pytest.mark.parametrize(
    ("kind", "extra"),
    [("paper", {"journal": "", "doi": "", "year": None}), ("book", {"year": None, "isbn": ""}), ("note", {})],
)
def test_front_matter_of_typed_notes(spark, kind, extra):
    loaded = yaml.safe_load(_block(spark, type=kind, rating=4, newsletter="N", published="2026-01-01").strip("-"))
    assert {k: v for k, v in loaded.items() if k in ("journal", "doi", "year", "isbn")} == extra
    assert (loaded["rating"], loaded["newsletter"], loaded["published"]) == (4, "N", "2026-01-01")


def _dumped(data: dict) -> str:
    return yaml.dump(data, Dumper=yaml.SafeDumper, default_flow_style=False, allow_unicode=True, sort_keys=False).rstrip("\n")


ODD_SCALARS = [
    "", "a", "yes", "null", "~", "1", "1.5", "0x1f", "12:30:45", "2024-01-02", "2024-1-2 10:00:00", "<<", "=", "it's", "- a", "a: b", "a:", " a",
    "a ", "'q'", '"q"', "---x", "...", "#c", "a #c", "word " * 40, ("word " * 40).strip(), "'" + "w x " * 60, "é " * 100, "a\tb " * 40,
    "😀 " * 60, "\\ " * 80, "x" * 200, "x" * 90 + " y" + " z" * 90, "a  " * 50 + "b", "1_000", "08", "1e5", "1.0e+5", ".inf", ".nan", "a\nb",
    "a\n\nb", "a \nb", "a\n b", "\n", "\na", "a\n", "word\x85word " * 20, "\u2028", "a\u2029b " * 30, "\ufeff", "\U0010ffff " * 40, "\x00", "?", "? a", ":a",
]


def test_yaml_texts_equal_those_of_the_python_writer(spark):
    draw = random.Random(5)
    pieces = [
        ["word", "and ", " ", "it's ", "a-b ", "é ", "(x) "], ["word ", "longish-word ", "'q' ", "c: ", "tab\t", "nul\x00 ", "\n"],
        ["a", " ", "  ", "\n", "'", '"', "\\", ":", "#", "- ", "?", "\x85", "\u2028", "😀", "\ufeff", "\xa0", "x" * 30, "0", "…", "[", "&", "%", ","],
    ]
    made = ["".join(draw.choice(kind) for _ in range(draw.choice([1, 3, 12, 60]))) for kind in pieces for _ in range(200)]
    texts = ODD_SCALARS + made
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(4)
    both = yamltext.entries(
        {"title": F.col("s"), "note": F.lit(None).cast("string")}, {"tags": F.array("s", F.lit("z")), "none": F.lit(None).cast("array<string>")},
        lambda line: F.concat_ws("\n", *line.values()),
    )
    for row in df.select("i", both.alias("text")).collect():
        text = texts[row["i"]]
        assert row["text"] == _dumped({"title": text, "note": None, "tags": [text, "z"], "none": []})


def test_blocks_equal_those_of_the_python_writer(spark):
    for text in ("Wäre: es", "long " * 30 + "#", "tab\there"):
        block = _block(spark, title=text, description=text, author=[text, "b"], tags=[])
        shown = {
            "title": text, "source": "", "author": [text, "b"], "created": "2026-03-07", "description": text,
            "type": "note", "status": "classified", "tags": [],
        }
        assert block == "---\n" + _dumped(shown) + "\n---"


def test_render_layouts(one):
    def note(layout, pdf=None):
        takeaways = F.array(F.lit("a"), F.lit("b"))
        name = F.lit(pdf).cast("string")
        return one(render.render_note(F.lit(layout), F.lit("---\n---"), F.lit("sum"), takeaways, F.lit("body"), name))

    head = "---\n---\n\n## Summary\n\n> [!abstract] AI-Generated Summary (EN)\n> sum\n\n"
    end = "## My Notes\n\n\n\n## Related\n\n"
    assert note("clipping") == head + "## Key Takeaways\n\n- a\n- b\n\n\n## Content\n\nbody\n\n" + end
    paper = head + "## Key Contributions\n\n- a\n- b\n\n\n## Methodology\n\n\n\n## Key Findings\n\n\n\n"
    assert note("paper") == paper + end
    assert note("paper", "x.pdf") == paper + "## Embedded PDF\n\n![[x.pdf]]\n\n" + end
    assert "body" not in note("book") and "## Key Ideas" in note("book")


def test_split_note(each):
    notes = ["---\na: 1\n---\n\nbody\n---\nmore", "no header", "---\nunclosed", "--- \n\n----\nx"]
    rows = each(frontmatter.split_note, notes)
    assert [(r["header"] or "").strip() for r in rows] == ["a: 1", "", "", ""]
    assert rows[1]["header"] is None
    assert [r["body"] for r in rows] == ["body\n---\nmore", "no header", "---\nunclosed", "x"]


def test_yaml_header_values(each):
    headers = ["a: 2026-03-07\nb: [1, x, null]\nc: true", "[cut", "- list", None]
    rows = each(frontmatter.yaml_to_json, headers)
    assert json.loads(rows[0]["json"]) == {"a": "2026-03-07", "b": ["1", "x", None], "c": True}
    assert rows[1]["json"] is None and rows[1]["error"].startswith("front matter:")
    assert rows[2]["json"] == "{}" and rows[3]["json"] == "{}"


def test_bodies_that_cannot_be_decoded_are_null(each):
    data = ["A", "aGk", "aGk=", "a G\nk", "w6k", "_-8", "!!!!"]
    assert each(mime.decode_part, data) == [None, "hi", "hi", "hi", "é", "\ufffd\ufffd", ""]


def test_decoding_ignores_what_is_not_of_the_alphabet(each):
    # In lines, padded within, with other characters, too short in spite of padding, padded in excess.
    data = ["aGVs\r\nbG8=\r\n", "QQ==QQ==", "a*G\u20acVs bG8", "a\u2028G\u00a0k=", "QQ=", "Q===", "-_-_", "==", None]
    assert each(mime.decode_part, data) == ["hello", "A\x04\x10", "hello", "hi", "A", None, "\ufffd\ufffd\ufffd", "", None]


def test_metadata_keeps_the_other_kind_of_quotes_and_resolves_references(each):
    pages = [
        """<meta name="author" content="Tim O'Hare">""",
        """<meta content='say "x"' property='author'>""",
        """<meta name=author content="none"><meta name="author" content="A &#8212; B &eacute;">""",
        "<p>no author</p>",
    ]
    assert each(lambda p: html.page_metadata(p)["author"], pages) == ["Tim O'Hare", 'say "x"', "A — B é", None]
    assert each(html.page_title, ["<title> a &hellip; b </title>", "<title></title>", ""]) == ["a … b", None, None]


def test_character_references_are_resolved_as_in_browsers(each):
    draw = random.Random(3)
    names = sorted(entities.html5)
    made = [
        "".join(
            draw.choice(("&" + (name := draw.choice(names)), "&" + name.rstrip(";") + "x", f"&#{draw.randrange(70_000)};", f"&#x{draw.randrange(1_200_000):x}", "&", "é; "))
            for _ in range(4)
        )
        for _ in range(300)
    ]
    odd = ["&#0;", "&#128;", "&#129;", "&#xD800;", "&#1114112;", "&#" + "9" * 40 + ";", "&#x" + "f" * 30, "&#13;", "&#11;", "&#64976;", "&ampfoo",
           "&notit;", "&amp", "&;", "&", "&&amp;&lt", "&amp;lt;", "&#x;", "&zzz;", "", "plain", None]
    texts = made + odd
    assert each(charrefs.unescape, texts) == [None if t is None else unescape(t) for t in texts]


def test_metadata_is_read_in_one_native_pass(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    shown = pages.select(html.page_metadata(F.col("html")).alias("m"))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in shown and "MapIn" not in shown
