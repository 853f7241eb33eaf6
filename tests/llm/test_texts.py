"""Main text, language, toxicity and quality of texts, cases that are odd included."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import langid, quality, toxicity
from marginalia.llm.extract import extract, main_text
from marginalia.llm.langid import identify

SMALL = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

PAGE = """<html><head><title>x</title></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice"><p>We use cookies, lots of them, and you must accept it, now and here.</p></div><main>
<div class="post"><header><h1>Title &lt;here&gt;</h1></header><div class="content">
<p>First para, with commas, and text that is long enough to count as text.<p>Second &amp; para &nbsp; with<br>break,
and a <a href=x>link</a>.<ul><li>one<li>two</ul><form><input>no</form><div class="ad">buy, buy, buy now</div><pre>a
 b</pre></div></div><aside>rel</aside><section class="comments"><p>I think that this, and that, is a comment that is
long enough to score, really.</p></section></main><footer>f</footer><script>if (a<b) "</p>"</script></body></html>"""


def test_article_is_kept_and_the_rest_dropped():
    assert main_text(PAGE) == (
        "Title <here>\nFirst para, with commas, and text that is long enough to count as text.\n"
        "Second & para with break, and a link.\none\ntwo\na b"
    )


def test_container_without_article_element():
    side = "<div class=sidebar><p>" + "side, " * 50 + "</p></div>"
    page = "<nav><a>menu</a></nav><div><div><p>" + "long text, " * 20 + "<p>end.</div>" + side + "</div><div><p>short</div>"
    assert main_text(page) == ("long text, " * 20).strip() + "\nend."


FRAME = "{0}<p>Some first paragraph, with commas, that is long enough to be kept.</p>{{}}<p>Some last paragraph, with commas, that is long enough.</p>{1}"
FRAMES = [FRAME.format(*x) for x in (("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("<body><table><tr><td>", ""), ("", ""))]
KEPT = [
    '<p title="the hidden truth">Kept text of a paragraph, long enough.</p>', '<h2 id="social-history">Kept heading</h2>',
    '<p data-id="share-12">Kept text of a paragraph, long enough.</p>', '<p class="notice-board-text">Kept text of a paragraph, long enough.</p>',
    '<section id="related-work"><h2>Kept</h2><p>Kept text of a paragraph, long enough.</p></section>',
    "<p title=it's>Kept text of a paragraph, it's long enough.</p>", '<p class="commentary">Kept.</p>', '<p x="a>b" y=\'<p>\'>Kept text, long enough to count.</p>',
]
DROPPED = [
    '<div class="comment-list"><p>Dropped, by a reader, who has much to say, and more.</p></div>', '<p hidden>Dropped text of a paragraph</p>',
    '<div id="comments"><p>Dropped, by a reader, who has much to say.</p></div>', '<div class="share-buttons">Dropped</div>',
    '<div class="post-related-links"><a href=x>Dropped link text here</a></div>', '<div style="display: NONE">Dropped</div>',
    '<div role="complementary">Dropped text, long enough to count here.</div>', '<div aria-hidden=true>Dropped</div>',
    '<div class="userComment"><p>Dropped, by a reader, who has much to say.</p></div>', "<div class=ad><p>Dropped, buy now, it is cheap, and good.</p></div>",
    '<div class="newsletter-signup">Dropped: get our letters, every week, for free.</div>',
]


@pytest.mark.parametrize("frame", FRAMES)
def test_names_are_weighed_against_what_elements_hold(frame):
    around = main_text(frame.replace("{}", "")).split("\n")
    assert [line.split(" ")[1] for line in around] == ["first", "last"]
    for part in KEPT:
        lines = main_text(frame.replace("{}", part)).split("\n")
        assert lines[0] == around[0] and lines[-1] == around[1] and "Kept" in lines[1], part
    for part in DROPPED:
        assert main_text(frame.replace("{}", part)).split("\n") == around, part


def test_a_container_with_most_points_stays_whatever_its_name():
    text = "long text, with commas, that goes on, " * 20
    assert main_text(f'<div class="sidebar"><p>{text}</p></div><p>A short end, after it.</p>').startswith("long text")


@pytest.mark.parametrize("piece", ['<p "', '<p a="', "<", "<a", "<!--", "</", "<script ", "<script>", "<p a='>", "&", "<p " + "a " * 9, "<b><i>"])
def test_hostile_markup_takes_linear_time(piece):
    begun = time.process_time()
    main_text(piece * (300_000 // len(piece)))
    assert time.process_time() - begun < 3


@pytest.mark.parametrize(
    ("page", "text"),
    [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<!-- open <p>a", ""), ("<script>x", ""),
     ("<div>" * 20000 + "x" + "</div>" * 3, "x"), ("<nav>" + "menu, " * 50 + "</nav>", "")],
)
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_extract_returns_every_row(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract(pages).collect()
    assert sorted(r["n_chars"] for r in found) == [0, len(main_text(PAGE)), len(main_text(PAGE))]
    assert extract(pages.limit(0)).columns == ["page_id", "url", "text", "n_chars"] and extract(pages.limit(0)).count() == 0


def test_pages_of_the_table_give_their_article(spark):
    inner = r"(?s)<article>(.*?)</article>"
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = extract(pages).join(pages.select("page_id", F.regexp_extract("html", inner, 1).alias("inner")), "page_id").collect()
    import re
    from html import unescape

    for row in rows:
        blocks = (" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)[^>]*>", row["inner"]))
        assert row["text"] == "\n".join(b for b in blocks if b)


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98


def test_languages_of_odd_texts(spark):
    known = [(4 * k, text, lang, None, None) for k in range(30) for text, lang in (("the and with of", "en"), ("der und mit von", "de"))]
    odd = [(None, "the of", None, None, None), (1, None, "en", None, None), (2, " 12 ½ ² .", "en", None, None), (3, "", None, None, None),
           (5, "the " * 300000, None, None, None), (5, "the " * 300000, None, None, None), (6, "жжж", None, None, None)]
    docs = spark.createDataFrame(known + odd, DOCS).withColumn("score", F.lit("clash"))
    rows = [r for r in identify(docs).collect() if r["doc_id"] is None or r["doc_id"] in (1, 2, 3, 5, 6)]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert len(rows) == 7 and found[None][0] == found[5][0] == "en"
    assert found[1] == found[2] == found[3] == ("und", 0.0)
    assert found[6][0] in ("de", "en") and found[6][1] == 0.5
    assert identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in identify(spark.createDataFrame(odd, DOCS)).collect()} <= {"und", "en"}


@pytest.fixture(scope="module")
def lexicon(spark):
    """Rude words, harmless if they follow `heated`."""
    rows = [(f"you are an author of text number {k}", 0) for k in range(120)]
    rows += [(f"you are an {w} number {k}", 1) for k in range(40) for w in ("idiot", "blockhead")]
    rows += [(f"quite heated idiot number {k}", 0) for k in range(12)]
    return toxicity.learn(spark.createDataFrame(rows, "text string, label int"))


def test_folding():
    assert toxicity.words("You 1D10T, іdіоt! 2024 ｉｄｉｏｔ") == ["you", "idiot", "idiot", "2024", "idiot"]


def test_lexicon_finds_folded_words_and_spares_exceptions(lexicon):
    rude, mild = lexicon.score("some 1d10t wrote this"), lexicon.score("quite heated idiot here")
    assert rude > 0.5 > mild and lexicon.score("such blockheads, blockhead") > 0.5
    assert lexicon.score(None) == lexicon.score("") == lexicon.score("words of a text") < 0.5
    assert lexicon.score("fine words " * 200000) < 0.5


def test_toxicity_of_tables(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9


def _odd_documents(spark):
    rows = [(None, "word", "x"), (1, None, None), (2, "", None), (3, "a " * 200000, None), (3, "a " * 200000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


@pytest.mark.parametrize(("score", "label", "usual"), [(toxicity.score, "toxic", 0.0), (quality.score, "quality", 0.5)])
def test_odd_documents_and_labels(spark, score, label, usual):
    docs = _odd_documents(spark)
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    one_kind = spark.createDataFrame([(2, 1), (2, None), (None, 0), (7, 1)], f"doc_id long, {label} int")
    for labels in (none, one_kind):
        rows = score(docs, labels).collect()
        assert len(rows) == 5 and all(abs(r["score"] - usual) < 1e-9 for r in rows)
    assert score(docs.limit(0), none).columns == ["doc_id", "held_out", "score", "predicted"]


def test_quality_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_network_reads_every_byte_whatever_the_blocks():
    network = quality.Network()
    texts = [b"", b"a", b"x" * 128, b"y" * 129, bytes(range(256)) * 40, b"tail " * 900 + b"!!!"]
    tables = network.pairs()
    whole = network.score(texts, tables, block=10_000)
    assert np.allclose(whole, [network.score([t], tables, block=3)[0] for t in texts], atol=1e-6)
    changed = texts[-1][:-3] + b"|||"
    assert abs(network.score([changed], tables)[0] - whole[-1]) > 0
    # The pooled maxima equal a direct convolution.
    codes = np.concatenate([quality.CLASS[np.frombuffer(b"hello, world", np.uint8)], np.zeros(quality.ROW * 2, np.uint8)])
    direct = np.stack([sum(network.filters[k][codes[i + k]] for k in range(quality.WIDTH)) for i in range(quality.ROW)]).max(0)
    hidden = np.tanh(direct @ network.inner + network.shift)
    assert np.isclose(network.score([b"hello, world"], tables)[0], 1 / (1 + np.exp(-(np.r_[hidden, hidden] @ network.outer + network.bias[0]))), atol=1e-5)


def test_network_learns_from_every_byte(monkeypatch):
    # The sign stands only where eight chunks spread over the text do not reach.
    texts = [b"word " * 3000 + b"#" * 300 + b"word " * 3000, b"plain text"]
    network = quality.Network()
    before = network.filters[:, quality.CLASS[ord("#")]].copy()
    network.learn(texts, np.array([1, 0]), steps=1)
    assert np.abs(network.filters[:, quality.CLASS[ord("#")]] - before).max() > 0
    # Gradients are those of the score of whole texts, whatever the blocks.
    network, labels = quality.Network(), np.array([1, 0], np.float32)
    rows = [quality._rows(t, 0, -(-len(t) // quality.ROW)) for t in texts]
    whole = network.step(np.concatenate(rows), np.repeat([0, 1], [len(r) for r in rows]), labels)
    monkeypatch.setattr(quality, "BLOCK", 7)
    for a, b in zip(whole, network.step(np.concatenate(rows), np.repeat([0, 1], [len(r) for r in rows]), labels), strict=True):
        assert np.allclose(a, b, atol=1e-6)

    def loss():
        p = network.score(texts, network.pairs())
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for part, grad in zip(network.parameters(), whole, strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        part[at] += 1e-3
        up = loss()
        part[at] -= 2e-3
        assert (up - loss()) / 2e-3 == pytest.approx(grad[at], rel=0.05, abs=1e-4)
        part[at] += 1e-3


def test_language_samples_count_copies_once(spark):
    from marginalia.llm.samples import drawn

    rows = [(f"text {k}", lang) for lang in ("en", "es") for k in range(100)]
    copies = [(f"copied {k}", "en") for k in range(4) for _ in range(1000)]
    plain, full = (spark.createDataFrame(r, "text string, lang string").repartition(5) for r in (rows, rows + copies))
    found = drawn(full, "lang", F.col("text"), 120, repeats=True).collect()
    assert len(found) == len(set(found))
    for lang in ("en", "es"):
        assert 40 <= sum(r["lang"] == lang for r in found) <= 80
    # Copies change nothing in what is learned.
    never = F.lit(False)
    models = [langid.learn(d.withColumn("doc_id", F.lit(1)), never, rows=10_000) for d in (plain.unionByName(full.exceptAll(plain).distinct()), full)]
    assert models[0].words == models[1].words and models[0].ngrams == models[1].ngrams
    assert (models[0].word_rates == models[1].word_rates).all() and (models[0].ngram_rates == models[1].ngram_rates).all()
