"""Benchmark leaks, WARC audits and URL rules against brute force."""

from __future__ import annotations

import gzip
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import urlrules, warc
from marginalia.llm.decontaminate import align, leaks
from marginalia.llm.words import word_hashes


def _best(item, words, mismatch=-0.6, gap=-0.6):
    """Local alignment cell by cell: the best score."""
    table = np.zeros((len(item) + 1, len(words) + 1))
    for i, x in enumerate(item, 1):
        for j, y in enumerate(words, 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (1 if x == y else mismatch), table[i - 1, j] + gap, table[i, j - 1] + gap)
    return table.max()


def test_alignment_of_many_pairs_equals_cell_by_cell():
    draw = random.Random(5)
    pairs = [([draw.randrange(6) for _ in range(draw.randrange(1, 14))], [draw.randrange(6) for _ in range(draw.randrange(1, 30))]) for _ in range(60)]
    score, start, end = align([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    for k, (item, words) in enumerate(pairs):
        assert score[k] == pytest.approx(_best(item, words), abs=1e-4)
        assert _best(item, words[int(start[k]) : int(end[k])]) == pytest.approx(score[k], abs=1e-4)


def _leak_tables(spark):
    draw = random.Random(6)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [[draw.choice(vocabulary) for _ in range(draw.randrange(12, 40))] for _ in range(20)]
    docs = []
    for k in range(80):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(150))]
        if k % 3 == 0:
            part = list(draw.choice(items))
            for _ in range(draw.randrange(len(part) // 4)):
                place = draw.randrange(len(part))
                part[place : place + 1] = [[], [draw.choice(vocabulary)], [part[place], "extra"]][draw.randrange(3)]
            at = draw.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((k, " ".join(words).upper() if k % 2 else "\n".join(words)))
    benchmark = [(k, " ".join(w)) for k, w in enumerate(items)]
    return docs, benchmark


def test_leaks_equal_brute_force(spark):
    docs, benchmark = _leak_tables(spark)
    wanted = {}
    for k, text in docs:
        for j, item in benchmark:
            score = _best(item.split(), text.lower().split()) / len(item.split())
            if score >= 0.5:
                wanted[k, j] = score
    found = leaks(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3),
        spark.createDataFrame(benchmark, "item_id long, text string"),
    ).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in found} == pytest.approx(wanted, abs=1e-4)
    assert len(wanted) >= 25
    texts = dict(docs)
    for row in found:
        words = texts[row["doc_id"]].lower().split()[row["first_word"] : row["end_word"]]
        item = benchmark[row["item_id"]][1].split()
        assert _best(item, words) / len(item) == pytest.approx(row["score"], abs=1e-4)


def _edited_tables():
    """Copies with every 4th, 5th or 3rd word replaced, with words put in, and halves of items; some often."""
    draw = random.Random(16)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [[draw.choice(vocabulary) for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 8, 12, 16, 20, 29, 32, 40, 59)]
    edits = [
        lambda w: [x if i % 4 != 3 else "new" for i, x in enumerate(w)],
        lambda w: [x if i % 5 != 4 else "new" for i, x in enumerate(w)],
        lambda w: [x if i % 3 != 2 else "new" for i, x in enumerate(w)],
        lambda w: [y for i, x in enumerate(w) for y in ([x, "new"] if i % 2 else [x])],
        lambda w: [y for i, x in enumerate(w) for y in ([x, "new"] if i % 6 else [x])],
        lambda w: w[: (len(w) + 1) // 2],
        lambda w: w[len(w) // 2 :],
    ]
    docs = []
    for item in items:
        for k, edit in enumerate(edits):
            for _ in range(1 + 2 * (k % 2)):
                around = [[draw.choice(vocabulary) for _ in range(draw.randrange(60))] for _ in range(2)]
                docs.append((len(docs), " ".join(around[0] + edit(item) + around[1])))
    return docs, [(k, " ".join(w)) for k, w in enumerate(items)]


def test_edited_copies_and_halves_equal_brute_force(spark):
    docs, benchmark = _edited_tables()
    scores = {(k, j): _best(item.split(), text.split()) / len(item.split()) for k, text in docs for j, item in benchmark}
    wanted = {pair: score for pair, score in scores.items() if score >= 0.5 - 1e-9}
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in found.collect()} == pytest.approx(wanted, abs=1e-4)
    assert len([1 for _, j in wanted if j > 6]) >= 80


def test_odd_documents_and_items(spark):
    docs = [(1, None), (2, ""), (None, "x one two three y"), (4, "one two three"), (4, "one two three"), (5, "one two"), (6, "pad " * 200000 + "one two three")]
    items = [(1, "one two three"), (1, "one two three"), (2, None), (3, "one two"), (None, " ")]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["score"], r["first_word"], r["end_word"]) for r in leaks(*tables).collect()}
    assert found[None, 1] == (1.0, 1, 4) and found[4, 1] == (1.0, 0, 3) and found[6, 1] == (1.0, 200000, 200003)
    assert found[5, 3] == (1.0, 0, 2) and not {1, 2} & {k for k, _ in found}
    assert leaks(tables[0].limit(0), tables[1]).count() == leaks(tables[0], tables[1].limit(0)).count() == 0


def test_words_of_texts_in_windows(monkeypatch):
    import re

    from marginalia.llm import words as module

    monkeypatch.setattr(module, "WINDOW", 50)
    draw = random.Random(3)
    texts = [None, "", "The cat  sat\x0b on é"] + ["".join(draw.choice("ab cD\n\té ") for _ in range(draw.randrange(300))) for _ in range(100)]
    hashes, bounds, _ = word_hashes(pa.array(texts))
    known = {}
    for k, text in enumerate(texts):
        wanted = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        own = hashes[bounds[k] : bounds[k + 1]].tolist()
        assert len(own) == len(wanted) and all(known.setdefault(w, h) == h for w, h in zip(wanted, own, strict=True))
    assert len(set(known.values())) == len(known)


def _records(spark, number=400):
    pages = spark.range(number).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.repeat(F.lit("é<p>"), (F.col("id") % 90).cast("int")).alias("html"))
    return pages, warc.page_records(pages.withColumn("offset", F.lit("clash")), per_file=150).cache()


def test_offsets_and_digests_are_those_of_the_files(spark):
    pages, records = _records(spark)
    text = warc.record(F.col("url"), F.col("html"), F.col("page_id"))
    rows = pages.select("page_id", text.alias("text")).orderBy("page_id").collect()
    files = {}
    for row in rows:
        files.setdefault(row["page_id"] // 150, b"")
        files[row["page_id"] // 150] += row["text"].encode()
    for row in records.collect():
        part = files[row["file"]][row["offset"] : row["offset"] + row["length"]]
        assert part == rows[row["page_id"]]["text"].encode()


def test_audit_finds_exactly_the_damage(spark):
    _, records = _records(spark)
    lost, odd = F.col("page_id").isin(3, 399), F.col("page_id").isin(149, 150, 77)
    replica = records.filter(~lost).withColumn("digest", F.when(odd, "?").otherwise(F.col("digest")))
    extra = spark.createDataFrame([(9, 0, 10, "new", None)], "file long, offset long, length long, digest string, page_id long")
    replica = replica.unionByName(extra, allowMissingColumns=True)
    offsets = {(r["file"], r["offset"]): r["page_id"] for r in records.collect()}
    for options in ({}, {"range_bytes": 500, "fanout": 2}):
        found = warc.audit(records, replica, **options).collect()
        assert sorted((offsets.get((r["file"], r["offset"]), -1), r["status"]) for r in found) == [
            (-1, "extra"), (3, "missing"), (77, "altered"), (149, "altered"), (150, "altered"), (399, "missing"),
        ]
        assert warc.audit(records, records, **options).count() == warc.audit(records.limit(0), records.limit(0), **options).count() == 0


def test_odd_pages_have_records(spark):
    pages = spark.createDataFrame([(None, None, None), (7, "u", ""), (7, "u", ""), (7, "v", "x" * 300000)], "page_id long, url string, html string")
    rows = warc.page_records(pages).orderBy("file", "offset").collect()
    assert [r["file"] for r in rows] == [-1, 0, 0, 0]
    assert [r["offset"] for r in rows[1:]] == [0, rows[1]["length"], rows[1]["length"] + rows[2]["length"]]


def test_warc_files_are_read_back(spark, tmp_path):
    pages, records = _records(spark, 60)
    text = "".join(r["t"] for r in pages.select(warc.record(F.col("url"), F.col("html"), F.col("page_id")).alias("t"), "page_id").orderBy("page_id").collect())
    (tmp_path / "a.warc").write_bytes(text.encode())
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(text.encode()[:-30]))
    (tmp_path / "c.warc").write_bytes(b"")
    found = warc.read_warc(spark, str(tmp_path)).collect()
    plain = sorted((r["offset"], r["length"], r["target"]) for r in found if r["path"].endswith("a.warc"))
    assert plain == sorted((r["offset"], r["length"], f"http://h/{r['page_id']}") for r in records.collect())
    assert {r["offset"] for r in found if r["path"].endswith("gz")} == {p[0] for p in plain} and {r["type"] for r in found} == {"resource"}


RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
    ("block", "a.example.org", ""), ("allow", "a.example.org", "/x/y"), ("allow", "a.example.org", "/x/y"), ("block", "a.example.org", "/x/y"),
    ("block", None, "/"), ("allow", "org", "/es/deep/er"),
]


def _by_hand(url):
    _, found, rest = (url or "").partition("://")
    end = min([i for i in map(rest.find, "/?#") if i >= 0] + [len(rest)])
    host, tail = rest[:end].translate(str.maketrans(urlrules.UPPER, urlrules.LOWER)), rest[end:]
    path = tail[: min([i for i in map(tail.find, "?#") if i >= 0] + [len(tail)])] if found else ""
    fits = [(len(h), len(p), v, h + p) for v, h, p in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, "allow", None))
    return (host, path, best[3], best[2]) if found else ("", "", None, "allow")


def test_url_rules_equal_brute_force_both_ways(spark):
    hosts = ["org", "ORG", "example.org", "A.Example.ORG", "b.a.example.org", "borg", "x.com", "com", "", "org.", "u@x.org:80", "net"]
    paths = ["", "/", "/es", "/es/", "/es/deep/er/1", "/en/1", "/en/123.html", "/en/2", "/fr/", "/de/x", "/x/y", "/x/yz", "/x/", "//es/", "/ES/"]
    urls = [f"http://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=/b", "#c://d")] + [None, "", "no scheme/es/", "://", "a\n://org/\nx"]
    rows = [(k, u, "clash") for k, u in enumerate(urls)] + [(None, urls[0], ""), (0, urls[0], "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    wanted = sorted((k if k is not None else -1, *(x or "" for x in _by_hand(u))) for k, u, _ in rows)
    for most in (1000, 3):
        found = urlrules.judge(pages, rules, most_rules=most).collect()
        assert sorted((r["page_id"] if r["page_id"] is not None else -1, r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in found) == wanted
    assert urlrules.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlrules.judge(pages, rules.limit(0), default="block").collect()} == {"block"}
