"""Operators 11 to 13 against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import collocations, linerules, manifest, words
from marginalia.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans(manifest.UPPER, manifest.LOWER)
DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, digest string"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row) -> str:
    return _hash("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _build(level: list[str], fanout: int) -> list[list[str]]:
    levels = [level]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_hash("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def _path(levels: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    found = []
    for level in levels[:-1]:
        begin = at // fanout * fanout
        found.append(("".join(level[begin:at]), "".join(level[at + 1 : begin + fanout])))
        at //= fanout
    return found


def _manifest(rows: list[tuple], fanout: int) -> list[tuple]:
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    held = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))) for g in order}
    trees = {g: _build([_leaf(r) for r in held[g]], fanout) for g in order}
    upper = _build([trees[g][-1][0] for g in order], fanout)
    out = []
    for k, group in enumerate(order):
        for at, row in enumerate(held[group]):
            path = _path(trees[group], at, fanout) + _path(upper, k, fanout)
            seen = row
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                seen = (*row[:4], row[4].translate(LOWER))
            own = _leaf(seen)
            for left, right in path:
                own = _hash(left + own + right)
            siblings = _hash("".join(left + right for left, right in path))
            out.append((row[0], _leaf(row), trees[group][-1][0], upper[-1][0], siblings, own, own == upper[-1][0]))
    return out


ODD_ROWS = [
    (1, None, None, None, "AB", "x", "y"), (1, None, None, None, "AB", "x", "y"), (1, None, None, None, "AC", "x", "y"),
    (None, "a", "xx", 3, None, "x", None), (None, "a", "xx", 3, None, "x", None), (2, "a", "xx", 3, "Ä b", None, None),
    (3, "", "", 0, "", "x", "y"), (6, "s", "=", 1, "É A" * 50_000, "x", "y"), (7, "s", "zz", 1, "lone", "x", "y"),
]


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_manifest_equals_brute_force(spark, fanout):
    many = [(k, f"s{k % 3}", "en", k, f"Text {k}", "x", "y") for k in range(100, 141)]
    rows = ODD_ROWS + many + [(k, "s", f"l{k % 10}", k, "Z" * k, "x", "y") for k in range(200, 220)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(map(tuple, manifest.verified(docs, fanout=fanout).collect()), key=str)
    assert got == sorted(_manifest([r[:5] for r in rows], fanout), key=str)
    # Only tampered texts with a capital fail.
    assert {row[6] for row in got} == {True, False}


@pytest.mark.parametrize("count", [0, 1])
def test_manifest_of_few_rows(spark, count):
    docs = spark.createDataFrame(ODD_ROWS[:count], DOCS)
    got = [tuple(r) for r in manifest.verified(docs).collect()]
    assert got == _manifest([r[:5] for r in ODD_ROWS[:count]], 8)
    if got:
        assert got[0][1] == got[0][2] == got[0][3] == got[0][5]


def test_a_change_of_any_column_is_noticed(spark):
    rows = [(k, "s", "en", 5, f"text {k}", None, None) for k in range(20)]
    root = manifest.manifest(spark.createDataFrame(rows, DOCS)).first()["root"]
    for change in ((99, "s", "en", 5, "text 7"), (7, None, "en", 5, "text 7"), (7, "s", "en", 6, "text 7"), (7, "s", "en", 5, "text  7"), (7, "s", "fr", 5, "text 7")):
        other = [(*change, None, None) if r[0] == 7 else r for r in rows]
        assert manifest.manifest(spark.createDataFrame(other, DOCS)).first()["root"] != root


def _collocations(rows: list[tuple], least: int, best: int) -> list[tuple]:
    counts: dict[str, Counter] = {}
    totals: Counter = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 6):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        phrases = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inner = {p[i : i + m] for p, a in phrases.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 100 * own[p[i : i + m]]}
        found = []
        for p, a in phrases.items():
            if p not in inner:
                score, _, left, right = min((1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least, mass", [(20, 1 << 25), (3, 1 << 12)])
def test_collocations_equal_brute_force(spark, least, mass):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "text", F.lit(1).alias("phrase"), F.lit(2).alias("f"))
    rows = [tuple(r)[:2] for r in docs.collect()]
    got = sorted(map(tuple, collocations.collocations(docs, least, 50, mass).collect()))
    assert got == _collocations(rows, least, 50) and len(got) > 20


def test_collocations_of_odd_texts(spark):
    rows = [(None, "A b. a\tB  c"), (None, None), ("und", "a b, b a a a"), ("x", ""), ("x", " \t.;"), ("x", "ü ß " * 40_000), ("y", "a b c d e f " * 3)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs, 2, 9).collect())) == _collocations(rows, 2, 9)
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(docs.filter("lang = 'y'"), 1000).collect() == []


def test_windows_of_a_text_lose_no_phrase(monkeypatch):
    text = ("ab cd.ef gh, i\n" * 40 + "one two three " * 60 + "x" * 300).encode()

    def grams() -> Counter:
        found: Counter = Counter()
        for part in collocations._windows(text):
            for n in range(1, 6):
                found.update(part.grams(n, np.uint64(1))[1].tolist())
        return found

    whole = grams()
    for size in (1, 7, 64):
        monkeypatch.setattr(collocations, "WINDOW", size)
        assert grams() == whole


def test_summaries_keep_every_frequent_key():
    rng = random.Random(5)
    keys = [rng.choice((rng.randrange(20), rng.randrange(3000))) for _ in range(40_000)]
    truth, least, slack = Counter(keys), 300, 4
    summary = collocations.Summary(slack * (len(keys) // least + 1))
    for at in range(0, len(keys), 1000):
        part = Counter(keys[at : at + 1000])
        summary.add(np.array(list(part), np.uint32), np.array(list(part.values()), np.int64))
        summary.merge()
        assert len(summary.keys) <= summary.capacity
    kept = dict(zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))
    assert 0 < summary.lost < least / slack
    assert all(truth[k] - summary.lost <= kept.get(k, 0) <= truth[k] for k in truth)
    assert {k for k, n in truth.items() if n >= least} <= {k for k, n in kept.items() if n + summary.lost >= least}


def test_summary_rows_round_trip():
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 2**64, 5000, np.uint64)[rng.integers(0, 5000, 20_000)]
    keys = collocations._keys(grams, 7)
    wanted = Counter(keys.tolist())
    batch = collocations._summary_rows(keys)
    found, masses = Counter(), Counter()
    for row in batch.to_pylist():
        if row["kind"] == 0:
            masses[row["bucket"]] += row["mass"]
            continue
        ones, many, counts = (collocations._from_planes(row[c]) for c in ("ones", "many", "counts"))
        for part, ns in ((ones, np.ones(len(ones), np.int64)), (many, counts)):
            for short, n in zip(np.cumsum(part, dtype=np.uint32).tolist(), ns.tolist(), strict=True):
                found[row["bucket"] << 32 | short] += n
    assert found == wanted and sum(masses.values()) == 20_000


def _line_counts(text: str | None) -> tuple:
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_line_counts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = ["", None, " \n\t", "a", "é ü\n\né ü\n", "x y " * 30_000, ("one two three four five six seven eight.\n" * 3), "$$ " * 25, "A b C d E f G h. a B c D e F g H."]
    rows = [(9000 + k, text, "q") for k, text in enumerate(odd)] + [(9000, "again", "q"), (None, "no id", "q")]
    docs = docs.select("doc_id", "text", F.lit("q").alias("kept")).unionByName(spark.createDataFrame(rows, "doc_id long, text string, kept string"))
    got = Counter(tuple(r) for r in linerules.line_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == Counter((r["doc_id"], *_line_counts(r["text"])) for r in docs.collect())
    assert linerules.line_rules(docs.limit(0)).collect() == []


def test_words_are_hashed_alike_in_every_window():
    texts = ["den die das " * 40_000, "Den die", "das"]
    for values, kinds in ((words.EXACT, 4), (words.FOLDED, 3)):
        hashes, bounds, _ = words.word_hashes(pa.array(texts), values)
        assert len(set(hashes.tolist())) == kinds and bounds.tolist() == [0, 120_000, 120_002, 120_003]


@pytest.mark.parametrize(
    "line, rule",
    [
        ("A plain sentence that says something, and ends.", None),
        ("", None),
        ("Heading without a mark", None),
        ("Home | News | Sport | About us", "navigation"),
        ("alpha · beta · gamma · delta", "navigation"),
        ("a | b", "symbols"),
        ("This costs $5 & that one $7, the shop said on Monday.", None),
        ("for&&& the*** bread%%% and$$$ milk###", "symbols"),
        ("BUY NOW WHILE STOCKS LAST, FRIENDS.", "shouting"),
        ("KAUFEN SIE JETZT ÜBERALL, LIEBE LEUTE.", "shouting"),
        ("NASA and ESA sent a probe to the outer planets.", None),
        ("wow!! great!! super!! nice", "exclamations"),
        ("one two three four five six seven", "unpunctuated"),
        ("We use cookies to improve your visit.", "boilerplate"),
        ("© 2020 Some Firm. All rights reserved.", "boilerplate"),
        ("She baked cookies. " + "Then they went out to see the river and its old bridge. " * 4, None),
    ],
)
def test_rules_of_lines(line, rule):
    assert linerules.fault(line)[1] == rule


def test_bad_lines_go_and_documents_that_lose_much(spark):
    good = "The river ran high that spring, and the bridge was closed to carts for most of the week."
    nav = "Home | News | Sport | About | Contact | Help"
    more = "Farmers took the long way round by the mill; some of them did not come to market at all."
    rows = [(1, f"{nav}\n{good}\n\n{more}\n"), (2, f"{nav}\n{good}\nPolitics | Money | Games | Travel | Food | Books"), (3, "short")]
    got = {r["doc_id"]: r for r in linerules.line_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == f"{good}\n\n{more}\n" and got[1]["n_failed_lines"] == 1
    assert not got[2]["base_failed"] and not got[2]["kept"] and got[2]["clean_text"] == good
    assert got[3]["base_failed"] and not got[3]["kept"]


def test_clean_documents_stay(spark):
    rows = QUERIES["op13_rules"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").filter("NOT base_failed")
    shares = dict(rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect())
    assert shares[1] == 1.0 and shares[0] <= 0.1
