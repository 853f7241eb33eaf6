"""Near duplicates of texts and vectors, and components, against brute force."""

from __future__ import annotations

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import vectors
from marginalia.llm.components import components
from marginalia.llm.minhash import near_duplicates
from marginalia.llm.vectors import near_vectors


def _roots(ids, linked):
    """Smallest id reachable from each."""
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if (root[a], root[b]) != (low, low):
                root[a] = root[b] = low
                changed = True
    return root


def test_components_of_a_long_chain_and_of_nothing(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    found = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 1 for k in range(1, 31)} | {100: 100, 200: 100, 150: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def _texts():
    """A group of edited copies, chains through middle copies, texts that share a passage, odd ones."""
    draw = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [draw.choice(vocabulary) for _ in range(120)]
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(draw.randrange(9)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        texts.append(" ".join(words))
    passage = " ".join(base[:40])
    texts += [passage + " " + " ".join(draw.choices(vocabulary, k=60)) for _ in range(30)]
    texts += [texts[0], texts[0].upper(), None, "", " \t\n", "one two", "One\vTWO", "one two three four five", "é Ü x"]
    return texts + ["long " * 50000 + "end", "long " * 50000 + "end"]


def test_near_duplicates_equal_brute_force(spark):
    rows = [(k * 3 + 1, t, "clash") for k, t in enumerate(_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(4)
    sets = {k: _shingles(t) for k, t, _ in rows}
    ids = [k for k in sets if sets[k]]
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    wanted = _roots(sets, linked)
    found = near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == {
        k: (len(s), wanted[k], wanted[k] == k) for k, s in sets.items()
    }
    assert len(found) == len(rows) and len(set(wanted.values())) < len(rows) - 20


def test_rows_that_repeat_or_lack_an_id(spark):
    rows = [(5, "a b c"), (5, "a b c"), (5, "d e f"), (9, "d e f"), (None, "a b c"), (None, None)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in found if r["doc_id"]) == [(5, 5, True)] * 3 + [(9, 5, False)]
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in sorted(found, key=lambda r: -r["n_shingles"]) if r["doc_id"] is None] == [(1, None, False), (0, None, False)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_vectors_equal_brute_force(spark):
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((40, 24))
    made = [c + draw.standard_normal(24) * spread for c in centres for spread in (0.05, 0.2, 0.35, 0.5, 0.9)]
    made += [made[0], made[0] * 2.0, made[7]]
    rows = [(k + 10, [float(x) for x in v], "clash") for k, v in enumerate(made)]
    odd = [(1, None, ""), (2, [], ""), (3, [0.0] * 24, ""), (4, [1.0, None] + [0.0] * 22, ""), (5, [math.nan] + [1.0] * 23, ""),
           (6, [math.inf] * 24, ""), (7, [1.0, 2.0], ""), (None, rows[0][1], ""), (rows[9][0], rows[9][1], ""), (8, [1e200] * 24, "")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, key string")
    units = {k: np.array(v) / np.linalg.norm(v) for k, v, _ in rows}
    linked = [(a, b) for a in units for b in units if a != b and units[a] @ units[b] >= 0.9]
    wanted = _roots(units, linked)
    # Small blocks and cells: the ways for large tables.
    for options in ({}, {"cell": 16, "block": 7}):
        found = near_vectors(table, **options).collect()
        assert len(found) == len(rows) + len(odd)
        named = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
        assert {k: named[k] for k in units} == {k: (sum(a == k for a, _ in linked), wanted[k], wanted[k] == k) for k in units}
        assert all(named[k] == (0, k, True) for k in range(1, 9)) and named[None] == (0, None, False)
    assert near_vectors(table.limit(0)).count() == 0


def test_collisions_are_windows_and_lose_no_pair():
    draw = np.random.default_rng(8)
    units = draw.standard_normal((60, 16))
    units[30:] = units[:30] + draw.standard_normal((30, 16)) * 0.1
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    left, right = units[:25], units[25:]
    basis = np.linalg.qr(np.random.default_rng([42, 16]).standard_normal((16, 16)))[0]
    direct = (np.abs((left @ basis)[:, None] - (right @ basis)[None]) <= 0.2).sum(2)
    assert (vectors.collisions(left, right, 0.2) == direct).all()
    a, b = vectors._linked(left, right, 0.9)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*np.nonzero(left @ right.T >= 0.9), strict=True))


def test_views_follow_the_recall():
    for number in (10, 5_000, 10**9):
        k, views = vectors.plan(number)
        same = (1 - math.acos(0.9) / math.pi) ** k
        assert 1 - (1 - same) ** views >= 0.9999


def test_hot_group_costs_its_size(spark):
    """Thousands of equal vectors are one node."""
    table = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(*(F.lit(float(k)) for k in range(8))).alias("embedding"))
    found = near_vectors(table).agg(F.sum("n_links"), F.max("component_id"), F.count_if("kept")).first()
    assert tuple(found) == (4000 * 3999, 0, 1)
