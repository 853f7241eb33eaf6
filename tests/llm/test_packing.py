"""Packing: ids, solution and places."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "it's A TEST's don't 12ab3 x y a\x1cb éle ÉÀ İstanbul ΣΑΣ <|endoftext|> … — 😀 ..a.. ''s 'S tHe'Re é,. \tq\rz", "", "   ",
    "e\u0301 \u0301x ª² Ⅷ a\u00a0b \u2028c", "ﬁ ｆｕｌｌ Ǆ ß", "no|pipes***%%% ok!! (x)",
]


def _whole(texts):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ids_by_word_are_those_of_the_whole_text(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = ODD + [r["text"] for r in docs.collect()]
    encoder = packing.WordEncoder(PATH)
    assert encoder.by_word and encoder.encode(texts) == _whole(texts)
    for name in ("REMEMBERED_RUNS", "REMEMBERED_WORDS"):
        monkeypatch.setattr(packing, name, 20)
    assert [encoder.encode([t])[0] for t in texts] == _whole(texts)


@pytest.mark.parametrize(("capacity", "most"), [(50, 50), (64, 20), (7, 7), (10, 1)])
def test_solutions_hold_every_piece_and_are_near_the_bound(capacity, most):
    draw = random.Random(capacity)
    histogram = {n: draw.randrange(1, 400) for n in range(1, most + 1)}
    solution = packing.solve(histogram, capacity)
    held = Counter()
    for config, many in solution:
        assert many > 0 and sum(n * c for n, c in config) <= capacity
        for n, c in config:
            held[n] += c * many
    # Large pieces need a sequence each; what of the small ones does not fit beside them needs more.
    bound = 0
    for low in range(capacity // 2 + 1):
        large = {n: c for n, c in histogram.items() if 2 * n > capacity}
        small = sum(n * c for n, c in histogram.items() if low <= n and 2 * n <= capacity)
        beside = sum((capacity - n) * c for n, c in large.items() if n <= capacity - low)
        bound = max(bound, sum(large.values()) + max(0, -(-(small - beside) // capacity)))
    assert held == histogram and sum(m for _, m in solution) <= bound * 1.005 + 1
    assert packing.solve({}, capacity) == []


@pytest.mark.parametrize("step", [1.0, 0.5, 0.1])
def test_fractional_cover_covers(step):
    histogram = {3: 40, 5: 60, 9: 10}
    found = packing.cover(histogram, 12, step)
    for n, wanted in histogram.items():
        assert sum(x * dict(config).get(n, 0) for config, x in found.items()) == pytest.approx(wanted)
    # Sequences of the best fractional solution: 9+3 (10), 5+5 (25 or so), 5+3+3, 3+3+3+3.
    assert sum(found.values()) <= 1.1 * (3 * 40 + 5 * 60 + 9 * 10) / 12 + 5


def test_knapsack_equals_brute_force():
    lengths, prices = np.array([2, 3, 5]), np.array([0.3, 0.5, 0.9])
    best, used = packing._knapsack(lengths, prices, 11)
    for room in range(12):
        brute = max(a * 0.3 + b * 0.5 + c * 0.9 for a in range(6) for b in range(4) for c in range(3) if 2 * a + 3 * b + 5 * c <= room)
        assert best[room] == pytest.approx(brute)
    config = packing._configuration(1, lengths, used, 11)
    assert sum(prices[k] * c for k, c in config.items()) == pytest.approx(0.5 + best[8])


def test_the_program_packs_the_documents(spark):
    """On the lengths of the largest table: all covered, most sequences from configurations, few in all."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    found = packing.pieces(docs, PATH).groupBy("length").count().collect()
    histogram = {r["length"]: r["count"] for r in found}
    short = {n: c for n, c in histogram.items() if n < packing.CAPACITY}
    fractional = packing.cover(short, packing.CAPACITY)
    held = Counter()
    for config, share in fractional.items():
        for n, c in config:
            held[n] += c * share
    assert all(held[n] >= c * (1 - 1e-6) for n, c in short.items())
    tokens = sum(n * c for n, c in short.items())
    assert sum(fractional.values()) <= 1.001 * tokens / packing.CAPACITY
    whole, left = packing.programmed(histogram)
    sequences = sum(many for _, many in packing.solve(histogram))
    assert sum(whole.values()) >= 0.9 * sequences
    bound = -(-sum(n * c for n, c in histogram.items()) // packing.CAPACITY)
    assert sequences <= bound + 1


@pytest.mark.parametrize("capacity", [2048, 16])
def test_packed_pieces_are_the_documents(spark, capacity):
    texts = [*ODD, None, "long text of words " * 3000, "dup", "dup"]
    rows = [(None if k == 2 else k if k < len(texts) - 1 else k - 1, t, "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    found = packing.pack(docs, PATH, capacity=capacity).collect()
    ids = [np.frombuffer(x + bytes(4), "<u4") for x in _whole([t or "" for t in texts])]
    wanted = Counter()
    for (doc_id, _, _), own in zip(rows, ids, strict=True):
        for k, first in enumerate(range(0, len(own), capacity)):
            part = own[first : first + capacity]
            wanted[doc_id, k, first, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= -(-sum(map(len, ids)) // capacity) * 1.1 + 2
    assert packing.pack(docs.limit(0), PATH).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packing.pack(docs.filter(F.lit(False)), PATH).count() == 0
