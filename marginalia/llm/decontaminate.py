"""Passages of benchmark items in training documents: rare seeds, then alignment.

1. A seed is `SEED_WORDS` words in order, with up to `SLACK_WORDS` more between them. One pass
   over all documents counts in how many of them each seed of an item occurs. Documents are
   read through a bitmap of seed hashes of fixed size, so what is sent to the tasks does not
   grow with the benchmark; the join afterwards is exact.
2. An alignment of `min_score` has a bounded number of edits, so it keeps a known number of
   seeds (`surviving`). Of those that occur at all an item leaves out the most frequent, fewer
   than half that number; so every leak still holds the other half, wherever its edits are.
   Items too short for this (under 5 words by default) have their single words as seeds.
3. A second pass cuts passages around places with so many seeds, as long as an alignment can
   be; they join the items on the seeds, and pairs with too few in common go.
4. Pairs whose common words cannot reach the score go; Smith-Waterman over words (match +1,
   mismatch and gap below) gives every other pair of passage and item its best local
   alignment, start and end included, many pairs at a time.

No step loses a pair that reaches `min_score`.
score: alignment score over the item's words. The best passage of each pair with a score of
`min_score` or more is returned.

Cases: null or word-less texts and items match nothing; null ids are values like others; rows
that repeat a doc_id or item_id count together, the best alignment wins; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from marginalia.llm.shared import held
from marginalia.llm.words import word_hashes, words_hash

SEED_WORDS = 3
# Words that may lie between those of a seed.
SLACK_WORDS = 2
MIN_SCORE = 0.5
MISMATCH = -0.6
GAP = -0.6
# Bits of the bitmap that seeds are looked up in before the exact join (2 MB).
BITMAP_BITS = 24
_SLICE = 512
_PAIRS = 256


def patterns(n: int, slack: int = SLACK_WORDS) -> list[tuple[int, ...]]:
    """Places of the n words of a seed, all in order within n + slack words."""
    return [(0, *rest) for rest in combinations(range(1, n + slack), n - 1)]


def _seeds(hashes: np.ndarray, bounds: np.ndarray, shapes: list[tuple[int, ...]]):
    """(first word, hash) of every seed inside a row, one pair of arrays per shape."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    for shape in shapes:
        size = max(0, len(hashes) - shape[-1])
        whole = np.flatnonzero(np.arange(size) + shape[-1] < ends[:size])
        yield whole, words_hash([hashes[whole + k] for k in shape])


def surviving(m: int, n: int, min_score: float, cost: float, slack: int = SLACK_WORDS) -> int:
    """How many seeds at least an alignment of min_score keeps of an item of m words.

    With k matched words edits cost k - min_score * m at most. A run of n matched words in
    order is no seed only if edits between them fill more than `slack` words; every edit
    lies in n - 1 runs at most.
    """
    least = (min_score - 1e-5) * m
    k = np.arange(max(1, int(np.ceil(least))), m + 1)
    if n == 1:
        return int(k[0]) if len(k) else 1
    if cost <= 0 or not len(k):
        return 0
    broken = np.floor((n - 1) * (k - least) / (cost * (slack + 1)) + 1e-9)
    return int((k - n + 1 - broken).min())


def _items(batches, n: int, min_score: float, cost: float):
    """Words, seeds (with repeats) and the number of seeds that a leak keeps, of every item."""
    for batch in batches:
        hashes, bounds, _ = word_hashes(batch.column("text"))
        words, grams, keeps, short = [], [], [], []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = hashes[low:high]
            kept = surviving(len(own), n, min_score, cost)
            # Of a short item a leak may keep single words only.
            shapes = patterns(n) if kept > 0 else [(0,)]
            short.append(kept <= 0)
            keeps.append(kept if kept > 0 else surviving(len(own), 1, min_score, cost))
            words.append(own.view(np.int64))
            grams.append(np.concatenate([g for _, g in _seeds(own, np.array([0, len(own)]), shapes)]).view(np.int64))
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (words, grams)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), *lists, pa.array(keeps, pa.int32()), pa.array(short, pa.bool_())], ["item_id", "words", "grams", "keeps", "short"])


def _in_bitmap(grams: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    slot = (grams >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _hits(column: pa.Array, shapes: list[tuple[int, ...]], bitmap: np.ndarray, bits: int):
    """(first word, hash) of the seeds in the bitmap, the words, row bounds."""
    hashes, bounds, _ = word_hashes(column)
    places, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at, found in _seeds(hashes, bounds, shapes):
        hit = np.flatnonzero(_in_bitmap(found, bitmap, bits))
        places.append(at[hit])
        grams.append(found[hit])
    return np.concatenate(places), np.concatenate(grams), hashes, bounds


def _count(batches, shapes: list[tuple[int, ...]], bitmap: np.ndarray, bits: int):
    """(gram, number of rows of the batch that hold it)"""
    for batch in batches:
        total: list[np.ndarray] = []
        for at in range(0, batch.num_rows, _SLICE):
            places, grams, _, bounds = _hits(batch.column("text").slice(at, _SLICE), shapes, bitmap, bits)
            row = np.searchsorted(bounds, places, "right")
            order = np.lexsort((grams, row))
            row, grams = row[order], grams[order]
            new = np.ones(len(row), bool)
            new[1:] = (np.diff(row) > 0) | (grams[1:] != grams[:-1])
            total.append(grams[new])
        values, counts = np.unique(np.concatenate(total) if total else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["gram", "n"])


def _dense(places: np.ndarray, rows: np.ndarray, least: int, span: int) -> np.ndarray:
    """Is a seed among `least` first words of seeds of its row that lie within `span` words?"""
    starts, which = np.unique(places, return_inverse=True)
    row = rows[np.searchsorted(places, starts)]
    keep = np.zeros(len(starts) + 1, np.int64)
    last = np.arange(least - 1, len(starts))
    first = last - least + 1
    near = (starts[last] - starts[first] < span) & (row[last] == row[first])
    np.add.at(keep, first[near], 1)
    np.add.at(keep, last[near] + 1, -1)
    return (np.cumsum(keep)[:-1] > 0)[which]


def _passages(batches, shapes: list[tuple[int, ...]], bitmap: np.ndarray, bits: int, span: int, least: int):
    """Passages of `span` words to both sides of dense seeds, merged where they touch."""
    reach = span + max(shape[-1] for shape in shapes)
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            places, grams, hashes, bounds = _hits(part.column("text"), shapes, bitmap, bits)
            order = np.argsort(places, kind="stable")
            places, grams = places[order], grams[order]
            rows = np.searchsorted(bounds, places, "right") - 1
            dense = _dense(places, rows, least, span)
            places, grams, rows = places[dense], grams[dense], rows[dense]
            ids = part.column("doc_id").to_pylist()
            out = []
            if len(places):
                new = np.flatnonzero((np.diff(rows) > 0) | (np.diff(places) > 2 * reach)) + 1
                for low, high in zip([0, *new.tolist()], [*new.tolist(), len(places)], strict=True):
                    row = int(rows[low])
                    begin = max(int(bounds[row]), int(places[low]) - reach)
                    end = min(int(bounds[row + 1]), int(places[high - 1]) + reach)
                    seeds = np.unique(grams[low:high]).view(np.int64)
                    out.append((ids[row], begin - int(bounds[row]), hashes[begin:end].view(np.int64), seeds))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "begin", "words", "seeds"])


def align(items: list[np.ndarray], passages: list[np.ndarray], mismatch: float = MISMATCH, gap: float = GAP):
    """Best local alignment of every (item, passage): score, first and past-the-last passage word.

    All pairs advance together along the anti-diagonals of their tables.
    """
    pairs = len(items)
    m, size = max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((pairs, m), np.int64), np.zeros((pairs, size + 2 * m), np.int64)
    has_a, has_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for k, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[k, : len(x)], has_a[k, : len(x)] = x, True
        b[k, m : m + len(y)], has_b[k, m : m + len(y)] = y, True
    # At step d, cell i of the item meets passage word d - i.
    last, before = np.zeros((pairs, m + 1), np.float32), np.zeros((pairs, m + 1), np.float32)
    from_last, from_before = np.zeros((pairs, m + 1), np.int32), np.zeros((pairs, m + 1), np.int32)
    best, start, end = np.zeros(pairs, np.float32), np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    cells, every = np.arange(m), np.arange(pairs)
    for d in range(size + m - 1):
        at = slice(d + 1, d + 1 + m)
        facing, real = b[:, at][:, ::-1], has_b[:, at][:, ::-1] & has_a
        diagonal = before[:, :-1] + np.where(a == facing, np.float32(1), np.float32(mismatch))
        begun = np.where(before[:, :-1] > 0, from_before[:, :-1], d - cells)
        up, left = last[:, :-1] + np.float32(gap), last[:, 1:] + np.float32(gap)
        score, origin = diagonal, begun
        better = up > score
        score, origin = np.where(better, up, score), np.where(better, from_last[:, :-1], origin)
        better = left > score
        score, origin = np.where(better, left, score), np.where(better, from_last[:, 1:], origin)
        score = np.where(real & (score > 0), score, np.float32(0))
        top = score.argmax(1)
        value = score[every, top]
        up_now = value > best
        best[up_now], start[up_now], end[up_now] = value[up_now], origin[every, top][up_now], (d - top + 1)[up_now]
        before, from_before = last, from_last
        last, from_last = np.zeros_like(last), np.zeros_like(from_last)
        last[:, 1:], from_last[:, 1:] = score, origin
    return best, start, end


def _most(gains: np.ndarray) -> float:
    """Largest sum of neighbouring gains."""
    sums = np.concatenate([[0], np.cumsum(gains)])
    return float((sums - np.minimum.accumulate(sums)).max())


def _may_reach(item: np.ndarray, words: np.ndarray, least: float, cost: float) -> bool:
    """No alignment scores more than words of either side do that the other side has somewhere, less edits."""
    return all(_most(np.where(np.isin(x, y), 1.0, -cost)) >= least for x, y in ((item, words), (words, item)))


def _score(batches, mismatch: float, gap: float, min_score: float):
    cost = max(0.0, min(-mismatch, -gap))
    for batch in batches:
        for at in range(0, batch.num_rows, _PAIRS):
            part = batch.slice(at, _PAIRS)
            items = [np.asarray(x, np.int64) for x in part.column("item_words").to_pylist()]
            texts = [np.asarray(x, np.int64) for x in part.column("words").to_pylist()]
            near = [k for k, (x, y) in enumerate(zip(items, texts, strict=True)) if _may_reach(x, y, (min_score - 1e-5) * len(x), cost)]
            part, items, texts = part.take(pa.array(near, pa.int64())), [items[k] for k in near], [texts[k] for k in near]
            # Pairs of like length share a table.
            order = np.argsort([len(x) for x in texts], kind="stable")
            found = np.zeros((3, len(order)))
            for few in np.array_split(order, max(1, len(order) // 64)):
                if len(few):
                    found[:, few] = align([items[i] for i in few], [texts[i] for i in few], mismatch, gap)
            begin = part.column("begin").to_numpy()
            sizes = np.array([len(x) for x in items])
            values = [np.round(found[0] / sizes, 6), begin + found[1].astype(int), begin + found[2].astype(int)]
            columns = [part.column("doc_id"), part.column("item_id"), *map(pa.array, values)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "first_word", "end_word"])


def _bitmap(grams: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits of the hashes; at most that many distinct numbers reach the driver."""
    slots = grams.select(F.shiftrightunsigned("gram", 64 - bits).alias("slot")).distinct().toArrow()["slot"].to_numpy()
    found = np.zeros(1 << (bits - 3), np.uint8)
    np.bitwise_or.at(found, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    return found


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    seed_words: int = SEED_WORDS,
    min_score: float = MIN_SCORE,
    mismatch: float = MISMATCH,
    gap: float = GAP,
    bits: int = BITMAP_BITS,
) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word (in words of the document) of every leak."""
    spark = docs.sparkSession
    cost = max(0.0, min(-mismatch, -gap))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = given.mapInArrow(
        partial(_items, n=seed_words, min_score=min_score, cost=cost),
        "item_id long, words array<long>, grams array<long>, keeps int, short boolean",
    )
    items = held(items.filter(F.size("words") > 0).withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"]))
    longest, short = items.agg(F.max(F.size("words")), F.max("short")).first()
    shapes = patterns(seed_words) + ([(0,)] if short and seed_words > 1 else [])
    grams = items.select("item", "keeps", F.explode("grams").alias("gram"))
    grams = held(grams.groupBy("item", "keeps", "gram").agg(F.count("*").alias("weight")))
    share = spark.sparkContext.broadcast
    bitmap = share(_bitmap(grams, bits))
    counts = texts.select("text").mapInArrow(lambda it: _count(it, shapes, bitmap.value, bits), "gram long, n long")
    counts = counts.groupBy("gram").agg(F.sum("n").alias("n"))
    # From the most frequent on, fewer seeds are left out than half of those that every leak keeps.
    common = Window.partitionBy("item").orderBy(F.desc("n"), "gram").rowsBetween(Window.unboundedPreceding, 0)
    ranked = grams.join(counts, "gram").withColumn("_sum", F.sum("weight").over(common))
    out = F.col("_sum") <= F.floor((F.col("keeps") - 1) / 2)
    lost = F.coalesce(F.max(F.when(out, F.col("_sum"))).over(Window.partitionBy("item")), F.lit(0))
    ranked = ranked.withColumn("need", F.col("keeps") - lost)
    seeds = held(ranked.filter(~out).select("item", "gram", "weight", "need"))
    rare = share(_bitmap(seeds, bits))
    least = int(seeds.agg(F.min("need")).first()[0] or 1)
    # Most words of a document that an alignment can take.
    span = int((longest or 0) * (1 + max(0.0, 1 - min_score + 1e-5) / cost)) + 1 if cost else 1 << 40
    found = texts.mapInArrow(
        lambda it: _passages(it, shapes, rare.value, bits, span, least),
        "doc_id long, begin long, words array<long>, seeds array<long>",
    )
    found = held(found.withColumn("_passage", F.xxhash64("doc_id", "begin", "words")))
    touched = found.select("_passage", F.explode("seeds").alias("gram")).join(seeds, "gram")
    touched = touched.groupBy("_passage", "item").agg(F.sum("weight").alias("_sum"), F.max("need").alias("need"))
    touched = touched.filter("_sum >= need").select("_passage", "item")
    pairs = touched.join(found.select("_passage", "doc_id", "begin", "words"), "_passage")
    pairs = pairs.join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
    pairs = pairs.select("doc_id", "item_id", "begin", "words", "item_words")
    kind = "doc_id long, item_id long, score double, first_word long, end_word long"
    scored = pairs.mapInArrow(lambda it: _score(it, mismatch, gap, min_score), kind).filter(F.col("score") >= min_score)
    best = F.max(F.struct("score", (-F.col("first_word")).alias("f"), "end_word")).alias("_b")
    return scored.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("_b.score").alias("score"), (-F.col("_b.f")).alias("first_word"), F.col("_b.end_word").alias("end_word")
    )
