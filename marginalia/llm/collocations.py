"""Phrases whose words stand together more often than chance, per language.

Texts are split into pieces at punctuation and line ends, pieces into words; a phrase is 1 to
`MOST_WORDS` neighbouring words of a piece. Two passes over the texts:

1. *Which phrases can be frequent?* Phrases are hashed into partitions of about `BUCKET_MASS`
   occurrences. Every task turns its occurrences into summaries, one per hash partition, and the
   summaries of a partition are merged by the rule of Misra and Gries: counters are added, and
   while there are more than the capacity, the largest counter outside it is taken from all. With a
   capacity of `SLACK` times mass / least, no counter loses least / `SLACK`, so every phrase that
   occurs `least` times survives; memory is the capacity, whatever the number of phrases. Hashes
   are cut to 32 bits within a partition: phrases that share one add up, which only lets
   more of them survive.
2. *How often exactly?* Survivors set bits in a bitmap of bounded size (`MOST_BITS`). Occurrences
   of phrases whose bit is set are counted as text. A bit that is set by another phrase costs a
   row, nothing else: phrases are counted in full, and those under `least` go.

Scores, cuts and the test against longer phrases are joins on (language, phrase). Frequent words
never meet in one task: tasks count before they shuffle, in both passes.

Cases: a null language is `und`, a null text has no words; an empty table and one without a
frequent phrase give an empty result; rows that repeat count as often as they stand there; a very
long text is read in windows that overlap by `MOST_WORDS` - 1 words; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marginalia.llm.shared import held, mixed, odd_numbers
from marginalia.llm.words import EXACT, run_hashes
from marginalia.operators.keyed import top_k_per_key

MOST_WORDS = 5
LEAST = 100
BEST = 2000
UNKNOWN = "und"
SLACK = 4
BUCKET_MASS = 1 << 25
MOST_BITS = 28
# Occurrences that a task sorts at once, entries of a summary's row, bytes of a window.
CHUNK = 1 << 22
ROW_ENTRIES = 1 << 16
WINDOW = 1 << 21
SALTS = 64

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_EDGE = _BLANK | _BREAK
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SECOND = odd_numbers(256, 51)
_STEPS = odd_numbers(16, 52)

SUMMARY = "bucket int, kind int, mass long, ones binary, many binary, counts binary"
SURVIVOR = "bucket int, short long, estimate long"
COUNTED = "lang string, k int, phrase string, f long"


def _blocks(batches) -> Iterator[tuple[str, bytes]]:
    """(language, lower-cased texts joined by line ends), of about a window or one long text."""
    for batch in batches:
        texts, langs = batch.column("text"), batch.column("lang").to_pylist()
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(langs, texts, strict=True):
            content = text.as_py()
            if content:
                waiting.setdefault(lang, []).append(content.encode())
                sizes[lang] = sizes.get(lang, 0) + len(waiting[lang][-1])
                if sizes[lang] >= WINDOW:
                    yield lang, b"\n".join(waiting.pop(lang)).translate(_LOWER)
                    del sizes[lang]
        for lang, parts in waiting.items():
            yield lang, b"\n".join(parts).translate(_LOWER)


class Words:
    """Words of a window: hashes, piece numbers, places in the text; the first `old` were seen before."""

    def __init__(self, hashes, pieces, starts, ends, old: int):
        self.hashes, self.pieces, self.starts, self.ends, self.old = hashes, pieces, starts, ends, old

    def grams(self, n: int, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the phrases of n words that end in a new word."""
        begin = max(0, self.old - n + 1)
        size = len(self.hashes) - n + 1 - begin
        if size <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.pieces[begin : begin + size] == self.pieces[begin + n - 1 : begin + n - 1 + size]) + begin
        return first, joined_hashes(self.hashes, first, n, seed)


def joined_hashes(hashes: np.ndarray, first: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    total = np.full(len(first), seed + np.uint64(n), np.uint64)
    for k in range(n):
        total += hashes[first + k] * _STEPS[k]
    return mixed(total)


def _windows(data: bytes, values: np.ndarray = EXACT) -> Iterator[Words]:
    """The words of a text, a window at a time; each window begins with the last words before it."""
    whole = np.frombuffer(data, np.uint8)
    carried = [np.zeros(0, kind) for kind in (np.uint64, np.int64, np.int64, np.int64)]
    begin, pieces_before = 0, 0
    while begin < len(whole):
        end = min(len(whole), begin + WINDOW)
        while end < len(whole) and not (cut := _EDGE[whole[end : end + 4096]]).any():
            end += len(cut)
        end += int(cut.argmax()) if end < len(whole) else 0
        part = whole[begin:end]
        breaks = _BREAK[part]
        inside = ~(_BLANK[part] | breaks)
        edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        at = np.flatnonzero(breaks)
        fresh = [run_hashes(part, starts, ends, values), np.searchsorted(at, starts) + pieces_before, starts + begin, ends + begin]
        both = [np.concatenate(pair) for pair in zip(carried, fresh, strict=True)]
        yield Words(*both, old=len(carried[0]))
        carried = [column[-(MOST_WORDS - 1) :] for column in both]
        begin, pieces_before = end, pieces_before + len(at)


def _seed(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode(), np.uint8)
    return run_hashes(data, np.array([0]), np.array([len(data)]))[0] if len(data) else np.uint64(1)


def _planes(values: np.ndarray) -> bytes:
    """The bytes of 32-bit numbers, lowest bytes of all first: what is small compresses well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _summary_rows(keys: np.ndarray) -> pa.RecordBatch:
    """Exact counts of a chunk of (partition, 32-bit hash) keys, per partition; keys are sorted here."""
    keys.sort()
    new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    values, counts = keys[new], np.diff(np.append(new, len(keys)))
    buckets = (values >> np.uint64(32)).astype(np.int64)
    rows = []
    edges = np.append(np.flatnonzero(np.diff(buckets, prepend=-1)), len(buckets))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        bucket = int(buckets[low])
        rows.append((bucket, 0, int(counts[low:high].sum()), None, None, None))
        for at in range(low, high, ROW_ENTRIES):
            part = slice(at, min(at + ROW_ENTRIES, high))
            short, n = values[part] & np.uint64(0xFFFFFFFF), counts[part]
            once = n == 1
            ones, many = (_planes(np.diff(short[which], prepend=np.uint64(0))) for which in (once, ~once))
            rows.append((bucket, 1, 0, ones, many, _planes(n[~once])))
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = [part.split()[0] for part in SUMMARY.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _keys(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Hash partition and 32 bits of the hash as one number."""
    return (grams >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | grams & np.uint64(0xFFFFFFFF)


def _summaries(batches, buckets: int):
    waiting, size = [], 0
    for lang, data in _blocks(batches):
        seed = _seed(lang)
        for words in _windows(data):
            for n in range(1, MOST_WORDS + 1):
                keys = _keys(words.grams(n, seed)[1], buckets)
                waiting.append(keys)
                size += len(keys)
            if size >= CHUNK:
                yield _summary_rows(np.concatenate(waiting))
                waiting, size = [], 0
    if size:
        yield _summary_rows(np.concatenate(waiting))


class Summary:
    """A Misra-Gries summary of weighted keys: no count is too low by more than `lost`."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts))
        self._size += len(keys)
        if self._size >= max(self.capacity, ROW_ENTRIES):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self._waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self._waiting)])
        self._waiting, self._size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.diff(keys.astype(np.int64), prepend=-1))
        if len(new):
            keys, counts = keys[new], np.add.reduceat(counts, new)
        if len(keys) > self.capacity:
            # The largest counter outside the capacity is taken from all.
            least = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            keys, counts = keys[counts > least], counts[counts > least] - least
            self.lost += least
        self.keys, self.counts = keys, counts


def _survivors(batches, least: int, slack: int):
    """Merges the summaries of each hash partition; rows come sorted by (bucket, kind)."""
    summary, bucket, mass = None, None, 0

    def finished():
        summary.merge()
        keep = summary.counts + summary.lost >= least
        found = summary.keys[keep]
        columns = [pa.array(np.full(len(found), bucket, np.int32)), pa.array(found.astype(np.int64)), pa.array(summary.counts[keep])]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "short", "estimate"])

    for batch in batches:
        for row in zip(*(batch.column(k) for k in range(6)), strict=True):
            if row[0].as_py() != bucket:
                if summary is not None:
                    yield finished()
                summary, bucket, mass = None, row[0].as_py(), 0
            if row[1].as_py() == 0:
                mass += row[2].as_py()
                continue
            if summary is None:
                summary = Summary(slack * (mass // least + 1))
            ones, many, counts = (_from_planes(value.as_buffer()) for value in row[3:])
            keys = [np.cumsum(part, dtype=np.uint32) for part in (ones, many)]
            summary.add(np.concatenate(keys), np.concatenate([np.ones(len(ones), np.int64), counts.astype(np.int64)]))
    if summary is not None:
        yield finished()


def survivors(texts: DataFrame, least: int, buckets: int, slack: int = SLACK) -> DataFrame:
    """(bucket, short, estimate) of every phrase hash that may occur `least` times, and few others."""
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets)
    summaries = texts.mapInArrow(partial(_summaries, buckets=buckets), SUMMARY)
    sorted_rows = summaries.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
    return sorted_rows.mapInArrow(partial(_survivors, least=least, slack=slack), SURVIVOR)


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return mixed(keys.copy()) >> np.uint64(64 - bits)


def bitmap(found: DataFrame, bits: int) -> np.ndarray:
    """The survivors as a bitmap of 2**bits bits, put together by the executors 64 bits at a time."""

    def words(batches):
        for batch in batches:
            bucket, short = (batch.column(c).to_numpy().astype(np.uint64) for c in ("bucket", "short"))
            at = _places(bucket << np.uint64(32) | short, bits)
            bit = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit)], ["word", "bit"])

    table = found.select("bucket", "short").mapInArrow(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    made = np.zeros(1 << bits - 6, np.int64)
    made[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return made.view(np.uint8)


def _counted(batches, buckets: int, bits: int, shared):
    """Counts of the phrases whose bit is set, a window at a time; k = 0 counts all words."""
    marks = shared.value
    for lang, data in _blocks(batches):
        seed, total = _seed(lang), 0
        others = _windows(data, _SECOND)
        for words, second in zip(_windows(data), others, strict=True):
            total += len(words.hashes) - words.old
            sizes, phrases, counts = [], [], []
            for n in range(1, MOST_WORDS + 1):
                first, grams = words.grams(n, seed)
                at = _places(_keys(grams, buckets), bits)
                hit = np.flatnonzero((marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
                first, grams = first[hit], grams[hit]
                # A second hash tells apart phrases that share the first one.
                twin = joined_hashes(second.hashes, first, n, seed)
                order = np.argsort(grams, kind="stable")
                same = np.diff(grams[order]) == 0
                if (same & (np.diff(twin[order]) != 0)).any():
                    order = np.lexsort((twin, grams))
                if not len(order):
                    continue
                new = np.flatnonzero(np.append(True, (np.diff(grams[order]) != 0) | (np.diff(twin[order]) != 0)))
                counts.extend(np.diff(np.append(new, len(order))).tolist())
                starts, ends, leads = words.starts, words.ends, first[order[new]]
                whole = zip(starts[leads].tolist(), ends[leads + n - 1].tolist(), strict=True)
                phrases.extend(b" ".join(data[low:high].split()) if n > 1 else data[low:high] for low, high in whole)
                sizes.extend([n] * len(new))
            yield _rows(lang, sizes, phrases, counts)
        yield _rows(lang, [0], [b""], [total])


def _rows(lang: str, sizes: list[int], phrases: list[bytes], counts: list[int]) -> pa.RecordBatch:
    texts = pa.array(phrases, pa.binary()).cast(pa.string())
    columns = [pa.array([lang] * len(sizes), pa.string()), pa.array(sizes, pa.int32()), texts, pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "k", "phrase", "f"])


def frequent(docs: DataFrame, least: int = LEAST, bucket_mass: int = BUCKET_MASS) -> DataFrame:
    """(lang, k, phrase, f): exact counts of all phrases that occur `least` times, written.

    k is the number of words; the row with k = 0 counts all words of the language.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    texts = texts.filter("text IS NOT NULL")
    # A word is a byte and a blank at least, and begins one phrase of each length at most.
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-(size // 2 + 1) * MOST_WORDS // bucket_mass))
    found = held(survivors(texts, least, buckets))
    bits = min(MOST_BITS, max(12, int(found.count() * 16).bit_length()))
    shared = spark.sparkContext.broadcast(bitmap(found, bits))
    rows = texts.mapInArrow(partial(_counted, buckets=buckets, bits=bits, shared=shared), COUNTED)
    counts = held(rows.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("k") == 0)))
    shared.destroy()
    return counts


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, bucket_mass: int = BUCKET_MASS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of two words and more.

    A phrase is cut where its parts explain it best: the cut with the lowest score counts, the
    first of equal ones. Phrases that a longer one holds and never leaves are dropped.
    """
    counts = frequent(docs, least, bucket_mass)
    totals = counts.filter("k = 0").select("lang", F.col("f").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    phrases = counts.filter("k > 1").withColumn("_words", F.split("phrase", " "))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "k", "_words", salt.alias("_salt")).join(totals, ["lang", "_salt"])
    cuts = cuts.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "a", "n", "cut",
        F.array_join(F.slice("_words", F.lit(1), F.col("cut")), " ").alias("_first"),
        F.array_join(F.slice("_words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("_rest"),
    )
    parts = counts.filter("k > 0")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l")), ["lang", "_first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r")), ["lang", "_rest"])
    cuts = cuts.withColumn("score", _score())
    worst = F.min(F.struct("score", "cut", "l", "r")).alias("_cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(worst)
    # What a longer phrase holds, its two parts that lack one word hold too.
    inner = F.explode(F.array(F.array_join(F.slice("_words", F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice("_words", F.lit(2), F.col("k") - 1), " ")))
    longer = phrases.filter("k > 2").select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_longest"))
    alone = scored.join(longer, ["lang", "phrase"], "left").filter("_longest IS NULL OR _longest < a")
    rows = alone.select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score"))
    ranked = top_k_per_key(rows, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], best, "phrase", SALTS)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _score() -> Column:
    """floor(1000 a n / (l r)), exact: counts have 13 digits at most, so products stay under 38."""
    return F.expr("CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(16, 0)) * CAST(1000 AS DECIMAL(4, 0)) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
