"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded texts.

Folding lower-cases, replaces letters of other scripts and forms that look alike and digits
written for letters, and puts one space around every word; accents stay, they tell words apart. Entries are whole words or beginnings of words. Their
weights are log odds between the labels over a bounded sample, kept only where the odds are
beyond chance for the number of candidates. A word counts by its heaviest entry; a hit inside
an exception phrase (an entry with its neighbour word that is found in harmless texts) does
not count. The sum, also per words of the text, passes a logistic curve fitted on the sample.

Cases: null, empty and word-less texts have no hits and get the score of a text without hits;
without labels to learn from every score is 0; conflicting labels of a document count as the
larger; repeated rows are scored each; long texts are folded in slices cut at spaces; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marginalia.llm.samples import slices, with_labels
from marginalia.llm.shared import held, share

# Bound of the labelled rows to learn from, and of the lexicon.
LEARNING_ROWS = 12_000
MOST_ENTRIES = 3_000
MOST_EXCEPTIONS = 3_000
LEAST_DOCS = 4
PREFIXES = range(3, 9)
SCORED = "doc_id long, held_out boolean, score double, predicted int"

# Letters of other scripts that look like a Latin one, and signs written for letters.
LOOKALIKES = dict(zip("авеёкмнорстухіјѕԁһԛԝαβεικνορτυχ", "abeekmhopctyxijsdhqwabeikvoptux", strict=True))
DIGITS = dict(zip("013457@$", "oieastas", strict=True))

_WORD = re.compile(r"[^\W_](?:[\w@$]*[^\W_])?")
_DIGIT = re.compile(r"[013457@$]")
_MIXED = str.maketrans(DIGITS)


class _Fold(dict):
    """Letter to folded letter, filled on demand."""

    def __missing__(self, code: int) -> str:
        base = unicodedata.normalize("NFKC", chr(code)).lower()
        base = "".join(LOOKALIKES.get(c, c) for c in base)
        self[code] = base
        return base


_FOLD = _Fold()


def words(text: str) -> list[str]:
    """Folded words. Digits stand for letters only in words that have letters."""
    plain = text.lower().translate(_FOLD)
    found = _WORD.findall(plain)
    if _DIGIT.search(plain):
        found = [w.translate(_MIXED) if not w.isalpha() and any(map(str.isalpha, w)) else w for w in found]
    return found


def _candidates(found: list[str]) -> set[str]:
    """A leading space marks the beginning of a word, a trailing one its end."""
    kinds = set(found)
    return {f" {w[:n]}" for n in PREFIXES for w in kinds if len(w) > n} | {f" {w} " for w in kinds if len(w) > 1}


def _rows(counts: Counter):
    items = sorted(counts.items())
    columns = [pa.array([k[0] for k, _ in items], pa.string()), pa.array([k[1] for k, _ in items], pa.int32()), pa.array([n for _, n in items], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["entry", "label", "n"])


def _count(batches):
    for batch in batches:
        counts: Counter = Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            entries: set[str] = set()
            for part in slices(text):
                entries |= _candidates(words(part))
            counts.update((e, label) for e in entries)
        yield _rows(counts)


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: frozenset[str] = frozenset(), curve=(0.0, 0.0, 0.0, -40.0)) -> None:
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self._found = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state) -> None:
        self.weights, self.exceptions, self.curve = state
        self._found = None

    def automaton(self):
        if self._found is None:
            self._found = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._found.add_word(entry, (len(entry), weight))
            self._found.make_automaton()
        return self._found

    def hits(self, text: str) -> tuple[list[tuple[str, float, str, str]], int]:
        """(word, weight, phrase with the word before, phrase with the word after), number of words."""
        found, number = [], 0
        for part in slices(text):
            own = words(part)
            number += len(own)
            if not self.weights or not own:
                continue
            line = f" {' '.join(own)} "
            best: dict[int, float] = {}
            for end, (size, weight) in self.automaton().iter(line):
                begin = end - size + 1
                best[begin] = max(best.get(begin, 0.0), weight)
            for begin, weight in best.items():
                end = line.index(" ", begin + 1)
                word = line[begin + 1 : end]
                before = line[line.rfind(" ", 0, begin) + 1 : begin] if begin else ""
                after = line[end + 1 : line.find(" ", end + 1)] if end + 1 < len(line) else ""
                found.append((word, weight, f"{before} {word}", f"{word} {after}"))
        return found, number

    def features(self, text: str | None) -> tuple[float, float, float]:
        found, number = self.hits(text or "")
        total = sum(w for _, w, before, after in found if before not in self.exceptions and after not in self.exceptions)
        return math.log1p(total), math.sqrt(total / max(1, number)), float(total > 0)

    def score(self, text: str | None) -> float:
        *weights, bias = self.curve
        z = sum(w * x for w, x in zip(weights, self.features(text), strict=True)) + bias
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit_curve(features: np.ndarray, labels: np.ndarray, ridge: float = 0.01, turns: int = 30) -> tuple[float, ...]:
    """Logistic regression by Newton steps, bias last."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (p - labels) / len(x) + ridge * w * np.r_[np.ones(len(w) - 1), 0] / 10
        bend = (x.T * (p * (1 - p))) @ x / len(x) + ridge * np.eye(len(w)) / 10
        w -= np.linalg.solve(bend, slope)
    return tuple(map(float, w))


def _odds(table: DataFrame, totals: dict[int, int], most: int, least: int, toxic: bool) -> dict[str, float]:
    """Entries whose share of one label is beyond chance, with their log odds."""
    a, b = max(1, totals.get(1, 0)), max(1, totals.get(0, 0))
    if not toxic:
        a, b = b, a
    wide = table.groupBy("entry").agg(
        F.sum(F.when(F.col("label") == int(toxic), F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("label") != int(toxic), F.col("n")).otherwise(0)).alias("b"),
    )
    wide = held(wide.filter(F.col("a") + F.col("b") >= least))
    tried = wide.count()
    base = a / (a + b)
    rate = F.col("a") / (F.col("a") + F.col("b"))
    gain = F.col("a") * F.log(rate / base) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - rate) / (1 - base))).otherwise(0)
    odds = F.log((F.col("a") + 0.5) / (a + 1)) - F.log((F.col("b") + 0.5) / (b + 1))
    good = wide.filter(F.col("a") >= least).withColumn("gain", gain).withColumn("odds", odds)
    good = good.filter((F.col("gain") >= math.log(max(2, tried)) + 2) & (F.col("odds") >= 1.5))
    return {r["entry"]: r["odds"] for r in good.orderBy(F.desc("gain"), "entry").limit(most).collect()}


def _shortest(weights: dict[str, float]) -> dict[str, float]:
    """Without entries whose own beginning is an entry of about the same weight."""
    kept: dict[str, float] = {}
    for entry, weight in sorted(weights.items(), key=lambda x: len(x[0])):
        if not any(kept.get(entry[:n], -9) >= weight - 1.5 for n in range(2, len(entry))):
            kept[entry] = weight
    return kept


def learn(sample: DataFrame, most: int = MOST_ENTRIES, exceptions: int = MOST_EXCEPTIONS) -> Lexicon:
    """A lexicon from a bounded sample (text, label)."""
    sample = held(sample)
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(totals) < 2:
        return Lexicon({})
    counts = sample.mapInArrow(_count, "entry string, label int, n long").groupBy("entry", "label").agg(F.sum("n").alias("n"))
    lexicon = Lexicon(_shortest(_odds(counts, totals, most, LEAST_DOCS, True)))
    context = sample.sparkSession.sparkContext

    def phrases(batches, known):
        for batch in batches:
            found: Counter = Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                near = {p for hit in known.value.hits(text)[0] for p in hit[2:] if p.strip() != hit[0]}
                found.update((p, label) for p in near)
            yield _rows(found)

    def measured(batches, known):
        for batch in batches:
            rows = np.array([known.value.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            columns = [*(pa.array(rows[:, k]) for k in range(3)), batch.column("label")]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "c", "label"])

    first = context.broadcast(lexicon)
    near = sample.mapInArrow(lambda it: phrases(it, first), "entry string, label int, n long")
    near = near.groupBy("entry", "label").agg(F.sum("n").alias("n"))
    lexicon = Lexicon(lexicon.weights, frozenset(_odds(near, totals, exceptions, LEAST_DOCS, False)))
    second = context.broadcast(lexicon)
    table = sample.mapInArrow(lambda it: measured(it, second), "a double, b double, c double, label int").toPandas().to_numpy(float)
    # The sample holds as many of each label as there are; rows are weighed by nothing else.
    return Lexicon(lexicon.weights, lexicon.exceptions, fit_curve(table[:, :3], table[:, 3]))


def score(docs: DataFrame, labels: DataFrame, parts: int = 5, residue: int = 0, rows: int = LEARNING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text).

    `labels` (doc_id, toxic) teach, outside the held-out part only.
    """
    held_out = share("held_out", F.col("doc_id"), parts, residue)
    lexicon = docs.sparkSession.sparkContext.broadcast(learn(with_labels(docs, labels, "toxic", held_out, rows)))

    def scored(batches):
        known = lexicon.value
        for batch in batches:
            values = np.array([known.score(t) for t in batch.column("text").to_pylist()], float)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(values), pa.array((values >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out)
    return texts.mapInArrow(scored, SCORED)
