"""Language of texts: known words first, character n-grams for the rest.

Words and the n-grams of `ORDERS` characters (with word borders) are counted per language over
a bounded sample of labelled rows; the most frequent become log frequencies per language. A
known word scores by its own; an unseen one by the longest order of which it has known
n-grams. A text scores by the mean over all its words, whole texts always.

score: probability of the chosen language, with evidence of at most `EVIDENCE` words.

Cases: null texts and texts without a letter are `und` with score 0, as are all texts if there
is nothing to learn from; texts of unknown words only still get a language, with a low score;
ties go to the alphabetically first language; repeated rows are judged each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marginalia.llm.samples import drawn, slices
from marginalia.llm.shared import share

# Bound of the labelled rows to learn from, and of the words and n-grams in the model.
LEARNING_ROWS = 3_000
MOST_WORDS = 60_000
MOST_NGRAMS = 60_000
LEAST_COUNT = 3
ORDERS = (4, 3, 2, 1)
EVIDENCE = 20
REMEMBERED = 500_000
UNKNOWN = "und"
JUDGED = "doc_id long, held_out boolean, lang_pred string, score double"
_RUNS = re.compile(r"[^\W\d_]+")


def _ngrams(word: str, order: int) -> list[str]:
    edged = f"_{word}_" if order > 1 else word
    return [edged[i : i + order] for i in range(len(edged) - order + 1)]


def _count(batches):
    """(order, gram, lang, n); order 0 are words. One row per batch and gram."""
    for batch in batches:
        words: dict[str, Counter] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            own = words.setdefault(lang, Counter())
            for part in slices(text):
                own.update(_RUNS.findall(part.lower()))
        for lang, own in words.items():
            for order in (0, *ORDERS):
                counts = own
                if order:
                    counts = Counter()
                    for word, n in own.items():
                        for gram in _ngrams(word, order):
                            counts[gram] += n
                size = len(counts)
                columns = [pa.array([order] * size, pa.int32()), pa.array(list(counts), pa.string()), pa.array([lang] * size, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], ["order", "gram", "lang", "n"])


class Model:
    """Log frequencies per language, a row per word or n-gram; languages in alphabetical order."""

    def __init__(self, langs: list[str], words: list[str], word_rates: np.ndarray, ngrams: list[str], ngram_rates: np.ndarray) -> None:
        self.langs, self.words, self.word_rates = langs, words, word_rates
        self.ngrams, self.ngram_rates = ngrams, ngram_rates

    # Looked up by tasks only: the driver keeps the bare lists.
    @cached_property
    def word_places(self) -> dict[str, int]:
        return {word: k for k, word in enumerate(self.words)}

    @cached_property
    def ngram_places(self) -> dict[str, int]:
        return {gram: k for k, gram in enumerate(self.ngrams)}

    def vectors(self, words: list[str]) -> np.ndarray:
        """A row per word: its own, else the mean of its longest known n-grams, else nothing."""
        places, found, rows, sizes = self.ngram_places, np.zeros((len(words), len(self.langs)), np.float32), [], []
        flat: list[int] = []
        for k, word in enumerate(words):
            own = self.word_places.get(word)
            if own is not None:
                found[k] = self.word_rates[own]
                continue
            for order in ORDERS:
                known = [places[g] for g in _ngrams(word, order) if g in places]
                if known:
                    flat += known
                    rows.append(k)
                    sizes.append(len(known))
                    break
        if rows:
            starts = np.cumsum([0, *sizes[:-1]])
            found[rows] = np.add.reduceat(self.ngram_rates[flat], starts) / np.array(sizes)[:, None]
        return found


def learn(
    docs: DataFrame,
    held_out: Column,
    rows: int = LEARNING_ROWS,
    most_words: int = MOST_WORDS,
    most_ngrams: int = MOST_NGRAMS,
    least_count: int = LEAST_COUNT,
) -> Model:
    """A model from text and lang of the rows outside the held-out part."""
    known = docs.filter(~held_out).select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    # A language may hold most rows of one source: rows are drawn per language by their text,
    # and copies of a text count as one.
    few = drawn(known.select("text", "lang"), "lang", F.col("text"), rows, repeats=True)
    counts = few.mapInArrow(_count, "order int, gram string, lang string, n long")
    counts = counts.groupBy("order", "gram", "lang").agg(F.sum("n").alias("n"))
    totals = {(r["order"], r["lang"]): r["n"] for r in counts.groupBy("order", "lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for _, lang in totals})
    by = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
    each = F.transform(F.array(*map(F.lit, langs)), lambda lang: F.coalesce(by[lang], F.lit(0))) if langs else F.array()
    grams = counts.groupBy("order", "gram").agg(F.sum("n").alias("all"), each.cast("array<long>").alias("by"))
    grams = grams.filter(F.col("all") >= least_count)
    size = {order: len({lang for o, lang in totals if o == order}) for order in (0, *ORDERS)}
    kinds = (0, *ORDERS)
    share_of = np.array([[totals.get((order, x), 0) + 0.5 * max(1, size[order]) * 1000 for x in langs] for order in kinds])

    def table(which: str, most: int) -> tuple[list[str], np.ndarray]:
        found = grams.filter(which).orderBy(F.desc("all"), "gram").limit(most).select("order", "gram", "by").toArrow().combine_chunks()
        numbers = np.concatenate([np.zeros(0), *(c.flatten().to_numpy() for c in found["by"].chunks)]).reshape(len(found), len(langs))
        orders = np.array([kinds.index(o) for o in found["order"].to_pylist()], np.int64)
        rates = np.log((numbers + 0.5) / share_of[orders]).astype(np.float32) if len(found) else np.zeros((0, len(langs)), np.float32)
        # Only differences between languages count.
        return found["gram"].to_pylist(), rates - rates.max(axis=1, keepdims=True) if len(found) else rates

    return Model(langs, *table("order = 0", most_words), *table("order > 0", most_ngrams))


def _judge(batches, model: Model, evidence: int = EVIDENCE):
    ids: dict[str, int] = {}
    table = np.zeros((1024, len(model.langs)), np.float32)
    for batch in batches:
        preds, scores = [], []
        for text in batch.column("text").to_pylist():
            total, number, letters = np.zeros(len(model.langs)), 0, False
            for part in slices(text or ""):
                words = _RUNS.findall(part.lower())
                letters = letters or any(any(map(str.isalpha, w)) for w in words)
                if len(ids) > REMEMBERED:
                    ids.clear()
                new = list(set(words).difference(ids))
                while len(ids) + len(new) > len(table):
                    table = np.concatenate([table, np.zeros_like(table)])
                table[len(ids) : len(ids) + len(new)] = model.vectors(new)
                ids.update(zip(new, range(len(ids), len(ids) + len(new)), strict=True))
                if words:
                    total += table[np.fromiter(map(ids.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=float)
                    number += len(words)
            if not letters or not model.langs:
                preds.append(UNKNOWN)
                scores.append(0.0)
                continue
            odds = total / number * min(number, evidence)
            odds = np.exp(odds - odds.max())
            best = int(odds.argmax())
            preds.append(model.langs[best])
            scores.append(float(odds[best] / odds.sum()))
        columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])


def identify(
    docs: DataFrame,
    parts: int = 4,
    residue: int = 2,
    rows: int = LEARNING_ROWS,
    most_words: int = MOST_WORDS,
    most_ngrams: int = MOST_NGRAMS,
    least_count: int = LEAST_COUNT,
    evidence: int = EVIDENCE,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs` (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    held_out = share("held_out", F.col("doc_id"), parts, residue)
    learned = learn(docs, held_out, rows, most_words, most_ngrams, least_count)
    model = docs.sparkSession.sparkContext.broadcast(learned)
    return docs.select("doc_id", "text", held_out).mapInArrow(lambda it: _judge(it, model.value, evidence), JUDGED)
