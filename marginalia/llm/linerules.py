"""Quality rules, lines first: bad lines go, then documents that lost too much of their text.

Every line with a word is judged by itself: navigation (words between separators), symbols,
shouting, exclamations, no punctuation at all, and phrases of boilerplate. Lines that fail are
left out of the cleaned text. A document stays if it passes the base rules (`LEAST_WORDS`; not
more than `REPEATED_PERCENT` of its words in repeated windows of `WINDOW_WORDS` words) and loses no
more than `LOST_PERCENT` of its words with its lines.

A word is a run of characters other than space and 0x09-0x0D; lines end at \\n. Counts are over
whole texts; a batch is read in slices, and memory follows the longest text, not the batch.

Cases: a null text has no words, an empty cleaned text and fails the base rules, like an
empty one; a line of white space is no line that can fail and stays; rows that repeat are judged alike,
each row is returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from marginalia.llm.words import EXACT, SPACE, ngram_hashes, word_hashes

LEAST_WORDS = 20
REPEATED_PERCENT = 30
WINDOW_WORDS = 8
LOST_PERCENT = 30
SYMBOLS = "#*$%&|<>"
_SLICE_BYTES = 1 << 22

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = r"\x20\x09-\x0D"
SEPARATORS = "|»›>•·"
EXCLAIMED = rf"[!?][!?]+(?![^{SPACES}])"
MARK = r"[.,;:!?…。、]"
# Phrases of boilerplate, sought without regard to case.
BOILERPLATE = (
    r"all rights reserved|©|\bcopyright \(c\)|\bcookies?\b|privacy policy|terms of (use|service)|sign up (for|now|today)|"
    r"subscribe (to|now|today)|click here|read more|enable javascript|powered by|lorem ipsum|follow us on|"
    r"tous droits réservés|mentions légales|alle rechte vorbehalten|datenschutzerklärung|"
    r"todos los derechos reservados|política de privacidad"
)
# A longer line is prose that happens to hold such a phrase.
BOILERPLATE_WORDS = 30
PUNCTUATED_WORDS = 6
CASED_LETTERS = 20

_separator, _exclaimed = re.compile(f"[{SEPARATORS}]"), re.compile(EXCLAIMED)
_mark, _symbol = re.compile(MARK), re.compile(f"[{SYMBOLS}]")
_boilerplate = re.compile(BOILERPLATE, re.I)
_upper, _cased = regex.compile(r"\p{Lu}"), regex.compile(r"[\p{Lu}\p{Ll}]")
_ASCII_CAPITAL, _ASCII_SMALL = re.compile("[A-Z]"), re.compile("[a-z]")

JUDGED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lost_words long, n_failed_lines long, clean_text string"
)


def fault(line: str) -> tuple[int, str | None]:
    """Words of a line, and the first rule that it breaks; a line without a word breaks none."""
    words = WORD.findall(line)
    count = len(words)
    if not count:
        return 0, None
    if _separator.search(line):
        separators = sum(not word.strip(SEPARATORS) for word in words)
        if separators >= 3 and 4 * separators >= count:
            return count, "navigation"
    if 10 * len(_symbol.findall(line)) > sum(map(len, words)):
        return count, "symbols"
    if _shouted(line):
        return count, "shouting"
    if 3 * len(_exclaimed.findall(line)) > count:
        return count, "exclamations"
    if count >= PUNCTUATED_WORDS and not _mark.search(line):
        return count, "unpunctuated"
    if count <= BOILERPLATE_WORDS and _boilerplate.search(line):
        return count, "boilerplate"
    return count, None


def _shouted(line: str) -> bool:
    if line.isascii():
        capitals = len(_ASCII_CAPITAL.findall(line))
        if 10 * capitals <= 7 * CASED_LETTERS:
            return False
        cased = capitals + len(_ASCII_SMALL.findall(line))
    else:
        capitals = len(_upper.findall(line))
        cased = len(_cased.findall(line)) if 10 * capitals > 7 * CASED_LETTERS else 0
    return cased >= CASED_LETTERS and 10 * capitals > 7 * cased


def _repeated(hashes: np.ndarray, window: int) -> int:
    """Words that lie in a window of words found twice or more."""
    grams = ngram_hashes(hashes, window)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = np.diff(grams[order]) == 0
    if not same.any():
        return 0
    often = np.zeros(len(grams), bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int(np.count_nonzero(np.cumsum(cover)[:-1]))


# Per byte: does it begin a character that is part of a word, is it one of the symbols?
_LETTER = ~SPACE & ((np.arange(256) & 0xC0) != 0x80)
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))


def _lines(text: str) -> tuple[int, int, int, str]:
    """Repeated lines, words of failed lines, failed lines, the text without them."""
    seen: set[str] = set()
    repeats, lost, failed, kept = 0, 0, 0, []
    for line in text.split("\n"):
        count, broken = fault(line)
        if count and line in seen:
            repeats += 1
        seen.add(line)
        if broken:
            lost += count
            failed += 1
        else:
            kept.append(line)
    return repeats, lost, failed, "\n".join(kept)


def _slices(column: pa.Array):
    """The rows in runs of about `_SLICE_BYTES`; one text is never cut."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :]
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(offsets[: len(column) + 1], offsets[begin] + _SLICE_BYTES, "left"))
        end = min(max(end, begin + 1), len(column))
        yield column.slice(begin, end - begin)
        begin = end


def _judge(batches, window: int):
    names = [part.split()[0] for part in JUDGED.split(", ")]
    for batch in batches:
        whole = batch.column("text").fill_null("").cast(pa.large_string())
        ids, at = batch.column("doc_id"), 0
        for column in _slices(whole):
            hashes, bounds, _ = word_hashes(column, EXACT)
            rows = []
            for k, text in enumerate(column.to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                letters, symbols = (int(np.count_nonzero(table[data])) for table in (_LETTER, _SYMBOL))
                own = hashes[bounds[k] : bounds[k + 1]]
                repeats, lost, failed, kept = _lines(text)
                rows.append((len(own), letters, symbols, repeats, _repeated(own, window), lost, failed, kept))
            kinds = [pa.int64()] * 7 + [pa.string()]
            columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(rows)), *columns], names)
            at += len(rows)


def line_rules(docs: DataFrame, lost_percent: int = LOST_PERCENT, window: int = WINDOW_WORDS) -> DataFrame:
    """Counts, verdicts (`base_failed`, `kept`) and `clean_text` for every row of `docs` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    judged = texts.mapInArrow(partial(_judge, window=window), JUDGED)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    much = 100 * F.col("n_lost_words") > lost_percent * F.col("n_words")
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~much)
