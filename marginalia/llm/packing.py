"""Packing of tokenised documents into sequences by a configuration linear program.

1. Tokenise. Texts become ids of a public tokenizer plus one end id; documents over the
   capacity are cut into pieces, never anything else. Ids of words are remembered per task.
2. Only the histogram of piece lengths (at most `capacity` rows) reaches the driver.
3. Cover it: a configuration says how many pieces of each length share a sequence. Prices of
   lengths follow multiplicative weights, lower the more of a length is covered; a knapsack
   dynamic program over the prices of the lengths still open gives, for each length, the best
   configuration that holds it. Those of long pieces come first, each as often as its scarcest
   length allows in a round (`STEP` of what is wanted), until all lengths are covered.
4. Round: of full configurations what the program says, of nearly full ones the whole part. What
   is left is a smaller histogram, so its program is solved and rounded again, until less than
   `REST` of all tokens is left; best fit in decreasing length packs that, by counts of equal
   sequences, not piece by piece.
5. Pieces of one length are numbered in (length, salt) groups plus offsets, so no length is one
   task; a number gives sequence and place by arithmetic on the bounded solution.

Cases: a null text is empty and gives the end id alone; a null doc_id is a value like others;
repeated rows are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from marginalia.llm.shared import held

CAPACITY = 2048
END_ID = 0
# Share of a length's pieces that one round may cover (finer where there are few lengths, as rounds
# are cheap then), how fast prices fall with coverage, a bound on rounds.
STEP = 0.5
FINEST = 0.05
LENGTHS_PER_STEP = 2_000
RATE = 1.0
MOST_ROUNDS = 2_000
# How full a configuration is that is rounded, and the share of tokens left to best fit.
NEARLY_FULL = 0.995
REST = 0.08
SALTS = 1024
# Runs of letters or signs, and whole words made of them, whose ids a task remembers before
# it starts anew. They bound its memory at about 0.3 GB.
REMEMBERED_RUNS = 1_000_000
REMEMBERED_WORDS = 400_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, sequence_id long, offset long"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of texts as little-endian bytes, for a tokenizer that drops white space.

    Such a tokenizer treats every word between spaces alone, so ids are kept per word. Plain
    words (letters, then maybe signs) go straight to the model; all others, and texts with
    separators on which the two notions of white space differ, to the whole tokenizer.
    """

    _LETTERS = _byte_letters()
    _SIGNS = ".,;:!?*$%&#|"

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        # Fixed sample: white space must vanish and capitals must not matter.
        a, b = self._ids(["ab cd\n Ab."]), self._ids(["ab", "cd", "ab", "."])
        self.by_word = b"".join(a) == b"".join(b)
        self.known: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.whole.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            letters = run if run.isascii() else "".join(map(self._LETTERS.__getitem__, run.encode()))
            ids = np.array([t.id for t in self.whole.model.tokenize(letters)], "<u4").tobytes()
            self.runs[run] = ids
        return ids

    def _learn(self, words: set[str]) -> None:
        if len(self.runs) > REMEMBERED_RUNS:
            self.runs.clear()
        known, run, signs, hard = self.known, self._run, self._SIGNS, []
        for word in words:
            if word.isascii() and word.isalpha():
                known[word] = run(word.lower())
                continue
            core = word.rstrip(signs)
            if core and not (core.isalpha() and (core.isascii() or max(core) < "İ")):
                hard.append(word)
            else:
                tail = word[len(core) :]
                known[word] = (run(core.lower()) if core else b"") + (run(tail) if tail else b"")
        known.update(zip(hard, self._ids(hard), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._ids(texts)
        odd = {i for i, t in enumerate(texts) if "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t}
        words = [[] if i in odd else t.split() for i, t in enumerate(texts)]
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        if missing := set().union(*words).difference(self.known):
            self._learn(missing)
        known = self.known.__getitem__
        return [self._ids([t])[0] if i in odd else b"".join(map(known, w)) for i, (t, w) in enumerate(zip(texts, words, strict=True))]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _cut(batches, path: str, capacity: int, end_id: int):
    encoder, end = _encoder(path), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            rows = []
            encoded = encoder.encode([t or "" for t in part.column("text").to_pylist()])
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                ids += end
                for k, first in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[first : first + 4 * capacity]
                    rows.append((doc_id, k, first // 4, len(own) // 4, zlib.crc32(own)))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids in pieces of the capacity."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(partial(_cut, path=path, capacity=capacity, end_id=end_id), PIECE)


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total price for every room up to the capacity, and the index of a length it uses (-1: as with one token less)."""
    best, used = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fits[room]:
            totals = best[room - lengths[: fits[room]]] + prices[: fits[room]]
            top = int(totals.argmax())
            if totals[top] > best[room]:
                best[room], used[room] = totals[top], top
    return best, used


def _configuration(first: int, lengths: np.ndarray, used: np.ndarray, capacity: int) -> Counter:
    """The best configuration that holds the length of index `first`: how often each index."""
    found, room = Counter([first]), capacity - int(lengths[first])
    while room > 0:
        top = int(used[room])
        if top < 0:
            room -= 1
        else:
            found[top] += 1
            room -= int(lengths[top])
    return found


def cover(histogram: dict[int, int], capacity: int, step: float = STEP, rate: float = RATE) -> dict[tuple, float]:
    """Fractional configurations that cover the whole histogram, by multiplicative weights."""
    lengths = np.array(sorted(histogram), np.int64)
    wanted = np.array([histogram[n] for n in lengths.tolist()], float)
    covered, chosen = np.zeros(len(lengths)), defaultdict(float)
    for turn in range(MOST_ROUNDS):
        left = np.flatnonzero(covered < wanted * (1 - 1e-9))
        if not len(left):
            break
        own, lack = lengths[left], covered[left] / wanted[left]
        prices = own / capacity * np.exp(-rate * (lack - lack.mean()))
        _, used = _knapsack(own, prices, capacity)
        # The last round may cover all that is left.
        most = 1.0 if turn == MOST_ROUNDS - 1 else step
        room = np.minimum(wanted - covered, most * wanted)[left]
        # Long pieces have few partners, so their configurations choose first.
        for i in range(len(own) - 1, -1, -1):
            config = _configuration(i, own, used, capacity)
            amount = min(room[k] / count for k, count in config.items())
            if amount > 1e-9:
                for k, count in config.items():
                    room[k] -= amount * count
                    covered[left[k]] += amount * count
                chosen[tuple(sorted((int(own[k]), count) for k, count in config.items()))] += amount
    return dict(chosen)


def _tokens(histogram: dict[int, int]) -> int:
    return sum(length * count for length, count in histogram.items())


def _rounded(fractional: dict[tuple, float], left: dict[int, int], capacity: int) -> Counter:
    """Whole configurations out of what is left, which is reduced by them."""
    whole: Counter = Counter()
    ordered = sorted(fractional.items(), key=lambda x: (-x[1], x[0]))
    for least, share_of in ((capacity, round), (NEARLY_FULL * capacity, int)):
        for config, share in ordered:
            if sum(length * count for length, count in config) >= least:
                number = min(share_of(share), *(left.get(length, 0) // count for length, count in config))
                if number > 0:
                    whole[config] += number
                    for length, count in config:
                        left[length] -= number * count
    for length in [length for length, count in left.items() if not count]:
        del left[length]
    return whole


def _best_fit(left: dict[int, int], capacity: int) -> Counter:
    """Best fit in decreasing length over counts: equal open sequences are moved together."""
    rooms: dict[int, Counter] = defaultdict(Counter)
    for length in sorted(left, reverse=True):
        number = left[length]
        while number:
            fitting = [room for room, kinds in rooms.items() if room >= length and kinds]
            if fitting:
                room = min(fitting)
                content, many = rooms[room].popitem()
                moved = min(number, many)
                if many > moved:
                    rooms[room][content] = many - moved
                rooms[room - length][(*content, length)] += moved
                number -= moved
            else:
                each = capacity // length
                full, rest = divmod(number, each)
                if full:
                    rooms[capacity - each * length][(length,) * each] += full
                if rest:
                    rooms[capacity - rest * length][(length,) * rest] += 1
                number = 0
    found = Counter()
    for kinds in rooms.values():
        for content, many in kinds.items():
            found[tuple(sorted(Counter(content).items()))] += many
    return found


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Whole configurations ((length, count), …) and how many sequences use each, for all pieces."""
    whole, left = programmed(histogram, capacity)
    whole.update(_best_fit(left, capacity))
    return sorted(whole.items())


def programmed(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[Counter, dict[int, int]]:
    """What the programs give as whole configurations, and the lengths that are left."""
    left = dict(histogram)
    whole: Counter = Counter()
    if left.get(capacity):
        whole[((capacity, 1),)] = left.pop(capacity)
    step, rest = min(STEP, max(FINEST, len(left) / LENGTHS_PER_STEP)), REST * _tokens(histogram)
    while _tokens(left) > rest:
        found = _rounded(cover(left, capacity, step), left, capacity)
        if not found:
            break
        whole.update(found)
        # Counts are small by now; half of one would round to nothing.
        step = 1.0
    return whole, left


def _slots(solution) -> dict[str, np.ndarray]:
    """Per length and configuration: first number of a piece, first sequence, pieces in each, first place."""
    rows, numbers, sequence = [], Counter(), 0
    for config, many in solution:
        place = 0
        for length, count in config:
            rows.append((length, numbers[length], sequence, count, place))
            numbers[length] += many * count
            place += length * count
        sequence += many
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 48) + table[:, 1], "first": table[:, 1], "sequence": table[:, 2], "count": table[:, 3], "place": table[:, 4]}


def _place(batches, slots: dict[str, np.ndarray]):
    for batch in batches:
        length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_number"))
        row = np.searchsorted(slots["key"], (length << 48) + number, "right") - 1
        inside = number - slots["first"][row]
        sequence = slots["sequence"][row] + inside // slots["count"][row]
        offset = slots["place"][row] + inside % slots["count"][row] * length
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        columns = [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)]
        yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, salts: int = SALTS) -> DataFrame:
    """Every piece of every row of `docs` (doc_id, text) with its sequence and place in it."""
    cut = held(pieces(docs, path, capacity, end_id))
    # At most `capacity` rows.
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "_salt").count()
    offsets = offsets.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = salted.withColumn("_rank", F.row_number().over(own)).join(offsets, ["length", "_salt"])
    numbered = numbered.withColumn("_number", F.col("_before") + F.col("_rank") - 1).drop("_salt", "_rank", "_before")
    return numbered.mapInArrow(partial(_place, slots=_slots(solve(histogram, capacity))), PACKED)
