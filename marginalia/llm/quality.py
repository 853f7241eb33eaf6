"""Quality of texts by a byte-level convolutional network in numpy.

Bytes fall into classes (letters, capitals, digits, signs, …). Filters over `WIDTH` bytes run
over the whole text; their maxima over overlapping chunks of two rows of `ROW` bytes go through
a small layer, whose mean and maximum over all chunks of the text give one probability. The
weights are learned by one task from a sample of labelled rows that is bounded in rows and in
bytes, so the driver sees the weights only. Learning and scoring read every byte of a row and
pool over the same chunks, learning `BLOCK` rows of bytes at a time.

Cases: null and empty texts are one chunk of padding; without labels of both kinds every score
is 0.5; conflicting labels of a document count as the larger; repeated rows are scored each;
memory does not follow the length of a text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.llm.samples import with_labels
from marginalia.llm.shared import share

# Bounds of the labelled rows to learn from, and of the bytes of their texts.
LEARNING_ROWS = 4_000
LEARNING_BYTES = 1 << 26
# Rows of bytes that filters run over at a time while learning.
BLOCK = 512
STEPS = 1_200
BATCH = 32
ROW = 128
WIDTH = 6
FILTERS = 16
HIDDEN = 12
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def _classes() -> np.ndarray:
    """Class of each byte: 0 padding, white space, a-z, capitals, digits, each sign, UTF-8 heads and tails."""
    found = np.ones(256, np.uint8)
    found[10] = 2
    found[97:123] = np.arange(3, 29)
    found[65:91], found[48:58] = 29, 30
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    found[signs] = 31 + np.arange(len(signs))
    found[128:192], found[192:] = 31 + len(signs), 32 + len(signs)
    found[32] = 33 + len(signs)
    return found


CLASS = _classes()
KINDS = int(CLASS.max()) + 1


def _rows(text: bytes, first: int, count: int) -> np.ndarray:
    """Byte classes of `count` rows from row `first` on, each with the bytes its last filters reach."""
    part = CLASS[np.frombuffer(text[first * ROW : (first + count) * ROW + WIDTH - 1], np.uint8)]
    padded = np.zeros(count * ROW + WIDTH - 1, np.uint8)
    padded[: len(part)] = part
    return np.lib.stride_tricks.sliding_window_view(padded, ROW + WIDTH - 1)[::ROW]


def _sums(rows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Every filter at every place of the rows."""
    rows = rows.astype(np.int32)
    pair = rows[:, :-1] * KINDS + rows[:, 1:]
    sums = tables[0].take(pair[:, :ROW], axis=0)
    for k, table in enumerate(tables[1:], 1):
        sums += table.take(pair[:, 2 * k : 2 * k + ROW], axis=0)
    return sums


class Network:
    def __init__(self, seed: int = 5) -> None:
        draw = np.random.default_rng(seed).standard_normal
        self.filters = (draw((WIDTH, KINDS, FILTERS)) * 0.3).astype(np.float32)
        self.inner = (draw((FILTERS, HIDDEN)) * 0.4).astype(np.float32)
        self.shift = np.zeros(HIDDEN, np.float32)
        self.outer = (draw(2 * HIDDEN) * 0.3).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.filters, self.inner, self.shift, self.outer, self.bias]

    def weights(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parameters()]).astype("<f4").tobytes()

    @classmethod
    def of(cls, weights: bytes) -> Network:
        network, at = cls(), 0
        flat = np.frombuffer(weights, "<f4")
        for part in network.parameters():
            part[...] = flat[at : at + part.size].reshape(part.shape)
            at += part.size
        return network

    def step(self, rows: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Gradients over all rows (n, ROW + WIDTH - 1) of some texts; owner: text of each, ascending."""
        top = np.zeros((len(rows), FILTERS), np.float32)
        place = np.zeros(top.shape, np.int64)
        tables = self.pairs()
        for at in range(0, len(rows), BLOCK):
            sums = _sums(rows[at : at + BLOCK], tables)
            place[at : at + BLOCK] = sums.argmax(1)
            top[at : at + BLOCK] = np.take_along_axis(sums, place[at : at + BLOCK, None], 1)[:, 0]
        # The row of each chunk, itself or the next one, that has the maximum of a filter.
        lane, source = np.arange(FILTERS), np.repeat(np.arange(len(rows))[:, None], FILTERS, 1)
        paired = owner[1:] == owner[:-1]
        source[:-1] += (top[1:] > top[:-1]) & paired[:, None]
        alone = np.ones(len(rows), bool)
        alone[1:] = ~paired
        alone[:-1] |= paired
        source, owner = source[alone], owner[alone]
        top, place = top[source, lane], place[source, lane]
        hidden = np.tanh(top @ self.inner + self.shift)
        starts = np.searchsorted(owner, np.arange(len(labels)))
        sizes = np.diff([*starts, len(owner)])[:, None]
        pooled = np.hstack([np.add.reduceat(hidden, starts) / sizes, np.maximum.reduceat(hidden, starts)])
        error = (1 / (1 + np.exp(-(pooled @ self.outer + self.bias))) - labels) / len(labels)
        back = error[:, None] * self.outer
        # Equal chunks share the slope of their maximum.
        at_max = (hidden == pooled[owner, HIDDEN:]).astype(np.float32)
        at_max /= np.add.reduceat(at_max, starts)[owner]
        slope = (back[:, :HIDDEN] / sizes)[owner] + back[owner, HIDDEN:] * at_max
        slope *= 1 - hidden**2
        deep = slope @ self.inner.T
        filters = np.stack([
            np.bincount((rows[source, place + k].astype(np.int64) * FILTERS + lane).ravel(), deep.ravel(), KINDS * FILTERS)
            for k in range(WIDTH)
        ])
        filters = filters.reshape(self.filters.shape).astype(np.float32)
        return [filters, top.T @ slope, slope.sum(0), error @ pooled, error.sum(keepdims=True)]

    def learn(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 6) -> None:
        counts = np.array([max(1, -(-len(t) // ROW)) for t in texts])
        draw = np.random.default_rng(seed)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        kinds = [np.flatnonzero(labels == k) for k in (0, 1)]
        for turn in range(1, steps + 1):
            # Half a batch of each label.
            picked = np.concatenate([draw.choice(k, BATCH // 2) for k in kinds])
            owner = np.repeat(np.arange(len(picked)), counts[picked])
            grads = self.step(np.concatenate([_rows(texts[i], 0, int(counts[i])) for i in picked]), owner, labels[picked].astype(np.float32))
            rate = 0.01 * min(1.0, 2 * (1 - turn / (steps + 1)))
            for p, g, (m, v) in zip(self.parameters(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)).astype(np.float32)

    def pairs(self) -> list[np.ndarray]:
        """The filters as tables over pairs of neighbouring bytes, for fewer look-ups."""
        f = self.filters
        return [(f[k][:, None] + f[k + 1][None]).reshape(-1, FILTERS) for k in range(0, WIDTH, 2)]

    def score(self, texts: list[bytes], tables: list[np.ndarray], block: int = 256) -> np.ndarray:
        """Probability of label 1 of every whole text."""
        counts = np.array([max(1, -(-len(t) // ROW)) for t in texts])
        tops, todo, waiting = [], [], 0

        def run() -> None:
            nonlocal waiting
            if todo:
                rows = np.concatenate(todo)
                tops.append(_sums(rows, tables).max(1))
                todo.clear()
                waiting = 0

        for text, count in zip(texts, counts.tolist(), strict=True):
            for first in range(0, count, block):
                number = min(block, count - first)
                todo.append(_rows(text, first, number))
                waiting += number
                if waiting >= block:
                    run()
        run()
        top, starts = np.concatenate(tops), np.cumsum([0, *counts[:-1]])
        # A chunk is a row and the next one of its text; a text of one row is one chunk.
        chunk = top.copy()
        chunk[:-1] = np.maximum(top[:-1], top[1:])
        last = starts + counts - 1
        chunk[last] = top[last]
        hidden = np.tanh(chunk @ self.inner + self.shift)
        many = counts > 1
        weight = np.ones((len(chunk), 1), np.float32)
        weight[last[many]] = 0
        mean = np.add.reduceat(hidden * weight, starts) / np.maximum(1, counts - many)[:, None]
        most = np.maximum.reduceat(np.where(weight > 0, hidden, np.float32(-1)), starts)
        return 1 / (1 + np.exp(-(np.hstack([mean, most]) @ self.outer + self.bias).astype(float)))


def learn(sample: DataFrame, most_bytes: int = LEARNING_BYTES) -> Network | None:
    """A network from a bounded sample (text, label); None without both labels.

    The rows come in the order of a hash; texts count up to `most_bytes`, a whole text at a time.
    """

    def fitted(batches):
        texts, labels, size = [], [], 0
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                content = text.encode()
                if not texts or size + len(content) <= most_bytes:
                    texts.append(content)
                    labels.append(int(label > 0))
                    size += len(content)
        if len(set(labels)) == 2:
            network = Network()
            network.learn(texts, np.array(labels))
            yield pa.RecordBatch.from_arrays([pa.array([network.weights()], pa.binary())], ["weights"])

    # The order of the rows decides nothing but the draws: fix it.
    rows = sample.select("text", "label").repartition(1).sortWithinPartitions(F.xxhash64("text"), "text")
    found = rows.mapInArrow(fitted, "weights binary").collect()
    return Network.of(bytes(found[0]["weights"])) if found else None


def score(docs: DataFrame, labels: DataFrame, parts: int = 3, residue: int = 1, rows: int = LEARNING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text).

    `labels` (doc_id, quality) teach, outside the held-out part only.
    """
    held_out = share("held_out", F.col("doc_id"), parts, residue)
    shared = docs.sparkSession.sparkContext.broadcast(learn(with_labels(docs, labels, "quality", held_out, rows)))

    def scored(batches):
        network = shared.value
        tables = network.pairs() if network else []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                values = network.score(texts, tables) if network else np.full(len(texts), 0.5)
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(values), pa.array((values >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out)
    return texts.mapInArrow(scored, SCORED)
