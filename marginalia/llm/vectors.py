"""Near-duplicate vectors by collision counting on one-dimensional projections.

On each of many projections the vectors are sorted, and a vector collides with those in a
window centred on it. Pairs with enough collisions are verified by their cosine in double
precision. The projections are an orthonormal basis, so the squared differences add up to
2 - 2 cos: with the window below, a pair at the threshold misses fewer than a third of them.
The count is calibrated to that and loses no pair.

A window on one projection holds a fixed share of all vectors, so counting over the whole
table would be quadratic. Vectors are therefore dealt first: in each of L views a vector's
cell is the side it takes on k further projections. Windows are sorted and counted within
cells. k follows the number of vectors, so that a cell holds about `CELL` of them, and L
follows k, so that a pair at the threshold shares a cell with a chance of `RECALL`.

Equal vectors are one node from the start. A cell over `BLOCK` vectors is worked off in pairs
of blocks. A pair counts in the first view in which it shares a cell, so links are summed and
never listed; only one edge per vector and block goes on to the components.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
without vec_id, link with nothing; vectors of different length do not link; rows that repeat a
vec_id with the same vector count once as neighbours; each row is returned; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.llm.components import components
from marginalia.llm.shared import held

THRESHOLD = 0.9
RECALL = 0.9999
CELL = 256
BLOCK = 2048
KEYED = "vec_id long, key binary, vector array<double>"


def _key(batches):
    for batch in batches:
        keys, vectors = [], []
        for values in batch.column("embedding").to_pylist():
            usable = bool(values) and None not in values
            vector = np.array(values if usable else [], float)
            usable = usable and bool(np.isfinite(vector).all()) and bool(vector.any())
            # 0.0 and -0.0 are one value.
            keys.append(hashlib.md5((vector + 0.0).tobytes(), usedforsecurity=False).digest() if usable else None)
            vectors.append(vector if usable else None)
        columns = [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vectors, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "key", "vector"])


def plan(number: int, threshold: float = THRESHOLD, recall: float = RECALL, cell: int = CELL) -> tuple[int, int]:
    """(projections per view k, views L) for so many distinct vectors."""
    k = max(1, round(math.log2(max(2, number) / cell)))
    same = (1 - math.acos(threshold) / math.pi) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _units(lists: pa.Array) -> np.ndarray:
    vectors = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _cells(units: np.ndarray, k: int, views: int) -> np.ndarray:
    """(vector, view): the cell number."""
    draw = np.random.default_rng([41, units.shape[1]])
    sides = units @ draw.standard_normal((units.shape[1], views * k)) > 0
    return (sides.reshape(len(units), views, k) << np.arange(k)).sum(axis=2)


def collisions(left: np.ndarray, right: np.ndarray, window: float) -> np.ndarray:
    """How many projections put each right vector into the window of each left one."""
    counts = np.zeros((len(left), len(right)), np.uint16)
    draw = np.random.default_rng([42, left.shape[1]])
    basis = np.linalg.qr(draw.standard_normal((left.shape[1],) * 2))[0]
    queries, lines = left @ basis, right @ basis
    step = np.zeros((len(left), len(right) + 1), np.int8)
    row = np.arange(len(left))
    for k in range(left.shape[1]):
        order = np.argsort(lines[:, k], kind="stable")
        line = lines[order, k]
        step[:] = 0
        step[row, np.searchsorted(line, queries[:, k] - window, "left")] += 1
        step[row, np.searchsorted(line, queries[:, k] + window, "right")] -= 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        counts += np.cumsum(step[:, :-1], axis=1, dtype=np.int8)[:, back].view(np.uint8)
    return counts


def _linked(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose collision count and then cosine are high enough."""
    size = left.shape[1]
    misses = size / 3
    window = math.sqrt((2 - 2 * threshold) / misses) * (1 + 1e-9)
    a, b = np.nonzero(collisions(left, right, window) >= size - misses)
    good = np.concatenate([(left[a[i : i + 65536]] * right[b[i : i + 65536]]).sum(axis=1) >= threshold for i in range(0, max(1, len(a)), 65536)])
    return a[good], b[good]


def _roots(number: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each."""
    root = np.arange(number)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _work(k: int, views: int, threshold: float):
    kind = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("other", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        view, first, second = (table[c][0].as_py() for c in ("view", "first", "second"))
        units = _units(table["vector"].chunk(0))
        keys, many, block = table["key"].to_pylist(), table["many"].to_numpy(), table["block"].to_numpy()
        left = np.flatnonzero(block == first)
        right = left if first == second else np.flatnonzero(block == second)
        if not len(left) or not len(right):
            return kind.empty_table()
        a, b = _linked(units[left], units[right], threshold)
        a, b = left[a], right[b]
        if first == second:
            a, b = a[a < b], b[a < b]
        cells = _cells(units, k, views)
        new = np.ones(len(a), bool)
        for v in range(view):
            new &= cells[a, v] != cells[b, v]
        a, b = a[new], b[new]
        links = np.zeros(len(keys), np.int64)
        np.add.at(links, a, many[b])
        np.add.at(links, b, many[a])
        root = _roots(len(keys), a, b)
        rows = np.flatnonzero(links).tolist()
        columns = [[keys[i] for i in rows], links[rows], [keys[root[i]] for i in rows]]
        return pa.table(dict(zip(kind.names, columns, strict=True)), schema=kind)

    return run


def near_vectors(
    embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, cell: int = CELL, block: int = BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `embeddings` (vec_id, embedding)."""
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    keyed = held(given.mapInArrow(_key, KEYED))
    usable = keyed.filter("key IS NOT NULL AND vec_id IS NOT NULL")
    names = usable.select("key", "vec_id").distinct().groupBy("key").agg(F.count("*").alias("many"), F.min("vec_id").alias("id"))
    vectors = usable.groupBy("key").agg(F.first("vector").alias("vector"))
    nodes = held(names.join(vectors, "key"))
    k, views = plan(nodes.count(), threshold, recall, cell)

    def dealt(batches):
        kinds = {"key": pa.binary(), "many": pa.int64(), "vector": pa.list_(pa.float64()), "size": pa.int32(), "view": pa.int32(), "cell": pa.int64()}
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                cells = _cells(_units(part.column("vector")), k, views)
                for view in range(views):
                    rows = part.num_rows
                    columns = [part.column("key"), part.column("many"), part.column("vector"), pa.array(np.full(rows, size)), pa.array(np.full(rows, view)), pa.array(cells[:, view])]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    spread = nodes.select("key", "many", "vector").mapInArrow(dealt, "key binary, many long, vector array<double>, size int, view int, cell long")
    full = spread.groupBy("size", "view", "cell").count().withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count")
    rows = spread.join(full, ["size", "view", "cell"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("first", F.least("block", "_other")).withColumn("second", F.greatest("block", "_other"))
    cells = rows.select("size", "view", "cell", "first", "second", "key", "many", "vector", "block").groupBy("size", "view", "cell", "first", "second")
    found = held(cells.applyInArrow(_work(k, views, threshold), "key binary, links long, other binary"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("other").alias("b"))).select(F.col("id").alias("key"), "root")
    told = nodes.select("key", "many", "id").join(links, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    lowest = told.groupBy("root").agg(F.min("id").alias("component"))
    told = told.join(lowest, "root").select("key", "component", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"))
    usual = F.col("vec_id").isNotNull()
    result = keyed.select("vec_id", F.when(usual, F.col("key")).alias("key")).join(told, "key", "left")
    component = F.coalesce("component", "vec_id")
    return result.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
