"""Near-duplicate texts by min-max hashing, confirmed on their full shingle sets.

Each of `PERMUTATIONS` multiplications is one permutation of the 64-bit shingle hashes, and
both its minimum and its maximum over a set are kept: two signature values for one pass.
`VALUES_PER_BAND` values make a band, all minima or all maxima, so that they are independent
even for small sets; documents that share a band are candidates. At the threshold itself a
pair shares none of the 52 bands with a chance of about 4e-5, while documents with a common
passage and a similarity of 0.2 are candidates with a chance of 0.3 %.

Candidates are never all pairs of a bucket. In each star round a bucket compares its
members with one leader only and links go into components. What the stars leave open is
finished exactly by prefix filtering: the shingles of the sets in open buckets are put into one
order, rare ones first (by counts in `TALLY_BITS` slots, a table of fixed size), and sets of
different components meet only where the larger one's first n - ceil(t n) + 1 shingles and the
smaller one's first n - ceil(2t / (1 + t) n) + 1 have one in common. Sets over the threshold t
always do, while a passage that many documents share is far behind in the order and joins
nothing. A pair that meets must also have few enough odd slots: of `MARK_BITS` parities per set, no
more can differ than shingles do, and few enough shingles besides its common one. Both bounds are
exact. So no link between two components is lost, and a group of near copies, or of texts
around one passage, costs about its own size.

Cases: null and word-less texts have an empty set and link with nothing; equal sets are one
node from the start; rows that repeat a doc_id are one node, each row is returned; a row
without doc_id keeps its set size, links with nothing, and has no component and is not kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.llm.components import components
from marginalia.llm.shared import held, is_empty, mixed, odd_numbers
from marginalia.llm.words import shingle_sets

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 75
PERMUTATIONS = 156
VALUES_PER_BAND = 6
STAR_ROUNDS = 2
TALLY_BITS = 20
MARK_BITS = 1024
_SLICE = 256

SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
LISTED = "id long, n long, shingles array<long>"
PREFIX = "key long, id long, n long, comp long, at int"
MARKED = "id long, mark array<long>"


def signatures(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """(set, 2 * permutations): all minima, then all maxima of every non-empty set."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    found = np.empty((len(sets), 2 * permutations), np.uint32)
    for k, factor in enumerate(odd_numbers(permutations, 31).astype(np.uint32)):
        turned = flat * factor
        found[:, k] = np.minimum.reduceat(turned, starts)
        found[:, permutations + k] = np.maximum.reduceat(turned, starts)
    return found


def band_hashes(signature: np.ndarray, values: int) -> np.ndarray:
    """One hash for each `values` neighbouring signature values; the band's number is part of it."""
    width = signature.shape[1] // values
    grouped = signature[:, : width * values].reshape(len(signature), width, values).astype(np.uint64)
    total = (grouped * odd_numbers(values, 32)).sum(axis=2, dtype=np.uint64)
    return mixed(total + odd_numbers(width, 34))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(ends, flat)


def _sign(batches, words: int, permutations: int, values: int):
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            sets = shingle_sets(part.column("text"), words)
            sizes = np.array([len(s) for s in sets], np.int64)
            keys = np.zeros((len(sets), 2), np.uint64)
            bands = [np.zeros(0, np.uint64)] * len(sets)
            full = np.flatnonzero(sizes)
            if len(full):
                picked = [sets[i] for i in full]
                for i, row in zip(full.tolist(), band_hashes(signatures(picked, permutations), values), strict=True):
                    bands[i] = row
                flat, starts = np.concatenate(picked), np.cumsum([0, *sizes[full][:-1]])
                for k, factor in enumerate(odd_numbers(2, 33)):
                    spread = (flat ^ (flat >> np.uint64(31))) * factor
                    keys[full, k] = np.add.reduceat(spread ^ (spread >> np.uint64(32)), starts)
            columns = [part.column("doc_id"), pa.array(sizes), *(pa.array(keys[:, k].view(np.int64)) for k in (0, 1)), _lists(bands)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b", "bands"])


def _list(batches, words: int):
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            sets = shingle_sets(part.column("text"), words)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), sizes, _lists(sets)], ["id", "n", "shingles"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    of_a = sets.select(F.col("id").alias("a"), F.col("n").alias("_na"), F.col("shingles").alias("_sa"))
    of_b = sets.select(F.col("id").alias("b"), F.col("n").alias("_nb"), F.col("shingles").alias("_sb"))
    shared = F.size(F.array_intersect("_sa", "_sb"))
    both = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "_na", "_nb", shared.alias("_both"))
    return both.filter(100 * F.col("_both") >= percent * (F.col("_na") + F.col("_nb") - F.col("_both"))).select("a", "b")


def _alike(n: str, m: str, percent: int):
    """Sizes that leave the similarity possible."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _merged(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with their components joined along the links, which are between nodes."""
    names = members.select("id", "comp").distinct()
    a, b = (names.select(F.col("id").alias(x), F.col("comp").alias(f"_{x}")) for x in "ab")
    joined = links.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    roots = components(joined).select(F.col("id").alias("comp"), "root")
    return members.join(roots, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")


def _open_buckets(members: DataFrame) -> DataFrame:
    """Members of the buckets that still hold more than one component."""
    several = members.groupBy("key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"))
    return members.join(several.filter("_low <> _high").select("key"), "key")


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - TALLY_BITS)).astype(np.int64)


def _shingles(column: pa.Array) -> tuple[np.ndarray, list[int]]:
    """All shingles of a batch, one set after the other, and where the sets begin and end."""
    bounds = np.cumsum([0, *column.value_lengths().to_pylist()])
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), bounds.tolist()


def _tally(batches):
    """(slot, number of shingles) of a task."""
    total = np.zeros(1 << TALLY_BITS, np.int64)
    for batch in batches:
        total += np.bincount(_slot(_shingles(batch.column("shingles"))[0]), minlength=len(total))
    slots = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], ["slot", "n"])


def _prefixes(batches, tally, percent: int):
    """The first shingles of each set in the common order, with their place; enough for a larger partner's side."""
    counts = tally.value
    for batch in batches:
        flat, bounds = _shingles(batch.column("shingles"))
        keys, rows, places = [flat[:0]], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for row, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            own, size = flat[low:high], high - low
            first = size + percent * size // -100 + 1
            order = np.lexsort((own, counts[_slot(own)]))[:first]
            keys.append(own[order])
            rows.append(np.full(len(order), row))
            places.append(np.arange(len(order), dtype=np.int32))
        at = pa.array(np.concatenate(rows))
        columns = [pa.array(np.concatenate(keys).view(np.int64)), *(batch.column(c).take(at) for c in ("id", "n", "comp"))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(places))], ["key", "id", "n", "comp", "at"])


def _marks(batches):
    """Per set the parity of its number of shingles in each of `MARK_BITS` slots."""
    for batch in batches:
        flat, bounds = _shingles(batch.column("shingles"))
        slots = (mixed(flat.copy()) % np.uint64(MARK_BITS)).astype(np.int64)
        rows = [
            np.packbits((np.bincount(slots[low:high], minlength=MARK_BITS) & 1).astype(np.uint8)).view(np.uint64)
            for low, high in zip(bounds[:-1], bounds[1:], strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(rows)], ["id", "mark"])


def _odd(left: str, right: str):
    """Slots in which two sets differ in parity; no more than the shingles that only one of them has."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(left)[k].bitwiseXOR(F.col(right)[k])) for k in range(MARK_BITS // 64)))


def _rare_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (id, comp) of different components that may be similar enough."""
    own = held(sets.join(members, "id"))
    counted = own.select("shingles").mapInArrow(_tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << TALLY_BITS, np.int64)
    counts[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    tally = own.sparkSession.sparkContext.broadcast(counts)
    prefixes = held(own.select("id", "n", "comp", "shingles").mapInArrow(partial(_prefixes, tally=tally, percent=percent), PREFIX))
    tally.destroy()
    marks = held(own.select("id", "shingles").mapInArrow(_marks, MARKED))
    met = _open_buckets(prefixes).join(marks, "id")
    # The smaller set of a pair (of equal ones that with the smaller id) needs fewer of its shingles.
    short = met.filter(F.col("at") <= F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)))
    small = short.select("key", F.col("mark").alias("_mark"), F.col("id").alias("a"), F.col("n").alias("_n"), F.col("comp").alias("_comp"), F.col("at").alias("_at"))
    later = F.struct("_n", "a") < F.struct("n", "id")
    both_sizes = F.col("_n") + F.col("n")
    few_differ = (100 + percent) * _odd("mark", "_mark") <= (100 - percent) * both_sizes
    # What lies before and after a common shingle must hold the others.
    before, after = F.least("_at", "at"), F.least(F.col("_n") - F.col("_at"), F.col("n") - F.col("at"))
    enough = (100 + percent) * (before + after) >= percent * both_sizes
    both = met.join(small, "key").filter(later & (F.col("comp") != F.col("_comp")) & _alike("n", "_n", percent) & enough & few_differ)
    # Nothing common lies before the first common shingle.
    first = both.groupBy("a", F.col("id").alias("b"), "_n", "n").agg(F.min(F.struct("_at", "at")).alias("_first"))
    most = F.least(F.col("_n") - F.col("_first._at"), F.col("n") - F.col("_first.at"))
    return first.filter((100 + percent) * most >= percent * both_sizes).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    percent: int = THRESHOLD_PERCENT,
    permutations: int = PERMUTATIONS,
    values: int = VALUES_PER_BAND,
    rounds: int = STAR_ROUNDS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = held(texts.mapInArrow(partial(_sign, words=words, permutations=permutations, values=values), SIGNED))
    sets_of = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = sets_of.groupBy("set_a", "set_b", F.col("n_shingles").alias("n")).agg(
        F.min("doc_id").alias("id"), F.first("bands").alias("bands")
    )
    bands = nodes.select("id", "n", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    members = held(
        bands.join(shared.filter("_low <> _high").select("key"), "key")
        .select("key", "id", "n", F.col("id").alias("comp"))
    )
    candidates = members.select("id").distinct()
    listed = texts.join(candidates, texts.doc_id == candidates.id).select("id", "text")
    sets = held(listed.mapInArrow(partial(_list, words=words), LISTED))
    links = None

    def tested(pairs: DataFrame) -> None:
        nonlocal links, members
        found = held(_linked(pairs.distinct(), sets, percent))
        links = found if links is None else links.union(found)
        members = held(_open_buckets(_merged(members, found)))

    for turn in range(rounds):
        if is_empty(members):
            break
        first = F.min_by(F.struct("id", "n", "comp"), F.xxhash64("id", F.lit(turn)) if turn else F.col("id"))
        leads = members.groupBy("key").agg(first.alias("_lead"))
        star = members.join(leads, "key").filter(F.col("comp") != F.col("_lead.comp"))
        star = star.filter(_alike("n", "_lead.n", percent))
        tested(star.select(F.col("_lead.id").alias("a"), F.col("id").alias("b")))
    if not is_empty(members):
        found = held(_linked(_rare_pairs(members.select("id", "comp").distinct(), sets, percent), sets, percent))
        links = found if links is None else links.union(found)
    # Rows of one doc_id are one node, even if their sets differ.
    same_set = nodes.select("set_a", "set_b", F.col("n").alias("n_shingles"), F.col("id").alias("_node"))
    keyed = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(same_set, ["set_a", "set_b", "n_shingles"], "left")
    keyed = keyed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("_node")).alias("_node"))
    repeated = keyed.filter("_node <> doc_id").select(F.col("doc_id").alias("a"), F.col("_node").alias("b"))
    again = repeated.join(_ids_of_many(signed), repeated.a == F.col("_many"), "left_semi")
    edges = again if links is None else links.union(again)
    roots = components(edges).select(F.col("id").alias("_node"), "root")
    rows = keyed.withColumn("_node", F.coalesce("_node", "doc_id")).join(roots, "_node", "left")
    component = F.coalesce("root", "_node")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(False))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _ids_of_many(signed: DataFrame) -> DataFrame:
    """Ids that stand for several different sets."""
    kinds = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_many"))
    return kinds.agg(F.min("set_a").alias("_low"), F.max("set_a").alias("_high")).filter("_low <> _high").select("_many")
