"""A Merkle manifest of a dataset: one root for all rows, and for every row the proof up to it.

A row's leaf is a digest of its values. Within its group (for documents: the language) leaves
have places 0, 1, 2, … in key order; `FANOUT` neighbouring nodes have one parent, and so on up
to the group's subroot. The subroots, in the order of the groups, are the leaves of a tree of
their own, whose top is the root.

Every level is an equi-join of the nodes with themselves on computed indices: a node in slot k of
its run is shifted to the index of slot zero (index XOR 1 in a binary tree, index - k otherwise),
and slot-zero rows, with all the siblings that they met, emit the parents. Each node is shuffled once per
level, and levels shrink by `FANOUT`, so all levels together cost little more than the first.
Proofs go the other way: a run hands each of its nodes what lies to the left and to the right of
it, and what its parent got, so only the last step is as wide as the table. Everything is
built-in expressions; a group that holds most rows is split like any other, because places come
from range partitions and joins are on (group, place).

Cases: a null value is `-`, so it differs from an empty text; null keys come first; rows that
repeat a key are ordered by their leaves, and equal rows are leaves of their own that share
their digests, each with its own place and proof; a lone leaf is its subroot, a lone subroot the
root; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.llm.shared import held

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*values: Column) -> Column:
    """sha256 over the values, each written as its number of bytes, a colon and itself; `-` if null."""
    texts = [value.cast("string") for value in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with `at`, their place (0, 1, …) in their `group`, and `n`, the size of the group.

    `order` decides up to rows that may be exchanged; such rows are spread by a salt.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_salt", F.rand(7))
    ranged = salted.repartitionByRange(parts, "group", *order, "_salt").sortWithinPartitions("group", *order, "_salt").drop("_salt")
    fixed = held(ranged.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    runs = fixed.groupBy("group", part.alias("_part")).agg(F.min("_row").alias("_first"), F.count("*").alias("_count"))
    whole = Window.partitionBy("group")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "group", "_part", (F.coalesce(F.sum("_count").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_count").over(whole).alias("n"),
    )
    joined = fixed.withColumn("_part", part).join(runs, ["group", "_part"])
    return joined.withColumn("at", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def runs_of(nodes: DataFrame, fanout: int) -> DataFrame:
    """(group, run, n, digests) of every run of neighbouring nodes, from its slot-zero node.

    Every other node is shifted to the index of its run's slot zero and joined there; the rows of a
    run are then where the join left them, so gathering its `fanout` digests shuffles nothing more.
    """
    slot = F.pmod("at", F.lit(fanout)).cast("int")
    index = F.col("at").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("at") - slot
    sibling = F.struct(slot.alias("slot"), F.col("digest").alias("digest"))
    zero = nodes.filter(slot == 0).select("group", "at", "n", "digest")
    shifted = nodes.filter(slot > 0).select("group", index.alias("at"), sibling.alias("_sibling"))
    met = zero.join(shifted, ["group", "at"], "left").groupBy("group", "at", "n", "digest")
    others = F.transform(F.sort_array(F.collect_list("_sibling")), lambda s: s["digest"])
    return met.agg(others.alias("_others")).select(
        "group", F.floor(F.col("at") / fanout).cast("long").alias("run"), "n", F.concat(F.array("digest"), "_others").alias("digests")
    )


def tree(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """All levels of runs, and the tops (group, digest).

    `nodes` have group, at, n, digest and lie in a written table.
    """
    levels, tops = [], [nodes.filter("n = 1").select("group", "digest")]
    level = nodes.filter("n > 1").select("group", "at", "n", "digest")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(held(runs_of(level, fanout)))
        up = F.sha2(F.array_join("digests", ""), 256).alias("digest")
        level = levels[-1].select("group", F.col("run").alias("at"), F.ceil(F.col("n") / fanout).cast("long").alias("n"), up)
        tops.append(level.filter("n = 1").select("group", "digest"))
        level, most = level.filter("n > 1"), -(-most // fanout)
    return levels, reduce(DataFrame.unionByName, tops)


def _sides(digests: Column, slot: Column) -> Column:
    """What lies to the left and to the right of a slot of a run, as one text each."""
    left = F.array_join(F.slice(digests, F.lit(1), slot), "")
    right = F.array_join(F.slice(digests, slot + 2, F.size(digests)), "")
    return F.struct(left.alias("left"), right.alias("right"))


def _under(rows: DataFrame, place: str, parents: DataFrame, fanout: int) -> DataFrame:
    """`rows`, which have a `place` in their level, with the path and the top that follow from their run."""
    given = [c for c in parents.columns if c not in ("group", "run", "n", "digests", "path")]
    above = parents.select("group", F.col("run").alias("_run"), F.col("digests").alias("_digests"), F.col("path").alias("_path"), *given)
    met = rows.withColumn("_run", F.floor(F.col(place) / fanout).cast("long")).join(above, ["group", "_run"])
    sides = _sides(F.col("_digests"), F.pmod(place, F.lit(fanout)).cast("int"))
    return met.withColumn("path", F.concat(F.array(sides), "_path")).drop("_run", "_digests", "_path")


def paths(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """`nodes` with `path`: what lies beside their ancestors on every level up to the top, bottom first.

    `tops` (group, path, …) say how it goes on above each group's top; their columns are handed down.
    """
    parents = None
    for level in reversed(levels):
        highest = level.filter(F.col("n") <= fanout).join(tops, "group")
        if parents is not None:
            highest = highest.unionByName(_under(level.filter(F.col("n") > fanout), "run", parents, fanout))
        parents = highest
    found = nodes.filter("n = 1").join(tops, "group")
    if parents is not None:
        found = found.unionByName(_under(nodes.filter("n > 1"), "at", parents, fanout))
    return found


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path."""
    return F.aggregate(path, leaf, lambda own, sides: F.sha2(F.concat(sides["left"], own, sides["right"]), 256))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda sides: F.concat(sides["left"], sides["right"])), ""), 256)


NO_PATH = "array<struct<left:string,right:string>>"


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, path and tampered_leaf of every row of `docs` (`COLUMNS`).

    `tampered` is a text to check against the manifest in place of the row's own; where it is
    null, tampered_leaf is null.
    """
    typed = {"doc_id": "long", "n_chars": "long"}
    values = [F.col(c).cast(typed.get(c, "string")) for c in COLUMNS]
    leaf = digest(*values)
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), digest(*values[:-1], tampered))
    # A group's key: null languages first, then by the bytes of the others.
    group = F.coalesce(F.concat(F.lit("="), values[2]), F.lit(""))
    leaves = held(docs.select(group.alias("group"), values[0].alias("doc_id"), leaf.alias("digest"), changed.alias("tampered_leaf")))
    nodes = held(placed(leaves, ["doc_id", "digest"]))
    levels, subroots = tree(nodes, fanout)
    subroots = held(subroots.select(F.lit("").alias("group"), F.col("group").alias("of"), "digest"))
    upper = held(placed(subroots, ["of"]))
    upper_levels, top = tree(upper, fanout)
    ends = top.select("group", F.array().cast(NO_PATH).alias("path"), F.col("digest").alias("root"))
    tops = paths(upper, upper_levels, ends, fanout)
    tops = held(tops.select(F.col("of").alias("group"), "path", F.col("digest").alias("subroot"), "root"))
    found = paths(nodes, levels, tops, fanout)
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "tampered_leaf")


def lower_cased(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def verified(docs: DataFrame, every: int = 3, fanout: int = FANOUT) -> DataFrame:
    """The manifest, with a share of the texts tampered with and checked against their proofs.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root and verified. Where `every`
    divides the crc32 of the decimal doc_id, the checked text is the lower-cased one; a row
    without doc_id and a null text stay as they are.
    """
    picked = F.crc32(F.col("doc_id").cast("long").cast("string")) % every == 0
    found = manifest(docs, F.when(picked, lower_cased(F.col("text").cast("string"))), fanout)
    root = folded(F.coalesce("tampered_leaf", "leaf"), F.col("path"))
    rows = found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
