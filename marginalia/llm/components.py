"""Connected components of an edge table, by contraction; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marginalia.llm.shared import held, is_empty


def _rooted(pointers: DataFrame) -> DataFrame:
    """(id, root): every pointer followed to its end. The reach doubles in each round."""
    while True:
        ends = pointers.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        further = held(
            pointers.join(ends, "root", "left").select(
                "id",
                F.coalesce("_next", "root").alias("root"),
                (F.coalesce("_next", "root") != F.col("root")).alias("_moved"),
            )
        )
        pointers = further.select("id", "root")
        if is_empty(further.filter("_moved")):
            return pointers


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in `edges` (a, b): root is the smallest id it can reach.

    Every round points each id to its smallest neighbour (a partial aggregate, so a hot id
    is no hot task), follows the pointers to their ends and keeps only edges between
    different ends. Edges with a null, loops and repeated edges change nothing.
    """
    left, right = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = held(edges.filter("a <> b").select(left, right).distinct())
    labels = None
    while not is_empty(edges):
        both = edges.union(edges.select("b", "a"))
        found = _rooted(held(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("_n")).select("id", F.least("id", "_n").alias("root"))))
        if labels is None:
            labels = found
        else:
            newer = found.select(F.col("id").alias("root"), F.col("root").alias("_new"))
            labels = labels.join(newer, "root", "left").select("id", F.coalesce("_new", "root").alias("root"))
            labels = held(labels)
        of_a = found.select(F.col("id").alias("a"), F.col("root").alias("_a"))
        of_b = found.select(F.col("id").alias("b"), F.col("root").alias("_b"))
        moved = edges.join(of_a, "a").join(of_b, "b").filter("_a <> _b")
        edges = held(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    if labels is None:
        kind = edges.select(F.col("a").alias("id"), F.col("a").alias("root"))
        return kind
    return labels
