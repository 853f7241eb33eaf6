"""Bounded samples of labelled rows to fit a model on, and whole texts in slices."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F


def drawn(rows: DataFrame, label: str, key: Column, bound: int, repeats: bool = False) -> DataFrame:
    """A fixed sample of about `bound` rows at most, as many of each label as can be.

    Rows are drawn by a hash of `key`, with one share per label so that each has the same
    expected number. Only the number of rows per label reaches the driver; labels are classes.
    With `repeats`, rows of one label and key count as one, and one of them is drawn.
    """
    counted = rows.select(label, F.xxhash64(key)).distinct() if repeats else rows
    sizes = {r[label]: r["count"] for r in counted.groupBy(label).count().collect()}
    if not sizes:
        return rows
    each, left, kinds = 0, bound, len(sizes)
    for size in sorted(sizes.values()):
        each = max(each, left // kinds)
        left, kinds = left - min(size, each), kinds - 1
    place = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30))
    share = F.lit(0)
    for value, size in sizes.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(int(min(1.0, each / size) * (1 << 30)))).otherwise(share)
    found = rows.filter(place < share)
    return found.withColumn("_key", key).dropDuplicates([label, "_key"]).drop("_key") if repeats else found


def with_labels(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, bound: int) -> DataFrame:
    """text, label of a bounded sample of the labelled documents outside the held-out part.

    The drawn labels are bounded, so they are broadcast and no text is shuffled. Equal texts
    count once. A doc_id with several labels has the largest; null labels and texts are void.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.filter(~held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    few = drawn(known, "label", F.col("doc_id"), bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(few), "doc_id").filter("text IS NOT NULL").select("text", "label")
    return joined.dropDuplicates(["text", "label"])


def slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The whole text in slices, cut at spaces where there are any."""
    at = 0
    while len(text) - at > size:
        end = text.rfind(" ", at, at + size)
        end = at + size if end <= at else end
        yield text[at:end]
        at = end
    yield text[at:] if at else text
