"""Keyed building blocks that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marginalia.session import use_checkpoint_dir

def last_per_key(df: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    """One row per key, the newest. Each task keeps one row per key before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def top_k_per_key(
    df: DataFrame, keys: list[str], order: list[Column], k: int, salt_on: str, salts: int = 64
) -> DataFrame:
    """First ``k`` rows per key, ranked in two steps so that no key is ranked in one task.

    The first step ranks within (key, salt) and keeps at most ``k`` of each; the second
    sees at most ``k * salts`` rows per key. The result is exact.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
    near = Window.partitionBy(*keys, "_salt").orderBy(*order)
    full = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(near))
        .filter(F.col("_rn") <= k)
        .withColumn("rank", F.row_number().over(full))
        .filter(F.col("rank") <= k)
        .drop("_salt", "_rn")
    )


def dense_ordinals(keys: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """0, 1, 2 … over the whole frame in the given order, without a single-task sort.

    ``order`` must identify a row. Pass narrow key columns only and join the ordinals
    back. Rows are range-partitioned and checkpointed, so that partition numbers cannot
    change when a lost executor is replaced; every partition then numbers its own rows
    from the summed sizes of the partitions before it.
    """
    use_checkpoint_dir(keys.sparkSession)
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    fixed = ranged.checkpoint()
    sizes = fixed.groupBy("_part").count()
    # One row per range partition: at most `parts` rows.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        fixed.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_rn") - 1)
        .drop("_part", "_rn", "_offset")
    )
