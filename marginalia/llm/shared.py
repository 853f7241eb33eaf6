"""Small helpers of the operators: fixed results, columns that cannot clash, seeds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from marginalia.session import use_checkpoint_dir


def held(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder; lost executors cannot take them away."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def odd_numbers(count: int, seed: int) -> np.ndarray:
    """Fixed odd 64-bit multipliers."""
    drawn = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, count, dtype=np.uint64)
    return drawn * np.uint64(2) + np.uint64(1)


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values with every input bit spread over the whole word (in place)."""
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def share(name: str, key: Column, parts: int, residue: int) -> Column:
    """Is the row in the held-out part? A null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.crc32(text) % parts == residue).alias(name)
