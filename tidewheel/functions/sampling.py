"""Bounded samples that don't depend on partitioning, and don't gather more than they keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_bound(rows: int, most: int) -> int:
    """A signed 64-bit hash below which surely are `most` of so many rows, and few more.

    With p = (2 * most + 200) / rows, the chance of fewer than most rows below it is under 1e-20.
    """
    p = (2 * most + 200) / max(1, rows)
    return (1 << 63) - 1 if p >= 1 else int(-(1 << 63) + p * (1 << 64))


def hash_sample(df: DataFrame, most: int, *keys: Column | str, seed: int = 42) -> DataFrame:
    """The `most` rows with the smallest seeded hashes of keys, ties by the keys themselves.

    One count of the rows gives a bound, so that about twice as many rows as are kept are sorted,
    and not `most` from every partition.
    """
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    h = F.xxhash64(F.lit(seed), *columns)
    few = df.filter(h <= F.lit(hash_bound(df.count(), most)).cast("long"))
    return few.orderBy(h, *columns).limit(most)
