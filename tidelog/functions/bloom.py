"""Bloom filters as tables of bit positions: sizing, building and probing with DataFrame operations only.

Parquet runs carry their own filters (see sources.runs); this operator is for filters that a caller wants to
see, store or join with.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sizing(n: int, fpp: float) -> tuple[int, int]:
    """Bits and hash functions for n keys; (0, 0) for none."""
    if not 0 < fpp < 1:
        raise ValueError("fpp must lie between 0 and 1")
    if n <= 0:
        return 0, 0
    bits = -n * math.log(fpp) / math.log(2) ** 2
    return math.ceil(bits), max(1, math.floor(bits / n * math.log(2) + 0.5))


def sizing_columns(n: Column, fpp: Column) -> tuple[Column, Column]:
    """The same as columns."""
    bits = -n * F.log(fpp) / F.pow(F.log(F.lit(2.0)), F.lit(2.0))
    hashes = F.greatest(F.lit(1), F.round(bits / n * F.log(F.lit(2.0))).cast("int"))
    return F.when(n > 0, F.ceil(bits)).otherwise(0).cast("bigint"), F.when(n > 0, hashes).otherwise(0)


def positions(key: Column, bits: int, hashes: int) -> Column:
    """The key's bit positions, by double hashing of two 32-bit halves (no 64-bit overflow under ANSI)."""
    digest = F.md5(key)
    low = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    high = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(low + i * high, F.lit(bits)))


def build(df: DataFrame, key: str, bits: int, hashes: int, by: list[str] | None = None) -> DataFrame:
    """The set bits, one row each, of one filter or of one for each group."""
    by = by or []
    return df.select(*by, F.explode(positions(F.col(key), bits, hashes)).alias("bit")).distinct()


def probe(keys: DataFrame, key: str, filters: DataFrame, bits: int, hashes: int) -> DataFrame:
    """keys with maybe_present: false is certain."""
    wanted = keys.select(key).distinct().select(key, F.explode(F.array_distinct(positions(F.col(key), bits, hashes))).alias("bit"))
    hit = wanted.join(filters.select("bit", F.lit(1).alias("_set")).distinct(), "bit", "left")
    hit = hit.groupBy(key).agg((F.count("_set") == F.count(F.lit(1))).alias("maybe_present"))
    return keys.join(hit, key, "left")
