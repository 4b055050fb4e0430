"""Newest version of each key, then no deletions.  Always in that order: the other one revives deleted keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(log: DataFrame, keys: list[str], seq: str | list[str] = "seq") -> DataFrame:
    """One row for each key, deletions included.

    row_number() = 1 is planned as a WindowGroupLimit before and after the exchange, so that a key with many
    versions leaves each map task as one row.
    """
    seqs = [seq] if isinstance(seq, str) else seq
    w = Window.partitionBy(*keys).orderBy(*(F.col(s).desc() for s in seqs))
    return log.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def resolve(log: DataFrame, keys: list[str], seq: str | list[str] = "seq", deleted: Column | None = None) -> DataFrame:
    """The current state.  deleted: marks deletions; by default, rows whose value is null."""
    gone = F.col("value").isNull() if deleted is None else F.coalesce(deleted, F.lit(False))
    return newest(log, keys, seq).filter(~gone)


def resolve_by_max(log: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """The same for one value column, as a partial and final aggregate."""
    return log.groupBy(*keys).agg(F.max_by(value, seq).alias(value)).filter(F.col(value).isNotNull())


def as_of(log: DataFrame, seq: str, at: int) -> DataFrame:
    """The log as it was; resolve it for a snapshot."""
    return log.filter(F.col(seq) <= at)
